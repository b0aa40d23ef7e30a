"""Hierarchical multi-length packing: documents to training sequences of several context sizes.

Each document is encoded, ended, and routed: every full window of the longest tier is cut off as a sequence of its
own; the rest goes to the smallest tier that holds it. Tiers are packed from the longest down. What a document
leaves open in its window is filled with whole rests of shorter tiers, the largest that fits first, and last with a
piece cut from a shorter one, whose remainder is routed anew. Rests that find no such filler are carried along, and
at the end of a partition joined and cut at powers of two. So every sequence is full: none is padded.

Sequences are dealt to step groups, each of the same number of ids (the last of a partition excepted): sequences
go in descending length into groups of `step_tokens`, which powers of two fill without crossing a border.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import json_encoder

TIERS = (512, 1024, 2048, 4096)
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs rests (document, start, stop); documents are any objects, and pieces point to them."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest = tiers, tiers[-1]
        self.carried: list[tuple] = []  # rests without a filler
        self.n_carried = 0
        self.out: list[list[tuple]] = []  # sequences, each a list of pieces

    def _cut(self, pieces: list[tuple], size: int) -> list[tuple]:
        """Takes `size` ids from the front of pieces."""
        got = []
        while size:
            doc, a, b = pieces[0]
            take = min(size, b - a)
            got.append((doc, a, a + take))
            size -= take
            if a + take == b:
                pieces.pop(0)
            else:
                pieces[0] = (doc, a + take, b)
        return got

    def add(self, docs: list[tuple]) -> None:
        """docs: (document, number of ids). Packs all of them but what it carries, under one longest window a tier."""
        rests: list[tuple] = []
        for doc, n in docs:
            full = n // self.longest * self.longest
            self.out.extend([[(doc, a, a + self.longest)] for a in range(0, full, self.longest)])
            if full < n:
                rests.append((n - full, len(rests), doc, full))
        rests.sort()
        for tier in reversed(self.tiers):
            shorter = tier // 2 if tier > self.tiers[0] else 0
            while rests and rests[-1][0] > shorter:
                n, _, doc, a = rests.pop()
                window, gap = [(doc, a, a + n)], tier - n
                while gap and rests:
                    k = bisect_right(rests, (gap, 1 << 62)) - 1
                    if k >= 0:
                        m, _, d, b = rests.pop(k)
                        window.append((d, b, b + m))
                        gap -= m
                    else:
                        m, i, d, b = rests.pop(0)
                        window.append((d, b, b + gap))
                        insort(rests, (m - gap, i, d, b + gap))
                        gap = 0
                if gap:
                    self.carried += window
                    self.n_carried += tier - gap
                else:
                    self.out.append(window)
        while self.n_carried >= self.longest:
            self.out.append(self._cut(self.carried, self.longest))
            self.n_carried -= self.longest

    def end(self) -> None:
        for k in reversed(range(self.longest.bit_length())):
            if self.n_carried & 1 << k:
                self.out.append(self._cut(self.carried, 1 << k))
        self.n_carried = 0

    def take(self) -> list[list[tuple]]:
        got, self.out = self.out, []
        return got


def pack(
    df: DataFrame, tokenizer: str, end_id: int, folds: bool = False, doc_id: str = "doc_id", text: str = "text",
    tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 19, at_once: int = 1 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset, tier, step_group.

    Tiers are powers of two, each twice the last. folds: see json_encoder. Every partition of df is packed on its own,
    as it is read, about at_once ids at a time, so there is no shuffle, memory is bounded, and a repeated task gives
    the same rows. A very long text is encoded whole and cut into windows. Null texts count as empty: end_id alone.
    Rows of one doc_id are documents of their own. Other columns are ignored; an empty table gives no row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_encoder(tokenizer, folds)
        part = TaskContext.get().partitionId() << 36
        packer, n_sequences, n_ids = Packer(tiers), 0, 0

        size = lambda sequence: sum(b - a for _, a, b in sequence)
        waiting: list[list[tuple]] = []

        def emit(last: bool = False) -> Iterator[pa.RecordBatch]:
            """Gives out what fills longest windows; the short sequences behind wait for more, so that no group's border is crossed."""
            nonlocal n_sequences, n_ids, waiting
            ready = sorted(waiting + packer.take(), key=lambda s: -size(s))
            borders = np.flatnonzero(np.cumsum([size(s) for s in ready]) % tiers[-1] == 0) if ready else []
            cut = len(ready) if last else int(borders[-1]) + 1 if len(borders) else 0
            ready, waiting = ready[:cut], ready[cut:]
            rows = []
            for sequence in ready:
                offset, group = 0, part + n_ids // step_tokens
                length = size(sequence)
                for (key, ids), a, b in sequence:
                    rows.append((key, a, b - a, ids[4 * a : 4 * b], len(ids) // 4, part + n_sequences, offset, length, group))
                    offset += b - a
                n_sequences += 1
                n_ids += offset
            for k in range(0, len(rows), 4096):
                cols = list(zip(*rows[k : k + 4096]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])

        held, n_held = [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, flat, bounds in encoder.parts(batch.column(1), end_id):
                data, cut = flat.astype("<u4").tobytes(), bounds.tolist()
                held += [((key, data[4 * a : 4 * b]), b - a) for key, a, b in zip(keys[row:], cut, cut[1:])]
                n_held += cut[-1]
                if n_held >= at_once:
                    packer.add(held)
                    held, n_held = [], 0
                    yield from emit()
        packer.add(held)
        packer.end()
        yield from emit(last=True)

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, folds=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents, a row each."""
    return packed(docs)
