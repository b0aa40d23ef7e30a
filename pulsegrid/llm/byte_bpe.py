"""Byte-level BPE: texts to ids and ids to bytes, from a file of ranks, with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitEncoder, free_name


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """The bytes of each id, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, f)]
    table = [b""] * (max(rank for _, rank in pairs) + 1)
    for token, rank in pairs:
        table[rank] = token
    return table


def build_tokenizer(table: list[bytes], pattern: str):
    """A tokenizers.Tokenizer that merges by rank. Any two tokens that join to a token may merge, at that token's rank."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    names = ["".join(map(chars.__getitem__, token)) for token in table]
    vocab = {name: k for k, name in enumerate(names) if name}
    merges = [(name[:c], name[c:]) for name in vocab for c in range(1, len(name)) if name[:c] in vocab and name[c:] in vocab]
    t = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


_LOADED: dict[tuple[str, str], tuple[list[bytes], UnitEncoder]] = {}


def loaded(path: str, pattern: str) -> tuple[list[bytes], UnitEncoder]:
    if (path, pattern) not in _LOADED:
        table = load_ranks(path)
        _LOADED[path, pattern] = table, UnitEncoder(build_tokenizer(table, pattern))
    return _LOADED[path, pattern]


def byte_offsets(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each token begins, in bytes of the text, and where the last ends."""
    return np.concatenate([[0], np.cumsum(lengths[ids])])


def character_offsets(data: bytes, at: np.ndarray) -> np.ndarray:
    """For byte offsets, the number of characters that begin before each; a split character begins in its first token."""
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(first)])[at]


def pieces(tokens: list[bytes]) -> list[str]:
    """The text that each token completes: a character split over tokens appears with its last one; bytes that
    are no UTF-8 become U+FFFD."""
    d = codecs.getincrementaldecoder("utf-8")("replace")
    return [d.decode(t, k == len(tokens) - 1) for k, t in enumerate(tokens)]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """df with the token ids of each text as a binary of little-endian unsigned 32-bit integers; null text: empty.

    With offsets, a column array<int> of that name gives the character at which each token begins. All columns
    of df stay; a column that is named like a new one is replaced. Each row stands alone: no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encoder = loaded(path, pattern)
        lengths = np.array([len(t) for t in table])
        for batch in batches:
            for row, flat, bounds in encoder.parts(batch.column(batch.schema.get_field_index(src))):
                part = batch.slice(row, len(bounds) - 1)
                got = [flat[a:b].astype("<u4").tobytes() for a, b in pairwise(bounds.tolist())]
                cols = [c for c, f in zip(part.columns, part.schema) if f.name != src] + [pa.array(got, pa.binary())]
                names = [f.name for f in part.schema if f.name != src] + [ids]
                if offsets:
                    texts = part.column(part.schema.get_field_index(src)).to_pylist()
                    at = [character_offsets((s or "").encode(), byte_offsets(np.frombuffer(g, "<u4"), lengths))[:-1] for s, g in zip(texts, got)]
                    cols.append(pa.array(at, pa.list_(pa.int32())))
                    names.append(offsets)
                yield pa.RecordBatch.from_arrays(cols, names)

    src = free_name(df, "text_in")
    kept = df.drop(ids, *([offsets] if offsets else [])) if text not in (ids, offsets) else df.drop(*({ids, offsets} - {text, None}))
    kept = kept.withColumn(src, F.col(text).cast("string"))
    if text in (ids, offsets):
        kept = kept.drop(text)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != src] + [f"`{ids}` binary"] + [f"`{offsets}` array<int>"] * bool(offsets)
    return kept.mapInArrow(run, ", ".join(kinds))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", tokens: str | None = None) -> DataFrame:
    """df with the bytes that each row's ids stand for; null: empty. ids as encode() gives them.

    Bytes are joined before any is read as a character, so a character split over tokens is whole again. With
    tokens, a column array<string> of that name gives the text each token completes (see pieces). An id outside
    the table raises.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_ranks_once(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                each = [list(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(part.schema.get_field_index(src)).to_pylist()]
                cols = [c for c, f in zip(part.columns, part.schema) if f.name != src] + [pa.array([b"".join(x) for x in each], pa.binary())]
                names = [f.name for f in part.schema if f.name != src] + [out]
                if tokens:
                    cols.append(pa.array([pieces(x) for x in each], pa.list_(pa.string())))
                    names.append(tokens)
                yield pa.RecordBatch.from_arrays(cols, names)

    src = free_name(df, "ids_in")
    kept = df.drop(*({out, tokens} - {ids, None})).withColumn(src, F.col(ids))
    if ids in (out, tokens):
        kept = kept.drop(ids)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != src] + [f"`{out}` binary"] + [f"`{tokens}` array<string>"] * bool(tokens)
    return kept.mapInArrow(run, ", ".join(kinds))


_TABLES: dict[str, list[bytes]] = {}


def load_ranks_once(path: str) -> list[bytes]:
    if path not in _TABLES:
        _TABLES[path] = load_ranks(path)
    return _TABLES[path]


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its text, with digests of both directions in one pass: n_tokens, ids_sha256 (of the decimal ids
    with a space between) and decoded_sha256 (of the bytes that the ids stand for). Columns of df that are named
    like these are replaced; null text counts as empty; a very long text is encoded whole; an empty table stays empty."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rest = [c for c in df.columns if c != text and c not in new]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encoder = loaded(path, pattern)
        for batch in batches:
            out: list[list] = [[], [], []]
            for _, flat, bounds in encoder.parts(batch.column(len(rest))):
                every = flat.tolist()
                for a, b in pairwise(bounds.tolist()):
                    ids = every[a:b]
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    out[2].append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [*rest, *new])

    kept = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(free_name(df, "text_in")))
    return kept.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
