"""What several training-data operators share: words, tokenizer caches, checkpoints, components."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D. bytes.split() splits on exactly these.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share. Where that is unset, a temporary one, but
    only if driver and executors are one process; on a cluster it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(sc, "_pulsegrid_shared", None) or "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        sc._pulsegrid_shared = root
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: later reads don't recompute it, and survive lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", most_rows: int = 100_000) -> DataFrame:
    """left joined with right, a table of one row per key. right is materialised and counted: up to most_rows
    rows it is broadcast, beyond that both sides are shuffled and adaptive execution splits hot keys."""
    right = checkpointed(right)
    if right.count() <= most_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- tokenizers -----------------------------------------------------------------------------------

#: What a byte is to the unit encoder: other, white space (space and U+0009 to U+000D), ASCII letter, ASCII punctuation.
_OTHER, _SPACE, _LETTER, _POINT = range(4)
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KINDS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _POINT
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 32
#: Units of one word that no normaliser changes: letters, for a byte tokenizer behind a blank and with those of U+00C0 to
#: U+00FF but the signs U+00D7 and U+00F7.
_LETTERS = re.compile(rb"[a-z]+")
_WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _in_bytes() -> np.ndarray:
    """The characters by which a byte tokenizer shows bytes (GPT-2's alphabet), but a line's end, which parts units."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, "<u4")
    table[shown] = shown
    rest = np.setdiff1d(np.arange(256), shown)
    table[rest] = 0x100 + np.arange(len(rest))
    table[0x0A] = 0x0A
    return table


_IN_BYTES = _in_bytes()


def _any_of(*ranges: str) -> re.Pattern:
    """A pattern over UTF-8 bytes for the characters of the ranges, each given by its ends."""
    each = dict.fromkeys(chr(c).encode() for r in ranges for c in range(ord(r[0]), ord(r[-1]) + 1))
    return re.compile(b"|".join(map(re.escape, each)))


#: White space besides space and U+0009 to U+000D, and what Python alone calls so.
_ODD_SPACE = ("\x1c\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2000\u200f", "\u2028\u202f", "\u205f", "\u2060", "\u3000", "\ufeff")
#: Marks that may combine with a letter before them.
_MARKS = ("\u0300\u036f", "\u1ab0\u1aff", "\u1dc0\u1dff", "\u20d0\u20ff")


class UnitEncoder:
    """Encodes texts with a tokenizers.Tokenizer, each different unit of a part of a column once.

    A unit is a run of white space with what stands behind it up to the next white space; it also ends between an
    ASCII letter and ASCII punctuation. Every pre-tokenizing pattern here starts a new match at white space, and at
    punctuation behind a letter, so no token reaches over the end of a unit, and a text's ids are its units' ids in
    turn. Texts with odd white space, or with the spelling of an added token, are one unit: the library sees them whole.

    The ids of recent units are kept in two generations of at most `most` units: when the new one is full it becomes
    the old one, and units that are met again move over. Ids don't depend on it.
    """

    def __init__(self, tokenizer, bare=None, folds: bool = False, most: int = 400_000):
        """bare: if given, the same tokenizer without what finds and normalises words, but with blanks between them; it encodes
        plain units, which are one word each, many in a call, as they are in its alphabet of bytes. folds: given if the
        tokenizer lower-cases, drops white space and takes a run of letters as one word. Units are then kept without
        white space, A-Z in lower case, and plain ones are letters in lower case."""
        self.tokenizer, self.bare, self.folds, self.most, self.ids, self.old = tokenizer, bare, folds, most, {}, {}
        self.odd = [_any_of(*_ODD_SPACE, *(_MARKS if folds else ()))]
        if added := [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]:
            self.odd.append(re.compile(b"|".join(map(re.escape, added))))
        self.plain = _LETTERS if folds else _WORD
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text in each token
        for token, k in vocabulary.items():
            self.sizes[k] = len(token.removesuffix(suffix))

    def _library(self, units: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(units), 1024):  # what the library makes of a unit takes a kilobyte
            each = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units[k : k + 1024]], add_special_tokens=False)]
            ends = np.cumsum([len(x) for x in each]) * 4
            flat = np.fromiter(chain.from_iterable(each), "<u4", int(ends[-1]) // 4).tobytes()
            out += [flat[a:b] for a, b in pairwise([0, *ends.tolist()])]
        return out

    def _words(self, units: list[bytes]) -> list[bytes]:
        """The ids of plain units: a token's bytes are known, so the units' ends tell which ids are whose."""
        out: list[bytes] = []
        for k in range(0, len(units), 8192):
            some = units[k : k + 8192]
            words = _IN_BYTES[np.frombuffer(b"\n".join(some), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            each = [e.ids for e in self.bare.encode_batch_fast([" ".join(words[j : j + 64]) for j in range(0, len(words), 64)], add_special_tokens=False)]
            ids = np.concatenate([np.array(x, "<u4") for x in each])
            ends, at = np.cumsum([len(u) for u in some]), np.cumsum(self.sizes[ids])
            last = np.searchsorted(at, ends)
            if (at[np.minimum(last, len(at) - 1)] != ends).any():  # a vocabulary that lacks a byte
                out += self._library(some)
                continue
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in pairwise([0, *((last + 1) * 4).tolist()])]
        return out

    def _encode(self, units: list[bytes]) -> list[bytes]:
        if self.bare is None:
            return self._library(units)
        plain = list(map(bool, map(self.plain.fullmatch, units)))
        words = iter(self._words(list(compress(units, plain))))
        full = iter(self._library([u for u, p in zip(units, plain) if not p]))
        return [next(words if p else full) for p in plain]

    def _known(self, units: list[bytes]) -> list[bytes]:
        """The ids of different units, from those kept or from the library."""
        if len(self.ids) + len(units) > self.most:
            self.old, self.ids = self.ids, {}
        ids, old = self.ids, self.old
        got = [ids.get(u) for u in units]
        missing = []
        for k, (u, g) in enumerate(zip(units, got)):
            if g is None:
                if (g := old.get(u)) is None:
                    missing.append(k)
                else:
                    ids[u] = got[k] = g
        new = [units[k] for k in missing]
        for k, u, g in zip(missing, new, self._encode(new)):
            got[k] = g
            if len(u) < 200:
                ids[u] = g
        return got

    def _part(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of the texts data[at[k]:at[k + 1]] one behind the other, and where each begins."""
        kind, size = _KINDS[data], len(data)
        space = kind == _SPACE
        start = np.zeros(size + 1, bool)
        start[1:size] = (space[1:] & ~space[:-1]) | ((kind[1:] == _POINT) & (kind[:-1] == _LETTER))
        raw = data.tobytes()
        odd = np.unique([np.searchsorted(at, m.start(), "right") - 1 for p in self.odd for m in p.finditer(raw)]).astype(int)
        if self.folds:
            # A unit begins at its first character, and white space is left out.
            start[1:size] = (space[:-1] & ~space[1:]) | start[1:size] & ~space[1:]
            keep, data = ~space, _LOWERED[data]
            for a, b in zip(at[odd], at[odd + 1]):
                keep[a:b], data[a:b] = True, np.frombuffer(raw[a:b], np.uint8)
        for a, b in zip(at[odd], at[odd + 1]):
            start[a:b] = False
        start[at] = True
        if self.folds:
            before = np.concatenate([[0], np.cumsum(keep)])
            data, units, at = data[keep], before[start], before[at]
            units = units[np.diff(units, prepend=-1) > 0]
        else:
            units = np.flatnonzero(start)
        units = units[units < len(data)]
        column = pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(np.append(units, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        distinct = column.dictionary_encode()
        _, ends, held = distinct.dictionary.buffers()
        ends, held = np.frombuffer(ends, np.int64)[: len(distinct.dictionary) + 1], held.to_pybytes() if held else b""
        codes, ids = distinct.indices.to_numpy(), self._known([held[a:b] for a, b in pairwise(ends.tolist())])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        each = n[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])
        return flat[where], ends[np.searchsorted(units, at)]

    def parts(self, column: pa.Array, end_id: int | None = None, most_bytes: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, ids, bounds) for runs of rows from that row on, some most_bytes of text or one text at a time: the
        ids (u32) of row + k are ids[bounds[k]:bounds[k + 1]]. Null texts count as empty. end_id: put behind each."""
        column = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, values = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data, row = np.frombuffer(values or b"", np.uint8), 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + most_bytes, "right")) - 1)
            ids, bounds = self._part(data[at[row] : at[stop]], at[row : stop + 1] - at[row])
            if end_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
            yield row, ids, bounds
            row = stop

    def encode(self, text: str | None) -> bytes:
        """One text's ids as little-endian unsigned 32-bit integers; none for null."""
        return b"".join(ids.astype("<u4").tobytes() for _, ids, _ in self.parts(pa.array([text], pa.string())))


_ENCODERS: dict[str, UnitEncoder] = {}


def json_encoder(path: str, folds: bool = False) -> UnitEncoder:
    """The encoder of a tokenizers file, one for each Python worker. A special token's spelling in a text is that
    token, as in the library's plain call. folds: see UnitEncoder.__init__; the file's tokenizer works on bytes."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        whole, bare = Tokenizer.from_file(path), None
        words = whole.pre_tokenizer  # of a byte tokenizer, a blank with the letters behind it is one word
        if folds or whole.normalizer is None and isinstance(words, pre_tokenizers.ByteLevel) and words.use_regex and not words.add_prefix_space:
            bare = Tokenizer.from_file(path)
            bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")
        _ENCODERS[path] = UnitEncoder(whole, bare, folds)
    return _ENCODERS[path]


# --- connected components -------------------------------------------------------------------------


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of the edges.

    Alternates large-star and small-star rounds; each round shuffles the edges by one end, is checkpointed, and
    keeps at most as many edges as before. Ends when no edge changes; raises if it doesn't within most_rounds.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
