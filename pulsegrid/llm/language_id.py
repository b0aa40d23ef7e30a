"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; everything but letters and their marks becomes a space, runs of spaces become one, and one
stands at either end. Its features are the n-grams of 1 to ORDER characters, each hashed to one of 2 ** BITS buckets,
repeats included. Training counts buckets by language, in tables inside the tasks and then in one aggregate; the
smoothed log-probabilities are a matrix of buckets by languages, which every scoring task gets. A text's score for each
language is the sparse dot product of its bucket counts with the matrix, plus the language's prior.

What is broadcast doesn't grow with the input: it is bounded by 2 ** bits times `most_languages`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

BITS, ORDER, ALPHA = 16, 4, 0.5
UNKNOWN = "und"
_LETTER, _MARK = 2, 1
_PRIME, _GOLDEN = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point, whether it is a letter, a mark that may stand on one, or neither (0)."""
    of = {"L": _LETTER, "M": _MARK}
    return np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def folded(text: str, window: int = 1 << 20) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, how many of them are of the part before) for the folded text's parts of some `window` characters."""
    low, tail, kinds = text.lower(), np.array([32], np.uint32), _kinds()
    for k in range(0, len(low), window):
        c = np.frombuffer(low[k : k + window].encode("utf-32-le", "replace"), "<u4")
        keep = kinds[c] > 0
        after = np.concatenate([[tail[-1] != 32], keep[:-1]])
        part = np.concatenate([tail, np.where(keep, c, 32)[keep | after]])
        yield part, len(tail)
        tail = part[-(ORDER - 1) :]
    if tail[-1] != 32:
        yield np.append(tail, np.uint32(32)), len(tail)


def bucket_counts(text: str, bits: int = BITS, window: int = 1 << 20) -> np.ndarray:
    """How often each bucket occurs among the whole text's n-grams."""
    out = np.zeros(1 << bits, np.int64)
    for part, old in folded(text, window):
        h = np.zeros(len(part) + 1, np.uint64)
        for n in range(1, ORDER + 1):
            if len(part) < n:
                break
            h = (h[:-1] + np.uint64(n)) * _PRIME ^ part[n - 1 :]
            new = h[max(0, old - n + 1) :]  # those that end in this part
            out += np.bincount(((new * _GOLDEN) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """languages in ascending order; log_probs: buckets by languages; priors: log shares of the training documents."""

    languages: list[str]
    log_probs: np.ndarray
    priors: np.ndarray


def fit(train: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, alpha: float = ALPHA, most_languages: int = 128) -> Model:
    """The model of all rows of train whose lang isn't null and whose text has a letter; whole texts.

    Repeated rows count as often as they come. Languages are values of lang as text, the empty one too. Without usable
    rows the model has no language. Raises if lang has over most_languages different values: the tables of counts are
    bounded by it.
    """
    own = train.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    named = sorted(r["lang"] for r in own.select("lang").distinct().limit(most_languages + 1).collect())
    if len(named) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    place = {v: k for k, v in enumerate(named)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, documents = np.zeros((len(named), 1 << bits), np.int64), np.zeros(len(named), np.int64)
        for batch in batches:
            for v, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(s):
                    table[place[v]] += bucket_counts(s, bits)
                    documents[place[v]] += 1
        rows, buckets = np.nonzero(table)
        rows, buckets, n = (np.concatenate(x) for x in ((np.arange(len(named)), rows), (np.full(len(named), -1), buckets), (documents, table[rows, buckets])))
        for k in range(0, len(rows), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(rows[part].astype(np.int32)), pa.array(buckets[part].astype(np.int32)), pa.array(n[part].astype(np.int64))], ["lang", "bucket", "n"])

    # At most 2 ** bits + 1 rows a language.
    got = own.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table, documents = np.zeros((len(named), 1 << bits)), np.zeros(len(named))
    told = got["bucket"] < 0
    documents[got["lang"][told]] = got["n"][told]
    table[got["lang"][~told], got["bucket"][~told]] = got["n"][~told]
    used = np.flatnonzero(documents)
    table = table[used] + alpha
    return Model([named[k] for k in used], np.log(table / table.sum(1, keepdims=True)).T.copy(), np.log(documents[used] / documents.sum()) if len(used) else np.zeros(0))


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language of each whole text and its posterior probability, 0 to 1. No shuffle.

    Null texts, texts without a letter, and all texts if the model has no language get UNKNOWN and 0. Languages of
    equal scores: the first in order. Columns that are named like the new ones are replaced; others pass. A very long
    text is read in parts of a million characters.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.drop(lang, score)
    at, names = kept.columns.index(text), kept.columns

    def one(s: str | None, m: Model, bits: int) -> tuple[str, float]:
        if not m.languages or not has_letter(s):
            return UNKNOWN, 0.0
        n = bucket_counts(s, bits)
        index = np.flatnonzero(n)
        total = n[index] @ m.log_probs[index] + m.priors
        best = int(np.argmax(total))
        return m.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        bits = int(m.log_probs.shape[0]).bit_length() - 1
        for batch in batches:
            got = [one(s, m, bits) for s in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, lang, score])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{lang}` string", f"`{score}` double"]))


def query(spark, sf_dir: str, folds: int = 4, held_out: int = 2) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = crc_mod("doc_id", folds)
    return predict(docs.select("doc_id", "text"), fit(docs.where(fold != held_out))).select("doc_id", (fold == held_out).alias("held_out"), "lang_pred", "score")
