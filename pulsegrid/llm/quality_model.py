"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader steps.

Tokens are runs of letters and digits (lower-cased) and runs of other printable characters, so that junk between
words is as visible as the words. Features are hashes of single tokens, of two in a row, and of the patterns "the
same token again" and "the same token but one", whatever the token; a feature's value is its count over the square
root of the number of features of the text. A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, free_name

BITS = 18
_TOKENS = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Token to hash; emptied when large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return h


_HASHES = _Hashes()


def features(text: str | None) -> np.ndarray:
    """The hashed n-grams of the whole text, repeats included."""
    tokens = _TOKENS.findall((text or "").lower())
    one = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(7)
    again, but_one = (np.full(int((one[k:] == one[:-k]).sum()), 0x5BD1E995 + k, np.uint64) for k in (1, 2))
    return (np.concatenate([one, two, again, but_one]) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class FollowTheLeader:
    """FTRL-proximal logistic regression with per-coordinate rates; weights[-1] is the bias, which isn't regularised."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """One update; index holds no repeats."""
        at, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (logistic(w @ x) - label) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 6000, shards: int = 4, epochs: int = 3) -> np.ndarray:
    """Weights from a sample of the labelled documents.

    At most about `most` labelled ids take part, those with the least hashes; the sample is bounded whatever the
    input, so its ids can be broadcast to the documents and a shard's documents fit in a task. Each shard is
    trained by itself over its documents in order of hash, and the shards' weights are averaged. Labels that are
    null or neither 0 nor 1 don't take part; of rows of one doc_id the least text does, and the greater label; ids
    with equal hashes go by the id. A very long text is one list of features. Without labelled documents all weights
    are 0, and all scores 0.5.
    """
    usable = labels.select(F.col(doc_id).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)")
    usable = usable.groupBy("key").agg(F.max("label").alias("label"))
    n = usable.count()
    rank = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30))
    sample = usable.where(rank < int((1 << 30) * min(1.0, most / max(1, n)))).withColumn("rank", rank)
    own = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    rows = own.join(F.broadcast(sample), "key").groupBy("key", "label", "rank").agg(F.min("text").alias("text"))
    rows = rows.select("key", "label", "rank", "text", F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(features(s), return_counts=True) for s in batch.column(3).to_pylist()]
            index = pa.array([i.astype("<i4").tobytes() for i, _ in each], pa.binary())
            value = pa.array([(c / np.sqrt(max(1, c.sum()))).astype("<f4").tobytes() for _, c in each], pa.binary())
            cols = [batch.column(4), batch.column(2), batch.column(0), batch.column(1), index, value]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "rank", "key", "label", "index", "value"])

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("key", "ascending")])
        model, columns = FollowTheLeader(), (group.column(c).to_pylist() for c in ("index", "value", "label"))
        rows = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float), y) for i, v, y in zip(*columns)]
        for _ in range(epochs):
            for row in rows:
                model.step(*row)
        weights = pa.array([model.weights().astype("<f4").tobytes()], pa.binary())
        return pa.table({"shard": group.column("shard").slice(0, 1), "n": pa.array([len(rows)], pa.int64()), "weights": weights})

    kind = labels.schema[doc_id].dataType.simpleString()
    fitted = rows.mapInArrow(sparse, f"shard int, rank long, key {kind}, label int, index binary, value binary").groupBy("shard").applyInArrow(fit, "shard int, n long, weights binary").collect()
    total = sum(r.n for r in fitted)
    out = np.zeros((1 << BITS) + 1)
    for r in sorted(fitted, key=lambda r: r.shard):
        out += np.frombuffer(r.weights, "<f4") * (r.n / total)
    return out


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """df with a column of scores in 0 to 1 for its whole texts; null texts count as empty and get the bias alone.
    A column that is named like the new one is replaced. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kept = df.drop(out)
    at, names = kept.columns.index(text), kept.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            got = []
            for s in batch.column(at).to_pylist():
                f = features(s)
                got.append(float(logistic(float(w[-1]) + float(w[f].sum(dtype=np.float64)) / np.sqrt(max(1, len(f))))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*names, out])

    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` double"]))


ACCEPT = 0.7


def fitted(spark, docs: DataFrame, sf_dir: str, folds: int = 4, held_out: int = 2) -> np.ndarray:
    """Weights learned from the labels of documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", folds) != held_out)
    return train(docs, labels)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is at least 0.7; all of them if none has a label, as then nothing is learned."""
    name, weights = free_name(docs, "quality_score"), fitted(spark, docs, sf_dir)
    if not weights.any():
        return docs
    return score(docs, weights, out=name).where(F.col(name) >= ACCEPT).drop(name)
