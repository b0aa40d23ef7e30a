"""Embedding near-duplicates by spherical-cap filters.

After a fixed random rotation a unit vector is cut into two blocks, and each block has a code of random unit
directions. A filter is a pair of directions, one for each block, so `codewords` per block make codewords ** 2
filters; `codes` such product codes, each with its own rotation, are used side by side. A vector passes a filter if
its inner product with the filter's direction exceeds `cap` (in standard deviations of what a random direction
gives). List-decoding finds all filters that a vector passes without trying them all: with a block's scores sorted,
the partners of a codeword are a prefix. Vectors that share a filter are compared in double precision. By default a
vector passes some 65 filters; one that passes few is entered in the nearest ones instead. Two vectors of cosine 0.9
share none with a chance of 0.03 %, and from cosine 0.95 on practically never. A lower cap or more codes lower that
chance at the price of more rows.

Equal vectors are one row beforehand, with their number. A filter's vectors are split by hash into parts of bounded
size, and every two parts meet in a task of their own, as two blocks of a matrix product; a task gives one row a
vector, not one a pair. A pair counts in the least of the filters that it shares, and so counts once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, lookup_join

CODES, CODEWORDS, CAP, LEAST, THRESHOLD = 2, 180, 3.0, 12, 0.9


@lru_cache(16)
def code(number: int, dims: int, codewords: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, directions of the first block, of the second); the same in every task."""
    rng = np.random.default_rng([seed, number, dims, codewords])
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    half = max(1, dims // 2)
    blocks = [rng.standard_normal((codewords, k)) for k in (half, max(1, dims - half))]
    return rotation, *(b / np.linalg.norm(b, axis=1, keepdims=True) for b in blocks)


def filters_of(unit: np.ndarray, codes: int = CODES, codewords: int = CODEWORDS, cap: float = CAP) -> list[np.ndarray]:
    """For each unit vector, the filters it passes, in ascending order; of each code, at least the LEAST nearest."""
    dims = unit.shape[1]
    half = max(1, dims // 2)
    limit = cap / np.sqrt(dims) * np.sqrt(2.0)  # the filter's direction is both codewords over the root of two
    out: list[list[np.ndarray]] = [[] for _ in unit]
    for number in range(codes):
        rotation, first, second = code(number, dims, codewords)
        turned = unit @ rotation
        a, b = turned[:, :half] @ first.T, (turned[:, half:] if dims > half else turned) @ second.T
        base = number * codewords * codewords
        for own, s, t in zip(out, a, b):
            order = np.argsort(-t)
            falling = -t[order]
            use = np.flatnonzero(s + t[order[0]] > limit)
            n = np.searchsorted(falling, s[use] - limit, "left")
            if n.sum() >= LEAST:
                got = np.concatenate([u * codewords + order[:k] for u, k in zip(use, n)])
            else:  # the nearest are among the best of each block
                top, other = np.argsort(-s)[:LEAST], order[:LEAST]
                near = np.argsort(-(s[top][:, None] + t[other]), axis=None)[:LEAST]
                got = top[near // len(other)] * codewords + other[near % len(other)]
            own.append(np.sort(base + got))
    return [np.concatenate(own) for own in out]


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # against overflow of the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _share_less(lists: list[np.ndarray], this: int) -> np.ndarray:
    """For each two of the filter lists, whether they share a filter below this."""
    low = [f[f < this] for f in lists]
    names, at = np.unique(np.concatenate(low), return_inverse=True)
    has = np.zeros((len(lists), len(names)), np.float32)
    has[np.repeat(np.arange(len(lists)), [len(f) for f in low]), at] = 1
    return has @ has.T > 0


def compare(ids: np.ndarray, unit: np.ndarray, copies: np.ndarray, lists: list[np.ndarray], this: int, same: bool, part: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links that count here, least id reached here) for each vector of a task. same: the task is one part with
    itself; else only pairs of different parts are its own."""
    n = len(ids)
    n_links, label = np.zeros(n, np.int64), np.arange(n)
    cosine = unit @ unit.T
    link = np.triu(cosine >= threshold, 1)
    if not same:
        link &= part[:, None] != part[None, :]
    i, j = np.nonzero(link)
    if not len(i):
        return n_links, ids
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own = ~_share_less([lists[k] for k in some], this)[at[: len(i)], at[len(i) :]]
    np.add.at(n_links, i[own], copies[j[own]])
    np.add.at(n_links, j[own], copies[i[own]])
    link |= link.T
    while True:
        new = np.minimum(label, np.where(link, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return n_links, ids[label]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, codes: int = CODES, codewords: int = CODEWORDS, cap: float = CAP, block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of df.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Only vectors of
    the same length are compared. Rows that repeat a vector are links of each other. Rows without vec_id count as
    links of others; their component_id is the least vec_id reached, or null. Other columns are ignored.
    """
    e, small = F.col("embedding"), np.dtype("<u2" if codes * codewords**2 <= 1 << 16 else "<u4")
    exact = np.dtype("<f4" if df.schema[embedding].dataType.simpleString() == "array<float>" else "<f8")
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    usable = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("usable", usable).withColumn("h1", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit("vector"), "embedding")))
    classes = keyed.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed by being written

    def to_filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sizes = np.array([len(v) for v in batch.column(2)])
            values = batch.column(2).to_pylist()
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                for k in range(0, len(at), 512):
                    some = at[k : k + 512]
                    v = np.array([values[x] for x in some], float)
                    lists = filters_of(unit_rows(v), codes, codewords, cap)
                    n = [len(f) for f in lists]
                    who = np.repeat(np.arange(len(some)), n)
                    flat = np.concatenate(lists).astype(np.int32)
                    packed = [x.astype(exact).tobytes() for x in v]
                    named = [f.astype(small).tobytes() for f in lists]
                    for c in range(0, len(who), 4096):
                        w = who[c : c + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), dims, np.int32)), pa.array(flat[c : c + 4096]), pa.array(nodes[some[w]]), pa.array(copies[some[w]]), pa.array([packed[x] for x in w], pa.binary()), pa.array([named[x] for x in w], pa.binary())], ["dims", "filter", "node", "copies", "vector", "filters"])

    passed = classes.select("node", "copies", "embedding").mapInArrow(to_filters, "dims int, filter int, node long, copies long, vector binary, filters binary")
    half = block // 2
    sizes = passed.groupBy("dims", "filter").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.when(F.col("size") <= block, 1).otherwise(F.ceil(F.col("size") / half)).cast("int")
    placed = lookup_join(passed, sizes, ["dims", "filter"], "inner").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")).drop("size")
    # Part i meets part j in task (i, j), i <= j: a row goes to one task for each part. There are as many sizes as
    # filters, a parameter, so they are joined before the one shuffle, and a crowded filter's tasks spread over it.
    tasks = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "parts")

    names = ["dims", "filter", "low", "high"]

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; each run of rows of one task is compared, the last run once its end is seen."""
        held: pa.Table | None = None

        def compared(rows: pa.Table, borders: np.ndarray) -> pa.RecordBatch:
            this, low, high = (rows.column(c).to_numpy() for c in names[1:])
            node, copies, part = (rows.column(c).to_numpy() for c in ("node", "copies", "part"))
            vectors, lists = rows.column("vector").to_pylist(), rows.column("filters").to_pylist()
            out: list[list[np.ndarray]] = [[], [], []]
            for x, y in zip(borders, borders[1:]):
                if y - x < 2:
                    continue
                order = x + np.argsort(node[x:y])
                unit = unit_rows(np.array([np.frombuffer(vectors[k], exact) for k in order], float))
                ids = node[order]
                n, root = compare(ids, unit, copies[order], [np.frombuffer(lists[k], small) for k in order], this[x], low[x] == high[x], part[order], threshold)
                some = (n > 0) | (root != ids)
                for col, v in zip(out, (ids, n, root)):
                    col.append(v[some])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([], np.int64), *c])) for c in out], ["node", "n", "root"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            key = np.stack([rows.column(c).to_numpy() for c in names])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(ends):
                yield compared(rows, np.concatenate([[0], ends]))
                held = rows.slice(int(ends[-1]))
            else:
                held = rows
        if held is not None:
            yield compared(held, np.array([0, held.num_rows]))

    sorted_tasks = tasks.repartition(*names).sortWithinPartitions(*names)
    found = checkpointed(sorted_tasks.mapInArrow(meet, "node long, n long, root long").groupBy("node", "root").agg(F.sum("n").alias("n")))
    n_links = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select("node", "root"), "node", "root").withColumnRenamed("component", "root")
    rooted = checkpointed(classes.select("node", "h1", "h2", "id", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")).join(n_links, "node", "left"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = rooted.join(least, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "usable", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
