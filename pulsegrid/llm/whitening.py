"""Whitening of embeddings by a one-sided Jacobi singular value decomposition.

Each distinct vector counts once. Rows centred on the exact mean are compressed block by block to the triangular factor
R of a QR decomposition (a tall and skinny QR: a factor for each task, then factors of factors, 16 at a time in Spark).
R has as many rows and columns as a vector has entries, whatever the input. Plane rotations then make R's columns
orthogonal; the rotations together are the components, and the columns' lengths the singular values, accurate to
rounding even where they are small, as no covariance matrix is formed on the way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

FACTORS = 16


def whole_entries(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether the vector has no null or non-finite entry, and isn't null."""
    double = lambda c: c.cast("double")
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(double(c)) & (F.abs(double(c)) != float("inf"))), F.lit(False))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, singular values falling) of a square matrix by one-sided plane rotations.

    A sweep meets every pair of columns once, in rounds of disjoint pairs, which are turned together. It ends when
    all pairs are orthogonal to rounding; raises if they aren't after `sweeps`. A component's largest entry is
    positive."""
    d = r.shape[1]
    a, v = r.astype(float).copy(), np.eye(d)
    scale = np.abs(a).max(initial=0.0)
    if scale > 0:
        a /= scale
    ring, bound = np.arange(d + d % 2), 4 * np.sqrt(d) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            do = np.abs(gamma) > bound * np.sqrt(alpha * beta)
            if do.any():
                turned = True
                p, q, gamma, zeta = p[do], q[do], gamma[do], (beta - alpha)[do]
                zeta = zeta / (2.0 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1.0 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    x, y = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    length = np.sqrt((a**2).sum(0))
    order = np.argsort(-length, kind="stable")
    v = v[:, order]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(d)])
    return v * np.where(sign == 0, 1.0, sign), length[order] * scale


@dataclass
class Whitener:
    """n distinct vectors with `sums` by entry; components as columns with their variances, falling; trace: all
    entries' variance; identity_error: see fit(). usable: how many variances aren't zero to rounding."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The rows of x, centred, projected and scaled to a variance of 1; NaN for components without variance."""
        centred = x - np.array([s / self.n for s in self.sums])
        good = self.variances > 0
        return np.where(good, (centred @ self.components) / np.sqrt(np.where(good, self.variances, 1.0)), np.nan)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _centred_blocks(batches: Iterable[pa.RecordBatch], dims: int, mean: np.ndarray, rows: int = 4096) -> Iterator[np.ndarray]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield _matrix(batch.column(0).slice(k, rows), dims) - mean


def _r(*blocks: np.ndarray) -> np.ndarray:
    """The square triangular factor of the stacked blocks."""
    stacked = np.concatenate(blocks)
    short = stacked.shape[1] - len(stacked)
    return np.linalg.qr(np.concatenate([stacked, np.zeros((short, stacked.shape[1]))]) if short > 0 else stacked, mode="r")


def fit(vectors: DataFrame, most: int | None = None, x: str = "x") -> Whitener | None:
    """The whitener of the distinct vectors of x (array<long>), with at most `most` components. None without rows.

    It is for vectors of one length, the most frequent among the distinct ones (of equally frequent ones the greatest).
    Equal vectors become one before anything is gathered, so a hot one is no burden."""
    spark = vectors.sparkSession
    fit_list = checkpointed(vectors.select(F.col(x).alias("x")).distinct())
    commonest = fit_list.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if commonest is None:
        return None
    dims = commonest["d"]
    fit_list = fit_list.where(F.size("x") == dims)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            safe = np.abs(m.astype(float)).max(initial=0.0) * len(m) < 2**62
            total = [a + int(b) for a, b in zip(total, (m if safe else m.astype(object)).sum(0))]
            n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([str(v) for v in [*total, n]])], ["at", "s"])

    rows = fit_list.mapInArrow(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each entry
    *sums, n = (int(r["s"]) for r in sorted(rows, key=lambda r: r["at"]))
    mean = np.array([s / n for s in sums])

    def factor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for block in _centred_blocks(batches, dims, mean):
            r = _r(r, block)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        r = np.zeros((0, dims))
        for b in group.column("r"):
            r = _r(r, np.frombuffer(b.as_py(), float).reshape(dims, dims))
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = fit_list.mapInArrow(factor, "r binary").withColumn("k", F.spark_partition_id().cast("long")).select("k", "r")
    left = fit_list.rdd.getNumPartitions()
    while left > FACTORS:
        left = -(-left // FACTORS)
        factors = factors.withColumn("k", F.floor(F.col("k") / FACTORS)).groupBy("k").applyInArrow(merge, "k long, r binary")
    found = [np.frombuffer(r["r"], float).reshape(dims, dims) for r in sorted(factors.collect(), key=lambda r: r["k"])]  # FACTORS at most
    components, sigma = jacobi(_r(*found)) if dims else (np.zeros((0, 0)), np.zeros(0))
    sigma = np.where(sigma > max(n, dims) * np.finfo(float).eps * sigma.max(initial=0.0), sigma, 0.0)
    variances = sigma**2 / n
    k = dims if most is None else min(most, dims)
    out = Whitener(dims, n, sums, components[:, :k], variances[:k], float(variances.sum()), None)
    sent, good = spark.sparkContext.broadcast(out), int((out.variances > 0).sum())

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, products, totals = sent.value, np.zeros((good, good)), np.zeros(good)
        for batch in batches:
            got = w.whitened(_matrix(batch.column(0), dims))[:, :good]
            products += got.T @ got
            totals += got.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(good * good + good), pa.int32()), pa.array([*products.ravel(), *totals], pa.float64())], ["at", "s"])

    if good:
        rows = sorted(fit_list.mapInArrow(spread, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect(), key=lambda r: r["at"])
        sums_of = np.array([r["s"] for r in rows]) / n
        centre = sums_of[good * good :]
        out.identity_error = float(np.abs(sums_of[: good * good].reshape(good, good) - np.outer(centre, centre) - np.eye(good)).max())
    return out


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = 4, scale: int = 256) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): `most` rows for each vector of df.

    Vectors that are null or hold null or non-finite entries are left out. Entries become x = floor(scale * entry).
    Each distinct x counts once in n, in the mean and in the components, which are numbered from 1 by falling
    variance; a component's largest entry is positive. deviation is the sum over entries of (n * x - S) ** 2, with S
    the entries' sums, exactly; null where it doesn't fit a long. explained is the component's share of the variance;
    identity_error the largest difference between the whitened vectors' covariance and the identity.

    A component without variance (fewer distinct vectors than components, constant entries) has null for whitened and
    0 for explained, or null if nothing varies; identity_error then is over the others, null without any. There are
    as many components as entries, if those are fewer than `most`. The fit is over vectors of the most frequent length
    (of the distinct ones; of equally frequent lengths the greatest); others get their rows with null for deviation and
    whitened. Rows that come twice, or without key, get their rows each; without usable rows, or if the usable ones
    are mostly without entries, there is no row. Other columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`")
    own = df.select(F.col(f"`{key}`").alias("key"), v.alias("v")).where(usable(F.col("v"))).select("key", whole_entries(F.col("v"), scale).alias("x"))
    kind = df.schema[key].dataType.simpleString()
    fitted = fit(own, most)
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or fitted.dims == 0:
        return spark.createDataFrame([], f"`{key}` {kind}, {out}")
    sent = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        sums, squares = w.sums, sum(s * s for s in w.sums)
        most_sum = max(map(abs, sums))
        k = w.components.shape[1]
        for batch in batches:
            fits = pc.equal(pc.list_value_length(batch.column(1)), w.dims)
            other = batch.filter(pc.invert(fits))
            if other.num_rows:
                nulls = pa.ListArray.from_arrays(pa.array(np.arange(other.num_rows + 1) * k, pa.int32()), pa.nulls(other.num_rows * k, pa.float64()))
                yield pa.RecordBatch.from_arrays([other.column(0), pa.nulls(other.num_rows, pa.int64()), nulls], ["key", "deviation", "w"])
            batch = batch.filter(fits)
            x = _matrix(batch.column(1), w.dims)
            top = float(np.abs(x.astype(float)).max(initial=0.0))
            # In whole numbers of any size where 64 bits may not do.
            exact = x if w.dims * top * max(top, most_sum) < 2**62 else x.astype(object)
            own, cross = (exact * exact).sum(1).tolist(), (exact * np.array(sums, exact.dtype)).sum(1).tolist()
            deviation = [w.n * w.n * a - 2 * w.n * b + squares for a, b in zip(own, cross)]
            deviation = pa.array([e if e < 2**63 else None for e in deviation], pa.int64())
            values = w.whitened(x)
            flat = pa.array(values.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), flat)], ["key", "deviation", "w"])

    rows = own.mapInArrow(run, f"key {kind}, deviation long, w array<double>")
    explained = [float(v / fitted.trace) if fitted.trace > 0 else None for v in fitted.variances]
    shares = F.array(*(F.lit(e).cast("double") for e in explained))
    error = F.lit(fitted.identity_error).cast("double")
    return rows.select("key", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), error.alias("identity_error"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
