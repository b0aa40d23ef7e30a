"""Windows, bins, epochs and bands: interval tables and the joins with them.

Interval tables are arguments of an analysis. They are checked to be small before they are broadcast; beyond that, an
interval is entered under the one or two grid cells that it touches on a grid as coarse as its length, and the join is
an equi-join on cells.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import col
from ..session import written
from . import long_series, order

#: Broadcast intervals are compared with every point, so more than these are joined by cells.
MOST_BROADCAST = 100
#: Bounds from here on count as infinite; their intervals lie on one level, whose cells part the points by sign.
_ENDLESS, _TOP = 1e290, 500


def sliding_windows(spark: SparkSession, width: float, lims: tuple[float, float], step: float | None = None, reference: float | None = None, whole: bool = False) -> DataFrame:
    """(win, start, end): windows of width from lims[0] by step (width if None) that end by lims[1].

    With reference, starts lie whole steps from it. whole: bounds are whole numbers, rounded half to even."""
    step = width if step is None else step
    lo, hi = map(float, lims)
    if width <= 0 or step <= 0:
        raise ValueError("width and step must be positive")
    if reference is not None:
        lo = reference - int((reference - lo) / step + 1e-12) * step
    n = max(0, int((hi - width - lo) / step + 1e-12) + 1) if hi - width >= lo - 1e-12 else 0
    i = F.col("id").cast("double")
    fix = F.rint if whole else (lambda c: c)
    return spark.range(n).select(F.col("id").cast("int").alias("win"), fix(lo + i * step).alias("start"), fix(lo + i * step + width).alias("end"))


def interval_cells(start: Column, end: Column) -> Column:
    """Array of (level, cell) structs, one or two, for an interval of any length: cells are 4 ** level long, at least as
    long as the interval, so it touches no third one. Infinite bounds lie on the coarsest level; empty for intervals
    that end before they start, or have null or not-a-number bounds."""
    lo, hi = start.cast("double"), end.cast("double")
    log4 = lambda x: F.log(F.greatest(x, F.lit(1e-290))) / math.log(4.0)
    # Cells finer than 4 ** -20 of the bounds' magnitude would leave the range of whole numbers.
    level = F.greatest(F.ceil(log4(hi - lo) + 1e-9), F.ceil(log4(F.greatest(F.abs(lo), F.abs(hi)))) - 20).cast("int")
    endless = F.greatest(F.abs(lo), F.abs(hi)) >= _ENDLESS
    cell = lambda x, k: F.struct(k.alias("level"), F.floor(x / F.pow(F.lit(4.0), k)).alias("cell"))
    both = F.array(*(F.struct(F.lit(_TOP).alias("level"), F.lit(c).cast("long").alias("cell")) for c in (-1, 0)))
    found = F.when(endless, both).otherwise(F.array_distinct(F.array(cell(lo, level), cell(hi, level))))
    none = lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi) | (hi < lo)
    return F.when(none, F.slice(both, 1, 0)).otherwise(found)


def interval_join(points: DataFrame, at: str | Column, intervals: DataFrame, start: str = "start", end: str = "end", closed: bool = False) -> DataFrame:
    """Each point with each interval that holds it: start <= at < end, or <= end if closed.

    Up to MOST_BROADCAST intervals are broadcast. More are joined by interval_cells(): an interval is one or two rows
    however long it is, and a point one row for each level in use, of which lengths from 1 to 4 ** k take k + 1 (and
    all lengths there are a few hundred)."""
    p, upper = col(at), (F.col(end) >= col(at)) if closed else (F.col(end) > col(at))
    inside = (F.col(start) <= p) & upper
    if intervals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return points.join(F.broadcast(intervals), inside)
    entered = intervals.withColumn("__in", F.explode(interval_cells(F.col(start), F.col(end))))
    right = entered.withColumns({"__level": F.col("__in.level"), "__cell": F.col("__in.cell")}).drop("__in")
    levels = sorted(r[0] for r in right.select("__level").distinct().collect())  # at most a few hundred
    left = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    x = p.cast("double")
    left = left.withColumn("__cell", F.when(F.col("__level") == _TOP, F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")).otherwise(F.floor(x / F.pow(F.lit(4.0), F.col("__level")))))
    return left.join(right, ["__level", "__cell"]).where(inside).drop("__level", "__cell")


def interval_counts(points: DataFrame, at: str, intervals: DataFrame, start: str = "start", end: str = "end", closed: bool = False, out: str = "n") -> DataFrame:
    """intervals with the number of points that each holds, as interval_join() would pair them, without the pairs.

    Points and the intervals' distinct bounds are numbered in one order, and the bounds alone in the same order: a
    bound's places differ by the points before it. Null or not-a-number points and bounds hold nothing."""
    valid = lambda c: c.isNotNull() & ~F.isnan(c)
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)
    # At one place an end that counts as inside comes behind the points, any other bound before them.
    kinds = {start: 0, end: 2 if closed else 0}
    bounds = reduce(DataFrame.unionByName, (intervals.select(number(c).alias("__t"), F.lit(k).alias("__kind")) for c, k in kinds.items()))
    bounds = written(bounds.where(valid(F.col("__t"))).distinct())
    seen = points.select(number(at).alias("__t"), F.lit(1).alias("__kind")).where(valid(F.col("__t")))
    place = lambda df, name: order.numbered(df, [], ["__t", "__kind"], name)
    among = place(bounds.unionByName(seen), "__all").where("__kind <> 1")
    before = among.join(place(bounds, "__own"), ["__t", "__kind"]).withColumn("__before", F.col("__all") - F.col("__own"))
    found = intervals
    for c, k in kinds.items():
        told = before.where(F.col("__kind") == k).select(F.col("__t").alias(f"__at_{c}"), F.col("__before").alias(f"__before_{c}"))
        found = found.withColumn(f"__at_{c}", number(c)).join(told, f"__at_{c}", "left").drop(f"__at_{c}")
    held = F.greatest(F.col(f"__before_{end}") - F.col(f"__before_{start}"), F.lit(0))
    known = F.col(f"__before_{end}").isNotNull() & F.col(f"__before_{start}").isNotNull()
    return found.withColumn(out, F.when(known, held).otherwise(F.lit(0)).cast("long")).drop(*(f"__before_{c}" for c in kinds))


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], at: str, time: str, within: float, bucket: float | None = None) -> DataFrame:
    """Each row of left with the rows of right, of its keys `on`, whose time is the nearest to its `at` (of two equally
    near ones the earlier), if that is at most `within` away. Columns of both; rows without a partner are left out.

    Times of either side, each once, are sorted in buckets of time; right's times also lie in the bucket beside theirs
    if they are within reach of it, so no bucket looks into another. Rows that share a time, however many, and the
    other columns are joined afterwards. Null times or keys meet nothing."""
    reach = within * (1 + 1e-9)
    size = bucket or 256.0 * within
    if not (within > 0 and size >= within):
        raise ValueError("within must be positive, and bucket at least as long")
    asked = left.where(F.col(at).isNotNull()).select(*on, F.col(at).cast("double").alias("__t")).distinct().withColumn("__b", F.floor(F.col("__t") / size))
    known = right.where(F.col(time).isNotNull()).select(*on, F.col(time).cast("double").alias("__t")).distinct()
    known = known.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__t") - reach) / size), F.floor((F.col("__t") + reach) / size))))
    both = known.select(*on, "__b", "__t", F.col("__t").alias("__s"), F.lit(0).alias("__q")).unionByName(asked.select(*on, "__b", "__t", F.lit(None).cast("double").alias("__s"), F.lit(1).alias("__q")))
    w = Window.partitionBy(*on, "__b")
    last = lambda *order: F.last("__s", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__before", last("__t", "__q")).withColumn("__after", last(F.desc("__t"), "__q")).where("__q = 1")
    off = lambda c: F.coalesce(F.abs(F.col(c) - F.col("__t")), F.lit(float("inf")))
    best = F.when(off("__before") <= off("__after"), F.col("__before")).otherwise(F.col("__after"))
    pairs = found.where(F.least(off("__before"), off("__after")) <= reach).select(*on, "__t", best.alias("__s"))
    placed = left.withColumn("__t", F.col(at).cast("double")).join(pairs, [*on, "__t"]).drop("__t")
    return placed.join(right.withColumn("__s", F.col(time).cast("double")), [*on, "__s"]).drop("__s")


def pool_intervals(df: DataFrame, value: str, at: str, intervals: DataFrame, by: list[str], name: str = "name", func: str = "mean") -> DataFrame:
    """Mean or sum of value over each closed interval [low, high] of intervals(name, low, high)."""
    if func not in ("mean", "sum"):
        raise ValueError("func must be mean or sum")
    joined = interval_join(df, at, intervals, "low", "high", closed=True)
    return joined.groupBy(*by, name).agg((F.avg if func == "mean" else F.sum)(value).alias(value))


pool_freq_bands = pool_time_epochs = pool_intervals


def interp1(df: DataFrame, x: str, y: str, queries: DataFrame, by: list[str], at: str, kind: str = "linear") -> DataFrame:
    """queries (by..., at) with y interpolated between the points of df; null outside them.

    linear: points and queries are one sorted sequence for a series; each query looks back and ahead in it. cubic: a
    spline through a series' points, of several with one x that of the least y; with fewer than four points all are
    null. Series of more rows than order.SMALL are taken by blocks (long_series.interp1), with the same results."""
    if kind in ("linear", "cubic") and max(order.largest(df, by), order.largest(queries, by)) > order.SMALL:
        return long_series.interp1(df, x, y, queries, by, at, kind)
    if kind == "cubic":
        return _interp_cubic(df, x, y, queries, by, at)
    if kind != "linear":
        raise ValueError("kind must be linear or cubic")
    both = df.select(*by, F.col(x).alias(at), F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(0).alias("__q")).unionByName(queries.select(*by, at, F.lit(None).cast("double").alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__q")))
    w = Window.partitionBy(*by).orderBy(at, "__q")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by).orderBy(F.desc(at), "__q").rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda c, f: F.last(c, ignorenulls=True).over(f)
    s = both.select(*by, at, "__q", pick("__x", back).alias("x0"), pick("__y", back).alias("y0"), pick("__x", ahead).alias("x1"), pick("__y", ahead).alias("y1")).where("__q = 1")
    line = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0"))).when(F.col("x1") == F.col("x0"), F.col("y0"))
    return s.select(*by, at, line.alias(y))


def _interp_cubic(df: DataFrame, x: str, y: str, queries: DataFrame, by: list[str], at: str) -> DataFrame:
    def spline(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        p = points.dropna(subset=[x, y]).sort_values([x, y]).drop_duplicates(x)
        got = kernels.cubic_spline(p[x].to_numpy(float), p[y].to_numpy(float), wanted[at].to_numpy(float)) if len(p) > 3 else np.full(len(wanted), np.nan)
        return wanted.assign(**{y: pd.Series(got, index=wanted.index).astype(object).where(~np.isnan(got), None)})

    schema = ", ".join([*(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in [*by, at]), f"`{y}` double"])
    return df.select(*by, x, y).groupBy(*by).cogroup(queries.select(*by, at).groupBy(*by)).applyInPandas(spline, schema)


def runs(df: DataFrame, flag: Column, by: list[str], order: str) -> DataFrame:
    """(by..., first, last, n, touches_end): unbroken runs of rows where flag holds; order counts up by one."""
    w = Window.partitionBy(*by).orderBy(order)
    last = df.groupBy(*by).agg(F.max(order).alias("__last"))
    on = df.where(flag).select(*by, order).withColumn("__run", F.col(order) - F.row_number().over(w))
    r = on.groupBy(*by, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")
    return r.join(last, by).withColumn("touches_end", F.col("last") == F.col("__last")).drop("__last")


def value_before(df: DataFrame, value: str, by: list[str], order: str, bucket: float, out: str) -> DataFrame:
    """df with the value of the row before in its series, as lag() gives it, where one series may hold much of all rows.

    Rows are sorted within buckets of the order column only; the first row of a bucket gets the last value of the
    bucket before, from a table with one row for each bucket in use."""
    b = df.withColumn("__b", F.floor(F.col(order) / bucket))
    last = b.groupBy(*by, "__b").agg(F.max_by(value, order).alias("__last"))
    last = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b"))).drop("__last")
    inside = b.withColumn("__own", F.lag(value).over(Window.partitionBy(*by, "__b").orderBy(order))).withColumn("__first", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order)) == 1)
    return inside.join(last, [*by, "__b"]).withColumn(out, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__own"))).drop("__b", "__own", "__first", "__carried")
