"""Point processes: event times by train. Times are seconds; a train is named by its key columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats
from .windows import interval_join, sliding_windows, value_before


def select_time_range(df: DataFrame, low: float, high: float, t: str = "t", closed: bool = False) -> DataFrame:
    """Events in [low, high), or [low, high] for samples of a grid."""
    return df.where((F.col(t) >= low) & ((F.col(t) <= high) if closed else (F.col(t) < high)))


def select_in_arrays(times: str, low: float, high: float) -> tuple[Column, Column]:
    """For times in an array: those in [low, high), and for each whether it is."""
    inside = lambda x: (x >= low) & (x < high)
    return F.filter(times, inside), F.transform(times, inside)


def realign(df: DataFrame, align: DataFrame, on: list[str], t: str = "t", at: str = "align") -> DataFrame:
    """Times less the align time of their trial; trials without one are left out."""
    return df.join(align.select(*on, at), on).withColumn(t, F.col(t) - F.col(at)).drop(at)


def realign_on_event(df: DataFrame, trials: DataFrame, event: str, on: list[str], t: str = "t") -> DataFrame:
    return realign(df, trials.select(*on, F.col(event).alias("align")), on, t)


def realign_samples(df: DataFrame, align: DataFrame, on: list[str], time_range: tuple[float, float], fs: float, t0: float = 0.0, index: str = "i") -> DataFrame:
    """Samples from round((align - t0) * fs) + round(range * fs), both ends included, renumbered from 0.

    Raises if a trial's samples don't cover the range. Rounding is half to even."""
    low, high = (int(round(x * fs)) for x in time_range)
    zero = F.rint((F.col("align") - t0) * fs).cast("long")
    own = df.join(align, on)
    cut = own.withColumn("__at", F.col(index) - zero).where(F.col("__at").between(low, high))
    whole = align.join(cut.groupBy(*on).agg(F.countDistinct("__at").alias("__n")), on, "left").where(F.coalesce("__n", F.lit(0)) < high - low + 1)
    if whole.limit(1).count():
        raise ValueError("the time range reaches over the data of some trial")
    return cut.withColumn(index, F.col("__at") - low).drop("__at", "align")


def realign_samples_on_event(df: DataFrame, trials: DataFrame, event: str, on: list[str], time_range: tuple[float, float], fs: float, **options) -> DataFrame:
    """realign_samples() on a column of trials."""
    return realign_samples(df, trials.select(*on, F.col(event).alias("align")), on, time_range, fs, **options)


def cut_trials(df: DataFrame, trials: DataFrame, t: str = "t", ref: str | None = None) -> DataFrame:
    """Events with each trial (trial, start, end) whose [start, end) holds them, less the trial's ref time."""
    cut = interval_join(df, t, trials)
    return (cut.withColumn(t, F.col(t) - F.col(ref)).drop(ref) if ref else cut).drop("start", "end")


def cut_trial_samples(df: DataFrame, trials: DataFrame, fs: float, index: str = "i") -> DataFrame:
    """Samples round(start * fs) to round(end * fs), both included, renumbered from 0 in each trial."""
    whole = trials.withColumn("start", F.rint(F.col("start") * fs)).withColumn("end", F.rint(F.col("end") * fs))
    cut = interval_join(df, index, whole, closed=True)
    return cut.withColumn(index, (F.col(index) - F.col("start")).cast("long")).drop("start", "end")


def pool_units(df: DataFrame, electrodes: DataFrame, by: list[str], unit: str = "unit", electrode: str = "electrode") -> DataFrame:
    """Events under their unit's electrode. Rates and grids: pool_rates, pool_grids."""
    return df.join(electrodes.select(unit, electrode), unit).drop(unit)


def pool_rates(df: DataFrame, electrodes: DataFrame, by: list[str], value: str, unit: str = "unit", electrode: str = "electrode") -> DataFrame:
    """Sums of rates over the units of an electrode."""
    return pool_units(df, electrodes, by, unit, electrode).groupBy(*by, electrode).agg(F.sum(value).alias(value))


def pool_grids(df: DataFrame, electrodes: DataFrame, by: list[str], flag: str, unit: str = "unit", electrode: str = "electrode") -> DataFrame:
    return pool_units(df, electrodes, by, unit, electrode).groupBy(*by, electrode).agg(F.bool_or(flag).alias(flag))


def train_arrays(df: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """(by..., times): each train's times in one sorted array; a train has to fit in a row."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(t)).alias("times"))


def isi(df: DataFrame, by: list[str], t: str = "t", out: str = "isi", bucket: float | None = None) -> DataFrame:
    """Intervals between successive events of a train; its first event has none.

    A train is sorted in one task. With bucket, in seconds, tasks sort a train's buckets instead: for trains that hold
    much of all events."""
    if bucket:
        before = value_before(df, t, by, t, bucket, "__before")
        return before.where("__before IS NOT NULL").withColumn(out, F.col(t) - F.col("__before")).drop("__before")
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(t))
    return df.withColumn(out, gap).where(F.col(out).isNotNull())


interspike_interval = isi


def isi_stats(intervals: DataFrame, stat: str, by: list[str], pool_over: list[str] = (), order: str = "t", value: str = "isi", crit: float = 0.02) -> DataFrame:
    """(by less pool_over..., stat): fano, cv, cv2, lv or burst_fract. Order-dependent ones can't be pooled."""
    keys = [c for c in by if c not in pool_over]
    if stat in ("cv2", "lv"):
        if pool_over:
            raise ValueError(f"{stat} depends on the order within a train, and can't be pooled over trains")
        return stats.local_variation(intervals, value, by, [order]).select(*by, stat)
    made = {"fano": stats.fano, "cv": stats.cv, "burst_fract": lambda c: stats.burst_fract(c, crit)}
    if stat not in made:
        raise ValueError(f"unknown stat {stat!r}")
    return intervals.groupBy(*keys).agg(made[stat](value).alias(stat))


def rate_stats(rates: DataFrame, stat: str, by: list[str], value: str = "rate") -> DataFrame:
    """(by..., stat): fano or cv of rates or counts."""
    if stat not in ("fano", "cv"):
        raise ValueError(f"unknown stat {stat!r}")
    return rates.groupBy(*by).agg((stats.fano if stat == "fano" else stats.cv)(value).alias(stat))


def bin_rate(df: DataFrame, by: list[str], trains: DataFrame | None = None, lims: tuple[float, float] = (0.0, 1.0), width: float = 0.05, step: float | None = None, bins: DataFrame | None = None, output: str = "rate", t: str = "t") -> DataFrame:
    """(by..., win, start, end, rate | count | bool): events of each train in each bin, zeros included.

    Bins side by side (no step, no bins) take floor arithmetic and no join; the last one includes its right end.
    Others, which may overlap, are [start, end) each and take an interval join. trains names all trains, those
    without events too (those of df if None)."""
    if output not in ("rate", "count", "bool"):
        raise ValueError("output must be rate, count or bool")
    spark = df.sparkSession
    if bins is None and (step is None or step == width):
        table, n = None, int((lims[1] - lims[0]) / width + 1e-9)
        at = F.floor((F.col(t) - lims[0]) / width + 1e-9)
        top = lims[0] + n * width
        inside = df.where((F.col(t) >= lims[0]) & (F.col(t) <= top))
        counted = inside.groupBy(*by, F.least(at, F.lit(n - 1)).cast("int").alias("win")).agg(F.count("*").alias("n"))
    else:
        table = bins if bins is not None else sliding_windows(spark, width, lims, step)
        counted = interval_join(df, t, table).groupBy(*by, "win").agg(F.count("*").alias("n"))
    named = (df if trains is None else trains).select(*by).distinct()
    if table is None:  # bins follow from their number
        low = lims[0] + F.col("win").cast("double") * width
        every = named.withColumn("win", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else named.withColumn("win", F.lit(0)).limit(0)
        every = every.withColumn("start", low).withColumn("end", low + width)
    else:  # a row for each train and bin is what is asked for; the table is an argument, broadcast if it is small
        small = table.limit(MOST_BINS + 1).count() <= MOST_BINS
        every = named.crossJoin(F.broadcast(table) if small else table)
    filled = every.join(counted, [*by, "win"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = {"count": F.col("n"), "bool": F.col("n") > 0, "rate": F.col("n") / (F.col("end") - F.col("start"))}[output]
    return filled.select(*by, "win", "start", "end", value.alias(output))


#: Tables of bins of up to so many rows are broadcast.
MOST_BINS = 100_000
psth = bin_rate


def _bell(kind: str | Sequence[float] | Callable[[np.ndarray], np.ndarray], width: float, dt: float) -> np.ndarray:
    """A kernel's values at steps of dt, an odd number of them, whose sum times dt is 1."""
    if callable(kind) or kind == "gaussian":
        x = np.arange(-math.floor(3 * width / dt + 1e-9), math.floor(3 * width / dt + 1e-9) + 1) * dt
        k = np.asarray(kind(x), float) if callable(kind) else np.exp(-0.5 * (x / width) ** 2)
    elif isinstance(kind, str):
        if kind != "hanning":
            raise ValueError(f"unknown kernel {kind!r}: gaussian, hanning, values or a function of time")
        k = np.hanning(int(round(width / dt)) | 1)
    else:
        k = np.asarray(kind, float)
    if k.ndim != 1 or len(k) % 2 == 0:
        raise ValueError("a kernel needs an odd number of values")
    return k / (k.sum() * dt)


def density(df: DataFrame, by: list[str], lims: tuple[float, float], width: float = 0.05, step: float = 0.001, kernel: str | Sequence[float] | Callable[[np.ndarray], np.ndarray] = "gaussian", trains: DataFrame | None = None, t: str = "t", dt: float = 0.001) -> DataFrame:
    """(by..., time, rate): event density on a grid, zero for trains without events.

    Events go to a grid of dt, with counts summed before the shuffle. Each cell in use adds to the grid points that its
    kernel (gaussian, hanning, an odd number of values at steps of dt, or a function of time over three widths to
    either side) reaches, as rows that are summed by train and point, so a train isn't gathered anywhere."""
    k = _bell(kernel, width, dt)
    pad, n, every = len(k) // 2, int(round((lims[1] - lims[0]) / dt)) + 1, round(step / dt)
    at = F.rint((F.col(t) - lims[0]) / dt).cast("int")
    cells = df.groupBy(*by, at.alias("__at")).agg(F.count("*").alias("__n")).where(F.col("__at").between(-pad, n - 1 + pad))
    low, high = F.ceil((F.col("__at") - pad) / every), F.floor((F.col("__at") + pad) / every)
    low, high = F.greatest(low.cast("int"), F.lit(0)), F.least(high.cast("int"), F.lit((n - 1) // every))
    reached = cells.where(low <= high).withColumn("__point", F.explode(F.sequence(low, high)))
    weights = F.array(*(F.lit(float(x)) for x in k))  # as many as the kernel has
    part = F.col("__n") * F.get(weights, F.col("__point") * every - F.col("__at") + pad)
    sums = reached.groupBy(*by, "__point").agg(F.sum(part).alias("rate"))
    named = (df if trains is None else trains).select(*by).distinct()
    points = named.withColumn("__point", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // every))))
    rate = F.greatest(F.coalesce("rate", F.lit(0.0)), F.lit(0.0))
    return points.join(sums, [*by, "__point"], "left").select(*by, (lims[0] + F.col("__point") * every * dt).alias("time"), rate.alias("rate"))


def rate(df: DataFrame, by: list[str], method: str = "bin", **options) -> DataFrame:
    if method in ("bin", "bins", "bin_rate", "psth"):
        return bin_rate(df, by, **options)
    if method in ("density", "spike_density", "sdf"):
        return density(df, by, **options)
    raise ValueError(f"unknown method {method!r}")


def times_to_bool(df: DataFrame, by: list[str], lims: tuple[float, float], width: float = 0.001, trains: DataFrame | None = None, t: str = "t") -> DataFrame:
    """(by..., i, t, spike): a grid with a point for each width, true where an event is nearest to it."""
    n = int(round((lims[1] - lims[0]) / width)) + 1
    at = F.rint((F.col(t) - lims[0]) / width).cast("int")
    hit = df.select(*by, at.alias("i")).where(F.col("i").between(0, n - 1)).distinct().withColumn("spike", F.lit(True))
    named = (df if trains is None else trains).select(*by).distinct()
    every = named.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", lims[0] + F.col("i") * width)
    return every.join(hit, [*by, "i"], "left").withColumn("spike", F.coalesce("spike", F.lit(False)))


def bool_to_times(df: DataFrame, by: list[str], flag: str = "spike", t: str = "t") -> DataFrame:
    return df.where(flag).select(*by, t)
