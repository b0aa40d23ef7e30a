"""What plots show, as tables: drawing is left to any plotting library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import numbered


def lines(df: DataFrame, x: str, value: str, by: list[str], error: str = "sem") -> DataFrame:
    """(by..., x, y, low, high): means over rows with a ribbon of a standard error or deviation."""
    if error not in ("sem", "sd"):
        raise ValueError("error must be sem or sd")
    sd = F.stddev_samp(value)
    half = sd if error == "sd" else sd / F.sqrt(F.count(value))
    s = df.groupBy(*by, x).agg(F.avg(value).alias("y"), half.alias("half"))
    return s.select(*by, x, "y", (F.col("y") - F.col("half")).alias("low"), (F.col("y") + F.col("half")).alias("high"))


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.avg(value).alias("value"))


def stacked(df: DataFrame, line: str, x: str, value: str, scale: float = 1.5) -> DataFrame:
    """(line, x, y): lines one above the other in order of `line`, scaled by the greatest absolute value."""
    rank = numbered(df.select(line).distinct(), [], [line], "__at")
    top = df.agg(F.max(F.abs(F.col(value))).alias("__top"))
    y = F.col("__at") + scale * F.try_divide(F.col(value), F.col("__top"))
    return df.join(rank, line).crossJoin(F.broadcast(top)).select(line, x, y.alias("y"))  # top is one row


def raster(events: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """(train, t): events with their train numbered from 0 in order of its keys."""
    n = numbered(events.select(*by).distinct(), [], by, "train")
    return events.join(n, by).select("train", t)


def mean_waveforms(df: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """(by..., i, mean, sd)."""
    long = df.select(*by, F.posexplode(samples).alias("i", "x"))
    return long.groupBy(*by, "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def waveform_histogram(df: DataFrame, low: float, high: float, bins: int = 20, samples: str = "samples") -> DataFrame:
    """(i, bin, n): how often samples at a place fall in each of equal bins from low to high."""
    long = df.select(F.posexplode(samples).alias("i", "x")).where(F.col("x").between(low, high))
    at = F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return long.groupBy("i", at.alias("bin")).agg(F.count("*").alias("n"))
