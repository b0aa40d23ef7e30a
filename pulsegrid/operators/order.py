"""Places of rows in an order, without one task for a series, however long it is."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Rows of a series that may be gathered in one row.
SMALL = 32_768
#: Rows that a task sorts at once: a shuffle has so many partitions, and what a task holds doesn't grow with the table.
ROWS = 1 << 19


def partitions(spark: SparkSession, rows: float) -> int:
    """The partitions to shuffle that many rows into. A number that is asked for isn't coalesced by adaptive execution,
    which goes by compressed bytes: rows of series compress so well that millions of them would be one task's."""
    return max(spark.sparkContext.defaultParallelism, ceil(rows / ROWS))


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(F.broadcast(right))  # without keys, right is one row


def largest(df: DataFrame, by: list[str]) -> int:
    """The number of rows of the largest series."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def gathered(df: DataFrame, by: list[str], order: list[str | Column], cols: list[str], out: str) -> DataFrame:
    """(by..., out): a series' rows as an array of structs of cols, in order. For series known to be small.

    What orders them comes first in the structs while they are sorted, and is left out of them then."""
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{k}") for k, o in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*keys, F.struct(*cols).alias("__row"))))
    return df.groupBy(*by).agg(F.transform(rows, lambda r: r["__row"]).alias(out))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], out: str, most: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with each row's place in its series, from 0, in ascending order (nulls first). Rows that tie get different
    places, in no certain order. keep: the columns beside by that are wanted, if not all.

    Small series are gathered in a row each. Beyond SMALL rows all series are sorted as one by ranges of (by, order): a
    row's place is what the ranges before hold, plus its place in the range, less the first place of its series, from a
    table of a row for each series, whose size tells Spark whether to broadcast it. most: the number of rows of the
    largest series, if it is known."""
    most = largest(df, by) if most is None else most
    keep = [c for c in (df.columns if keep is None else keep) if c not in by]
    if most <= SMALL:
        g = gathered(df, by, order, keep, "__rows")
        return g.select(*by, F.posexplode("__rows").alias(out, "__row")).select(*by, "__row.*", F.col(out).cast("long").alias(out))
    made = {f"__o{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
    names = [*by, *(o if isinstance(o, str) else f"__o{i}" for i, o in enumerate(order))]
    plain = [c for c in df.columns if c in {*names, *keep}]
    named = df.select(*plain, *(o.alias(n) for n, o in made.items()))
    # Within a partition the id counts rows; above 33 bits it has the partition's number.
    n = partitions(df.sparkSession, df.count())
    sorted_ = named.repartitionByRange(n, *names).sortWithinPartitions(*names)
    ids = written(sorted_.select(*by, *keep, F.monotonically_increasing_id().alias("__id")))
    part = F.shiftright("__id", 33)
    held = sorted(ids.groupBy(part.alias("part")).count().collect())  # a row for each partition
    starts, total = {}, 0
    for r in held:
        starts[r["part"]], total = total - (r["part"] << 33), total + r["count"]
    table = df.sparkSession.createDataFrame(list(starts.items()), "__part long, __start long")
    placed = ids.withColumn("__part", part).join(F.broadcast(table), "__part").withColumn(out, F.col("__id") + F.col("__start")).drop("__part", "__start", "__id")
    if not by:
        return placed
    first = written(placed.groupBy(*by).agg(F.min(out).alias("__first")))
    return placed.join(first, by).withColumn(out, F.col(out) - F.col("__first")).drop("__first")
