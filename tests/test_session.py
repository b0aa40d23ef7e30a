"""Tables in the shared folder."""

import glob
import os
from decimal import Decimal

from pyspark.sql import functions as F

from pulsegrid.operators import order
from pulsegrid.session import CLEANUP, written


def shuffles(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in (str(blocks.getAllFiles().apply(i)) for i in range(blocks.getAllFiles().size())) if "shuffle_" in f}


def folder(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file://")


def test_shuffles_go_with_the_write(spark):
    before, set_to = shuffles(spark), spark.conf.get(CLEANUP)
    got = written(spark.range(1000).repartition(7, "id"))
    assert not shuffles(spark) - before
    assert got.count() == 1000 and spark.conf.get(CLEANUP) == set_to


def test_tables_keep_types_and_nulls(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 2 == 0).alias("b"), F.col("id").cast("decimal(30,3)").alias("d"), F.col("id").cast("decimal(9,2)").alias("e"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"),
        F.unhex(F.hex("id")).alias("x"), F.timestamp_seconds("id").alias("t"), F.array("id", F.lit(None)).alias("a"), F.create_map(F.lit("k"), F.col("id") / 7).alias("m"), F.col("id").cast("float").alias("f"), F.expr("date_add(DATE '2020-01-01', id::int)").alias("day"),
    )
    assert sorted(map(str, written(df).collect())) == sorted(map(str, df.collect()))
    assert written(df).dtypes == df.dtypes and isinstance(written(df).first().d, Decimal)


def test_numbers_take_little_room(spark, monkeypatch):
    """A place is a step from the one before it, and what only orders rows isn't stored."""
    monkeypatch.setattr(order, "SMALL", 10)
    df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("name"), (F.col("id") % 2).alias("x"))
    got = order.numbered(df, [], ["name"], "i", keep=["x"])
    assert got.columns == ["x", "i"] and got.count() == 200_000
    assert sum(map(os.path.getsize, glob.glob(f"{folder(got)}/*.parquet"))) < 2 * 200_000
