"""Tables of a folder, and the views of them that the operators work on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def variables(spark: SparkSession, folder: str) -> DataFrame:
    """(variable): the tables of a folder, by their names alone; reads none of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.createDataFrame([(n.removesuffix(".parquet"),) for n in sorted(names)], "variable string")


def described(spark: SparkSession, folder: str) -> DataFrame:
    """(variable, n_rows, n_columns) of a folder's tables; without columns to read, a count takes the files' footers."""
    each = [(r[0], table(spark, folder, r[0])) for r in variables(spark, folder).collect()]  # a row for each table
    counts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("variable"), "n_rows", F.lit(len(t.columns)).alias("n_columns")) for n, t in each]
    return reduce(DataFrame.unionByName, counts, spark.createDataFrame([], "variable string, n_rows long, n_columns int"))


def event_times(events: DataFrame) -> DataFrame:
    """events with t, seconds since the first of January 2024."""
    return events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0)


def save(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    """Writes parquet, orc, json or csv, replacing what is there."""
    df.write.mode("overwrite").format(format).options(**options).save(path)


def columns_to_rows(df: DataFrame, names: list[str], keys: list[str] = ()) -> DataFrame:
    """A struct-of-arrays row as rows: the arrays side by side, the shorter ones filled with null."""
    return df.select(*keys, F.inline(F.arrays_zip(*names)))
