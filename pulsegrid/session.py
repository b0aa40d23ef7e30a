"""A session with the settings that the operators assume."""

from __future__ import annotations

import os
import posixpath
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffles of an action are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "pulsegrid", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; conf's keys have __ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def attach(spark: SparkSession) -> SparkSession:
    """Sends this package's source to the executors, once per application, so that they needn't have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_pulsegrid_sent", False):
        package = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(), "pulsegrid_src.zip")
        with zipfile.ZipFile(out, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(out)
        sc._pulsegrid_sent = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share. Where that is unset, a temporary one, but
    only if driver and executors are one process; on a cluster it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = getattr(sc, "_pulsegrid_shared", None) or "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        sc._pulsegrid_shared = root
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: later reads don't recompute it, and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: for rounds, whose size estimates would else multiply.

    What was shuffled for it goes with the write, instead of when the driver collects its garbage. Long integers that
    rise are stored as their steps."""
    conf = df.sparkSession.conf
    path = posixpath.join(shared_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.writer.version", "v2").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)

def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
            if re.fullmatch(r"table-[0-9a-f]{32}", posixpath.basename(folder)):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
