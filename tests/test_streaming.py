from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsegrid.streaming import events as S


def _stream(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "unit int, ts timestamp").coalesce(1).write.parquet(folder)
    return spark.readStream.schema("unit int, ts timestamp").parquet(folder)


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_isi(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(u, t0 + timedelta(seconds=s)) for u, s in ((0, 0), (0, 5), (0, 2), (1, 7))]
    got = _run(spark, S.isi(_stream(spark, tmp_path, rows), "unit"), "isi_stream")
    assert sorted((r.unit, r.isi) for r in got) == [(0, 2.0), (0, 3.0)]


def test_bins(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(0, t0 + timedelta(seconds=s)) for s in (0, 30, 61, 200)]
    got = _run(spark, S.bin_counts(_stream(spark, tmp_path, rows), ["unit"], "1 minute", late="0 seconds"), "bins_stream", "update")
    assert sorted(r.n for r in got) == [1, 1, 2]


def test_bursts(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(0, t0 + timedelta(seconds=s)) for s in (0, 3, 6, 100)]
    got = _run(spark, S.bursts(_stream(spark, tmp_path, rows), ["unit"], "10 seconds", late="0 seconds").where(F.col("n") > 1), "bursts_stream")
    assert [r.n for r in got] == [3]
