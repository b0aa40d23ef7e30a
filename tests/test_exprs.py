"""Scalar functions, sequences and tables that no query of the catalog covers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import exprs, kernels
from pulsegrid.operators import info, points, spectral, stats
from pulsegrid.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert value(spark, exprs.inverse_fisherz(exprs.fisherz(F.lit(0.3)))) == pytest.approx(0.3)
    assert value(spark, exprs.plv_to_ppc(F.lit(0.5), F.lit(10))) == pytest.approx((10 * 0.25 - 1) / 9)
    assert value(spark, exprs.div(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, exprs.gaussian(F.lit(1.0), 1.0, 2.0, 3.0, 0.5)) == pytest.approx(3.5)
    point = F.array(F.lit(1.0), F.lit(2.0))
    cov = [[2.0, 0.5], [0.5, 1.0]]
    d = np.array([1.0, 2.0]) - [0.5, 1.0]
    assert value(spark, exprs.gaussian_nd(point, [0.5, 1.0], kernels.precision(covariance=cov))) == pytest.approx(math.exp(-0.5 * d @ np.linalg.inv(cov) @ d))
    assert kernels.precision(width=[2.0, 1.0]) == [[0.25, 0.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        kernels.precision(covariance=[[1.0, 2.0], [2.0, 1.0]])
    assert value(spark, exprs.wavelet_frequency_width(F.lit(30.0))) == pytest.approx(10.0)
    assert value(spark, exprs.wavelet_time_width(F.lit(30.0))) == pytest.approx(2 / (2 * math.pi * 5))
    assert value(spark, exprs.wavelet_edge_extent(F.lit(10.0))) == pytest.approx(math.sqrt(2) * (6 + math.sqrt(38)) / (4 * math.pi) / 10)
    assert value(spark, exprs.entropy(F.lit(0.5))) == 0.5 and value(spark, exprs.entropy(F.lit(0.0))) == 0.0
    with pytest.raises(ValueError):
        exprs.complex_to_spec_type("nonsense")


def test_arrays(spark):
    a = F.array(*(F.lit(x) for x in (3, 1, 3, 2)))
    assert value(spark, exprs.unsorted_unique(a)) == [3, 1, 2]
    assert value(spark, exprs.remove_buffer(a, 1)) == [1, 3] and value(spark, exprs.remove_buffer(a, 2)) == []
    assert value(spark, exprs.iarange(1, 9, 3)) == [1, 4, 7] and value(spark, exprs.iarange(5, 1, -2)) == [5, 3, 1]
    assert value(spark, exprs.all_subsets(F.array(F.lit(1), F.lit(2)), empty=True)) == [[], [1], [2], [1, 2]]
    assert value(spark, exprs.all_subsets(F.array(F.lit(1), F.lit(2)), full=False)) == [[1], [2]]
    assert value(spark, exprs.object_array_compare(a, a)) == [True] * 4 and value(spark, exprs.object_array_compare(a, F.array(F.lit(3)))) is None
    assert value(spark, exprs.object_array_equal(a, a))
    assert value(spark, exprs.convert_string(F.lit("ab".encode("utf-16-le")))) == "ab"
    kept, mask = points.select_in_arrays("t", 0.5, 1.0)
    r = spark.createDataFrame([([0.2, 0.5, 0.9, 1.0],)], "t array<double>").select(kept.alias("k"), mask.alias("m")).first()
    assert r.k == [0.5, 0.9] and r.m == [False, True, True, False]


def test_windows_at_events(spark):
    d = spark.createDataFrame([(0, [float(k) for k in range(100)])], "trial int, samples array<double>")
    e = spark.createDataFrame([(0, 0.25), (0, 0.95)], "trial int, onset double")
    got = spectral.cut_windows(d, ["trial"], e, 100.0, (-0.05, 0.1)).collect()
    assert len(got) == 1 and got[0].samples == [float(k) for k in range(20, 36)]


def test_tables(spark, tmp_path):
    assert {"events", "lineitem"} <= {r.variable for r in tables.variables(spark, "/root/testdata/sf0.001").collect()}
    listed = {r.variable: (r.n_rows, r.n_columns) for r in tables.described(spark, "/root/testdata/sf0.001").collect()}
    assert listed["lineitem"][0] == 6000 and listed["orders"] == (1500, 6)
    d = spark.createDataFrame([(1, [1, 2], ["a"])], "k int, x array<int>, y array<string>")
    rows = tables.columns_to_rows(d, ["x", "y"], ["k"])
    assert sorted((r.k, r.x, r.y) for r in rows.collect() if r.y) == [(1, 1, "a")] and rows.count() == 2
    tables.save(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_labels(spark):
    a, b = (spark.createDataFrame([(float(x),) for x in v], "v double") for v in ((1, 2, 3), (4, 5, 6)))
    both = stats.groups_to_labels(a, b)
    assert [g.count() for g in stats.labels_to_groups(both, "label", [0, 1])] == [3, 3]
    assert info.information_of_groups(a, b, method="auroc", value="v", by=[]).first().auroc == 0.0
    assert info.information_of_groups(a, b, method="pev", value="v", by=[], omega=False).first().pev == pytest.approx(100 * 13.5 / 17.5)
    m = stats.condition_apply(both, "v", [], "label", lambda f: f.assign(top=f["v"].max())[["label", "top"]].head(1), schema="label int, top double")
    assert sorted((r.label, r.top) for r in m.collect()) == [(0, 3.0), (1, 6.0)]


def test_own_statistics_merge(spark, monkeypatch):
    """A hot key in several parts, null keys and large whole numbers as keys; every merge order gives the same."""
    monkeypatch.setattr(stats, "MOST_STATES", 1)
    spread = stats.Mergeable(start=lambda: None, update=lambda s, f: (min([f["v"].min(), *(s or ())]), max([f["v"].max(), *(s or ())])), merge=lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), finish=lambda s: s[1] - s[0])
    big = 2**60 + 1
    rows = [(big if k % 3 else None, k % 2 == 0, float(k * k % 101)) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, odd boolean, v double").repartition(7)
    got = {(r.k, r.odd): r.stat for r in stats.condition_apply(df, "v", ["k"], "odd", spread).collect()}
    want = {key: max(x) - min(x) for key in {r[:2] for r in rows} for x in [[r[2] for r in rows if r[:2] == key]]}
    assert got == want
    assert stats.merge_apply(df, "v", [], spread).first().stat == max(r[2] for r in rows) - min(r[2] for r in rows)
    assert stats.merge_apply(df.limit(0), "v", ["k"], spread).count() == 0


def test_rate_by_name(spark):
    e = spark.createDataFrame([(0, 0.1), (0, 0.2)], "unit int, t double")
    assert points.rate(e, ["unit"], "sdf", lims=(0.0, 1.0)).count() == 1001
    with pytest.raises(ValueError):
        points.rate(e, ["unit"], "nonsense")
    assert points.train_arrays(e, ["unit"]).first().times == [0.1, 0.2]
