import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import order, points, windows


@pytest.fixture(scope="module")
def events(spark):
    rows = [(0, 0.0), (0, 0.05), (0, 0.1), (0, 1.0), (1, 0.33)]
    return spark.createDataFrame(rows, "unit int, t double")


def test_bins(spark, events):
    units = spark.createDataFrame([(0,), (1,), (2,)], "unit int")
    b = points.bin_rate(events, ["unit"], units, (0.0, 1.0), 0.1, output="count")
    n = {(r.unit, r.win): r["count"] for r in b.collect()}
    assert len(n) == 30 and n[0, 0] == 2 and n[0, 1] == 1 and n[0, 9] == 1 and n[1, 3] == 1 and n[2, 5] == 0
    w = windows.sliding_windows(spark, 0.5, (0.0, 1.0), 0.25)
    assert [(r.start, r.end) for r in w.orderBy("win").collect()] == [(0.0, 0.5), (0.25, 0.75), (0.5, 1.0)]
    b = points.bin_rate(events, ["unit"], units, (0.0, 1.0), 0.5, step=0.25, output="count")
    assert {(r.unit, r.win): r["count"] for r in b.collect()}[0, 0] == 3
    with pytest.raises(TypeError):
        points.bin_rate(events, ["unit"], nonsense=1)


def test_interval_join_paths_agree(spark, events, monkeypatch):
    t = spark.createDataFrame([(k, k * 0.07, k * 0.07 + 0.2) for k in range(12)], "win int, start double, end double")
    small = sorted(windows.interval_join(events, "t", t).select("unit", "t", "win").collect())
    monkeypatch.setattr(windows, "MOST_BROADCAST", 3)
    assert sorted(windows.interval_join(events, "t", t).select("unit", "t", "win").collect()) == small


def test_intervals_of_many_scales(spark, monkeypatch):
    """Lengths from 1 to 1e7, empty and infinite ones: an interval is at most two rows, and meets what it holds."""
    monkeypatch.setattr(windows, "MOST_BROADCAST", 3)
    rng = np.random.default_rng(5)
    length = 10 ** rng.uniform(0, 7, 300)
    start = rng.uniform(-1e7, 1e7, 300)
    spans = [(k, float(a), float(a + n)) for k, (a, n) in enumerate(zip(start, length))]
    spans += [(300, 64.0, 64.0), (301, float("-inf"), 0.0), (302, -3.0, float("inf")), (303, 5.0, 4.0), (304, None, 4.0), (305, 0.0, 4.0**8), (306, -(4.0**8), float("inf")), (307, float("-inf"), float("inf"))]
    at = [float(x) for x in rng.uniform(-1e7, 1e7, 400)] + [64.0, 0.0, -0.0, 4.0**8, -3.0, -5.0, *(float(x) for x in start[:50]), *(x[2] for x in spans[:50])]
    t = spark.createDataFrame(spans, "win int, start double, end double")
    p = spark.createDataFrame(list(enumerate(at)), "i int, t double")
    rows = t.select("win", F.size(windows.interval_cells(F.col("start"), F.col("end"))).alias("n")).collect()
    assert {r.n for r in rows} == {0, 1, 2} and {r.win for r in rows if r.n == 0} == {303, 304}
    for closed in (False, True):
        got = sorted((r.i, r.win) for r in windows.interval_join(p, "t", t, closed=closed).collect())
        want = [(i, k) for i, x in enumerate(at) for k, a, b in spans if a is not None and a <= x and (x <= b if closed else x < b)]
        assert got == sorted(want) and len(got) == len(set(got))


def test_round_trip_and_isi(events):
    g = points.times_to_bool(events, ["unit"], (0.0, 1.0), 0.01)
    back = sorted((r.unit, round(r.t, 9)) for r in points.bool_to_times(g, ["unit"]).collect())
    assert back == sorted((r.unit, r.t) for r in events.collect())
    assert [round(r.isi, 9) for r in points.isi(events, ["unit"]).orderBy("unit", "t").collect()] == [0.05, 0.05, 0.9]
    with pytest.raises(ValueError):
        points.isi_stats(points.isi(events, ["unit"]), "cv2", ["unit"], ["unit"])


def test_density_integrates_to_the_count(spark, events):
    units = spark.createDataFrame([(0,), (1,), (2,)], "unit int")
    inner = events.withColumn("t", F.col("t") + 1.0)
    d = points.density(inner, ["unit"], (0.0, 3.0), 0.05, trains=units)
    total = {r.unit: r.s * 0.001 for r in d.groupBy("unit").agg(F.sum("rate").alias("s")).collect()}
    assert total[0] == pytest.approx(4, abs=0.01) and total[1] == pytest.approx(1, abs=0.01) and total[2] == 0


def test_samples(spark):
    s = spark.createDataFrame([(k, i, float(i)) for k in range(2) for i in range(100)], "trial int, i long, x double")
    a = spark.createDataFrame([(0, 0.3), (1, 0.5)], "trial int, align double")
    r = points.realign_samples(s, a, ["trial"], (-0.1, 0.2), 100.0)
    assert sorted((x.trial, x.i, x.x) for x in r.collect())[0] == (0, 0, 20.0) and r.count() == 62
    with pytest.raises(ValueError):
        points.realign_samples(s, a, ["trial"], (-0.4, 0.2), 100.0)


def test_interp_and_runs(spark):
    d = spark.createDataFrame([(0, 0.0, 0.0), (0, 1.0, 10.0), (0, 3.0, 30.0)], "k int, x double, y double")
    q = spark.createDataFrame([(0, 0.5), (0, 2.0), (0, 1.0), (0, 4.0)], "k int, at double")
    assert {r["at"]: r.y for r in windows.interp1(d, "x", "y", q, ["k"], "at").collect()} == {0.5: 5.0, 2.0: 20.0, 1.0: 10.0, 4.0: None}
    f = spark.createDataFrame([(0, i, i in (1, 2, 5, 6, 7)) for i in range(8)], "k int, i int, on boolean")
    assert sorted((r.first, r.last, r.n, r.touches_end) for r in windows.runs(f, F.col("on"), ["k"], "i").collect()) == [(1, 2, 2, False), (5, 7, 3, True)]


def test_cubic_interpolation(spark):
    """Cubics are their own splines."""
    f = lambda x: 2.0 - x + 0.5 * x**2 - 0.25 * x**3
    xs = [0.0, 0.4, 1.0, 1.7, 2.0, 3.0]
    d = spark.createDataFrame([(0, x, f(x)) for x in xs] + [(1, 0.0, 1.0)], "k int, x double, y double")
    q = spark.createDataFrame([(0, x) for x in (0.0, 0.2, 1.3, 2.9, 3.0, 4.0)] + [(1, 0.0)], "k int, at double")
    got = {(r.k, r["at"]): r.y for r in windows.interp1(d, "x", "y", q, ["k"], "at", "cubic").collect()}
    assert got[0, 4.0] is None and got[1, 0.0] is None
    assert all(got[0, x] == pytest.approx(f(x)) for x in (0.0, 0.2, 1.3, 2.9, 3.0))


def test_other_kernels(spark, events):
    inner = events.withColumn("t", F.col("t") + 1.0)
    for kernel in ("hanning", [1.0, 2.0, 1.0], lambda x: np.exp(-np.abs(x) / 0.02)):
        d = points.density(inner, ["unit"], (0.0, 3.0), 0.05, kernel=kernel)
        assert d.where("unit = 0").agg(F.sum("rate")).first()[0] * 0.001 == pytest.approx(4, abs=0.01)
    with pytest.raises(ValueError):
        points.density(inner, ["unit"], (0.0, 3.0), 0.05, kernel="nonsense")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("small", [32_768, 5])
def test_interval_counts(spark, monkeypatch, closed, small):
    """As many as the pairs, ends, ties, empty and odd intervals included; and no pairs are made."""
    monkeypatch.setattr(order, "SMALL", small)
    inf = float("inf")
    points = [0.0, -0.0, 1.0, 1.0, 1.0, 2.5, 7.0, -3.0, None, float("nan")] + [x / 8 for x in range(-40, 40)]
    spans = [(0.0, 1.0), (0.0, 1.0), (-0.0, 0.0), (1.0, 1.0), (1.0, 2.5), (5.0, 2.0), (-inf, inf), (None, 1.0), (float("nan"), 1.0), (-4.1, 7.0), (8.0, 9.0)]
    p = spark.createDataFrame([(x,) for x in points], "t double")
    s = spark.createDataFrame([(k, *x) for k, x in enumerate(spans)], "k int, start double, end double")
    got = windows.interval_counts(p, "t", s, closed=closed)
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())
    real = [x for x in points if x is not None and x == x]
    want = {k: sum(a <= x and (x <= b if closed else x < b) for x in real) if a is not None else 0 for k, (a, b) in enumerate(spans)}
    assert {r.k: r.n for r in got.collect()} == want
