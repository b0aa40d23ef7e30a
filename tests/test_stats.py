"""Published values for small samples that numpy's generator makes from seed 1, and properties."""

import hashlib
import os
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import exprs
from pulsegrid.operators import info, order, resample, stats


def draws(*groups, channels=4):
    """Normal samples by inverse distribution, group by group, after seed 1."""
    np.random.seed(1)
    out = []
    for mean, n in groups:
        u = np.random.rand(n, channels)
        out.append(np.vectorize(NormalDist(mean, 5).inv_cdf)(u))
    return np.concatenate(out)


def frame(spark, x, labels=None):
    rows = [(t, c, float(x[t, c]), *([] if labels is None else [int(v) for v in np.atleast_1d(labels[t])])) for t in range(len(x)) for c in range(x.shape[1])]
    names = ["trial", "channel", "value", "a", "b", "cell"]
    return spark.createDataFrame(rows, names[: len(rows[0])])


@pytest.fixture(scope="module")
def one(spark):
    return frame(spark, draws((10, 10)))


@pytest.fixture(scope="module")
def two(spark):
    return frame(spark, draws((10, 10), (20, 10)), np.repeat([0, 1], 10))


@pytest.fixture(scope="module")
def three(spark):
    return frame(spark, draws((10, 10), (20, 10), (30, 10)), np.repeat([0, 1, 2], 10))


@pytest.fixture(scope="module")
def four(spark):
    cell = np.repeat([0, 1, 2, 3], 10)
    return frame(spark, draws((10, 10), (20, 10), (30, 10), (40, 10)), np.stack([cell % 2, cell // 2, cell], 1))


def by_channel(df, col):
    return [r[col] for r in df.orderBy("channel").collect()]


def test_descriptive(one):
    s = stats.describe(one, ["channel"], fano=stats.fano("value"), cv=stats.cv("value"), t=stats.one_sample_tstat("value"))
    assert by_channel(s, "fano")[0] == pytest.approx(1.95, abs=0.01)
    assert by_channel(s, "cv")[0] == pytest.approx(0.43, abs=0.01)
    assert by_channel(s, "t")[0] == pytest.approx(6.91, abs=0.01)
    v = stats.local_variation(one, "value", ["channel"], ["trial"])
    assert by_channel(v, "cv2")[0] == pytest.approx(0.57, abs=0.01)
    assert by_channel(v, "lv")[0] == pytest.approx(0.31, abs=0.01)


def test_two_samples(two):
    t = stats.two_sample_tstat(two, "value", "a", (0, 1), ["channel"])
    assert by_channel(t, "t")[0] == pytest.approx(-3.39, abs=0.01)
    swapped = stats.two_sample_tstat(two, "value", "a", (1, 0), ["channel"])
    assert by_channel(swapped, "t")[0] == pytest.approx(3.39, abs=0.01)
    pairs = resample.pairs_from_labels(two.withColumn("pair", F.col("trial") % 10), "value", "a", (0, 1), "pair", ["channel"])
    assert by_channel(pairs.groupBy("channel").agg(stats.paired_tstat("x", "y").alias("t")), "t")[0] == pytest.approx(-2.97, abs=0.01)
    assert by_channel(stats.correlation(pairs, "x", "y", ["channel"]), "r")[0] == pytest.approx(-0.33, abs=0.01)
    assert by_channel(stats.rank_correlation(pairs, "x", "y", ["channel"]), "rho")[0] == pytest.approx(-0.36, abs=0.01)


def test_f(three, four):
    assert by_channel(stats.one_way_fstat(three, "value", "a", ["channel"]), "f")[0] > by_channel(stats.one_way_fstat(three, "value", "a", ["channel"], compat=True), "f")[0]
    f = {(r.channel, r.term): r.f for r in stats.two_way_fstat(four, "value", "a", "b", ["channel"], compat=True).collect()}
    assert [f[0, t] for t in ("a", "b", "ab")] == pytest.approx([3.10, 24.91, 0.18], abs=0.01)
    f = {(r.channel, r.term): r.f for r in stats.two_way_fstat(four, "value", "a", "b", ["channel"]).collect()}
    assert [f[0, t] for t in ("a", "b", "ab")] == pytest.approx([18.60, 149.45, 1.11], abs=0.02)


def test_information(two, three, four):
    assert by_channel(info.dprime(two, "value", "a", (0, 1), ["channel"]), "dprime") == pytest.approx([-1.52, -1.56, -3.16, -2.53], abs=0.01)
    assert by_channel(info.auroc(two, "value", "a", (0, 1), ["channel"]), "auroc") == pytest.approx([0.14, 0.13, 0.01, 0.04], abs=0.01)
    assert by_channel(info.anova1(two, "value", "a", ["channel"]), "pev") == pytest.approx([34.43, 35.91, 71.03, 60.72], abs=0.01)
    assert by_channel(info.anova1(two, "value", "a", ["channel"], omega=False), "pev") == pytest.approx([38.99, 40.41, 73.55, 63.94], abs=0.01)
    assert by_channel(info.mutual_info(two, "value", "a", ["channel"], "fd"), "info") == pytest.approx([0.50, 0.42, 0.90, 0.82], abs=0.01)
    assert by_channel(info.anova1(three, "value", "a", ["channel"]), "pev") == pytest.approx([74.30, 81.87, 73.69, 79.15], abs=0.01)
    r = info.regress(two, "value", {"a": ["a"]}, ["channel"])
    assert by_channel(r, "pev") == pytest.approx([34.43, 35.91, 71.03, 60.72], abs=0.01)
    p = info.anova1(two, "value", "a", ["channel"], with_p=True)
    assert by_channel(p, "p") == pytest.approx(by_channel(r, "p"), rel=1e-6)
    with_compat = info.anova2(four, "value", "a", "b", ["channel"], interact=False, compat=True).where("term = 'a' AND channel = 0").first().pev
    assert with_compat == pytest.approx(8.55, abs=0.01)


def test_decode(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, (rng.standard_normal(3) + 2 * (i % 2)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "obs int, label int, x array<double>")
    for decoder in ("lda", "logistic", "svm"):
        assert info.decode(df, "x", "label", "obs", [], decoder).first().accuracy > 0.9


def test_decode_with_folds_of_ones_own(spark):
    """Blocks as folds; with the labels as folds, no held-out label was ever seen."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, i % 3, (rng.standard_normal(2) + 4 * (i % 2)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "obs int, label int, block int, x array<double>")
    for decoder in ("lda", info.kernels.lda):
        got = info.decode(df, "x", "label", "obs", [], decoder, fold="block").first()
        assert got.n == 90 and got.accuracy > 0.9
        assert info.decode(df, "x", "label", "obs", [], decoder, fold="label").first().accuracy == 0.0


def test_decode_lda_gathers_no_series(spark, monkeypatch):
    """The same counts as the kernel over the whole table, which no task gets."""
    rng = np.random.default_rng(1)
    rows = [(s, i + first, "ab"[i % 2], (1000.0 + rng.standard_normal(4) + 0.8 * (i % 2)).tolist()) for s, first in (("x", 0), (None, 150)) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, obs int, label string, x array<double>").repartition(5)
    for by in ([], ["s"]):
        want = {tuple(r[:-2]): (r.accuracy, r.n) for r in info.decode(df, "x", "label", "obs", by, info.kernels.lda).collect()}
        got = info.decode(df, "x", "label", "obs", by)
        assert {tuple(r[:-2]): (r.accuracy, r.n) for r in got.collect()} == want
    monkeypatch.setitem(info.kernels.DECODERS, "lda", None)
    assert info.decode(df, "x", "label", "obs", []).first().n == 300


def _noisy(n, labels, seed=3, by=()):
    rng = np.random.default_rng(seed)
    names = "abcd"
    return [(s, i + j * n, names[i % labels], (rng.standard_normal(3) + np.eye(4, 3)[i % labels] * 0.9).tolist()) for j, s in enumerate(by or ("x",)) for i in range(n)]


@pytest.mark.parametrize("labels", [2, 3])
def test_rounds_give_the_local_trainers_weights(spark, labels):
    """Logistic weights are those of Newton steps over the whole table; the hinge's loss is that of dual steps."""
    rows = _noisy(160, labels)
    df = spark.createDataFrame(rows, "s string, obs int, label string, x array<double>").repartition(5)
    f = info.folds(df, "obs", "label", [], 4).select(F.col("label").alias("__y"), F.col("x").alias("__x"), "fold")
    held = f.collect()
    for kind in ("logistic", "svm"):
        r = info.trained(f, [], 4, kind).first()
        for problem, state in enumerate(r.states):
            if not state:
                continue
            t, g = divmod(problem, labels)
            x = np.array([[1.0, *v.asDict()["__x"]] for v in held if v.fold != t])
            sign = np.array([1.0 if v["__y"] == r.labels[g] else -1.0 for v in held if v.fold != t])
            got = info._Newton(r.dims, state)
            assert got.found
            if kind == "logistic":
                w = np.zeros(4)
                for _ in range(50):
                    p = 1 / (1 + np.exp(-x @ w))
                    w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(4), x.T @ ((sign > 0) - p) - 1e-6 * w)
                assert got.w == pytest.approx(w, abs=1e-6)
            else:
                loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()  # noqa: B023, E731
                a, w, q = np.zeros(len(x)), np.zeros(4), (x * x).sum(1)
                for e in range(100):
                    for i in np.random.default_rng(e).permutation(len(x)):
                        new = min(max(a[i] - (sign[i] * (x[i] @ w) - 1) / q[i], 0.0), 1.0)
                        w, a[i] = w + (new - a[i]) * sign[i] * x[i], new
                assert loss(got.w) <= loss(w) * 1.001


def test_decoders_in_rounds_count_as_the_local_ones(spark):
    rows = _noisy(90, 3, by=("x", None))
    df = spark.createDataFrame(rows, "s string, obs int, label string, x array<double>").repartition(6)
    for by in ([], ["s"]):
        want = {tuple(r[:-2]): (r.accuracy, r.n) for r in info.decode(df, "x", "label", "obs", by, info.kernels.logistic).collect()}
        assert {tuple(r[:-2]): (r.accuracy, r.n) for r in info.decode(df, "x", "label", "obs", by, "logistic").collect()} == want
    svm, plain = (info.decode(df, "x", "label", "obs", [], d).first().accuracy for d in ("svm", info.kernels.linear_svm))
    assert abs(svm - plain) < 0.04


def test_decoders_with_labels_that_a_fold_lacks(spark):
    rows = [(i, "abc"[i % 3], i // 30, [float(i % 3) + 0.01 * (i % 7), 1.0]) for i in range(60)] + [(60 + i, "c", 0, [2.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "obs int, label string, block int, x array<double>")
    for decoder in ("logistic",):
        got = info.decode(df, "x", "label", "obs", [], decoder, fold="block").first()
        assert got.n == 65 and 0.5 < got.accuracy <= 1
        one = info.decode(df.where("label = 'a'"), "x", "label", "obs", [], decoder, fold="block").first()
        assert (one.n, one.accuracy) == (20, 1.0)
        assert info.decode(df.withColumn("own", F.expr("CASE label WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END")), "x", "label", "obs", [], decoder, fold="own").first().accuracy == 0.0
        assert info.decode(df.limit(0), "x", "label", "obs", ["label"], decoder).collect() == []
    with pytest.raises(ValueError):
        info.decode(df, "x", "label", "obs", [], "nonsense")


def test_zscore_and_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "k string, v double")
    z = {(r.k, r.v): r.z for r in stats.zscore(df, "v", ["k"]).collect()}
    assert z["a", 1.0] == -1.0 and z["a", 3.0] == 1.0 and z["b", 5.0] is None
    assert stats.correlation(df.withColumn("w", F.col("v")), "v", "w", ["k"]).where("k = 'b'").first().r is None
    with pytest.raises(ValueError):
        info.information(df, "nonsense")


def test_permutation_is_calibrated(spark):
    """Under no effect few of many series are significant, under a large one all are."""
    rng = np.random.default_rng(3)
    rows = [(s, i, i % 2, float(rng.standard_normal() + (3.0 if s >= 20 else 0.0) * (i % 2))) for s in range(25) for i in range(20)]
    df = spark.createDataFrame(rows, "series int, obs int, label int, v double")
    p = {r.series: r.p for r in resample.two_sample_permutation_test(df, "v", "label", (0, 1), "obs", ["series"], n_resamples=200).collect()}
    assert sum(p[s] < 0.05 for s in range(20)) <= 4 and all(p[s] < 0.05 for s in range(20, 25))
    again = {r.series: r.p for r in resample.two_sample_permutation_test(df.repartition(7), "v", "label", (0, 1), "obs", ["series"], n_resamples=200).collect()}
    assert p == again


def test_draws(spark):
    p = resample.permutations(spark, 6, 3).collect()
    assert all(sorted(r.i for r in p if r.draw == d) == list(range(6)) for d in (1, 2, 3))
    assert resample.subsets(spark, 6, 2, 4).groupBy("draw").count().where("count <> 2").count() == 0
    assert resample.jackknifes(spark, 4).count() == 12
    assert all(0 <= r.i < 6 for r in resample.bootstraps(spark, 6, 3).collect())
    assert resample.confint_indexes(0.95, 40) == (0, 38)
    with pytest.raises(ValueError):
        resample.confint_indexes(0.99, 40)


def test_large_forms_agree_with_the_exact_ones(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 2, float(x)) for i, x in enumerate(rng.normal(10, 2, 400))], "obs int, label int, v double")
    a = resample.one_sample_confints(df, "v", "obs", [], n_resamples=400).first()
    b = resample.mean_confints_large(df, "v", "obs", [], n_resamples=400).first()
    assert a.stat == pytest.approx(b.stat) and a.low == pytest.approx(b.low, abs=0.06) and a.high == pytest.approx(b.high, abs=0.06)
    p = [resample.two_sample_permutation_test(df, "v", "label", (0, 1), "obs", [], stat="meandiff", n_resamples=400).first().p, resample.two_sample_test_large(df, "v", "label", (0, 1), "obs", [], n_resamples=400).first().p]
    assert p[0] == pytest.approx(p[1], abs=0.1)
    w = df.select(resample.poisson_weight(1, F.col("obs")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert w[0] == pytest.approx(1, abs=0.15) and w[1] == pytest.approx(1, abs=0.3)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_sums_by_ranges(spark, monkeypatch, by):
    """Ranges of the value give what one window gives."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(rng.integers(0, 2, 500), rng.integers(0, 90, 500))], "k int, v double")
    want = sorted(stats.average_ranks(df, "v", by, "r").collect())
    monkeypatch.setattr(stats, "MOST_IN_A_TASK", 10)
    assert sorted(stats.average_ranks(df, "v", by, "r").collect()) == want


def test_ranges_of_floats(spark):
    one = spark.range(1)
    for args, want in (((0.0, 0.3, 0.1), [0.0, 0.1, 0.2, 0.3]), ((1.0, 0.0, -0.5), [1.0, 0.5, 0.0]), ((0.0, -1.0, 0.5), []), ((3, 11, 4), [3, 7, 11]), ((3, 10, 4), [3, 7])):
        assert one.select(exprs.iarange(*args)).first()[0] == pytest.approx(want)


# --- long series ----------------------------------------------------------------------------------


def _uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def _plain_bootstrap(values, draw, block, fan, seed=0):
    """What _resample draws, one pick after the other."""
    n = len(values)
    if n <= block:
        return [values[int(_uniform(seed, draw, t) * n)] for t in range(n)]
    group = max(1, -(-n // (block * fan))) * block
    picks = Counter(int(_uniform(seed, draw, t) * n) // group for t in range(n))
    if group > block:
        blocks = Counter((g * group + int(_uniform(seed, draw, "g", g, t) * min(group, n - g * group))) // block for g, m in picks.items() for t in range(m))
    else:
        blocks = picks
    return [values[b * block + int(_uniform(seed, draw, "b", b, t) * min(block, n - b * block))] for b, m in blocks.items() for t in range(m)]


@pytest.mark.parametrize("small", [10, 32_768])
@pytest.mark.parametrize("block,fan", [(16, 4096), (8, 3), (1024, 4096)])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_bootstrap_by_blocks(spark, monkeypatch, small, block, fan, by):
    monkeypatch.setattr(order, "SMALL", small)
    monkeypatch.setattr(resample, "FAN", fan)
    rng = np.random.default_rng(2)
    rows = [(int(i % 7 == 0) if by else 0, int(i), float(v)) for i, v in enumerate(rng.integers(0, 10**6, 301))]
    df = spark.createDataFrame(rows, "k int, obs int, v double").repartition(3)
    got = resample._resample(df, by, "obs", ["v"], 4, 0, block=block).groupBy(*by, "draw").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    keys = sorted({r[0] for r in rows})
    assert len(got) == 4 * len(keys)
    for r in got:
        values = [v for k, _, v in sorted(rows) if not by or k == r["k"]]
        assert r["v"] == sorted(_plain_bootstrap(values, r["draw"], block, fan))


@pytest.mark.parametrize("by", [[], ["series"]])
def test_places_and_cuts_of_long_series(spark, monkeypatch, by):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(k), int(i), float(v)) for i, (k, v) in enumerate(zip(rng.random(900) < 0.1, rng.normal(size=900)))], "series int, obs int, v double").withColumn("g", F.col("obs") % 3).repartition(5)
    run = lambda: [
        sorted(resample.two_sample_permutation_test(df, "v", "g", (0, 1), "obs", by, n_resamples=12, return_stats=True).collect()),
        sorted(resample.one_way_permutation_test(df, "v", "g", "obs", by, n_resamples=6, return_stats=True).collect()),
        sorted(resample.paired_sample_association_permutation_test(df, "v", "g", "obs", by, n_resamples=6, return_stats=True).collect()),
        sorted(resample.permutations(spark, 40, 3).collect()),
    ]
    want = run()
    monkeypatch.setattr(order, "SMALL", 3)
    monkeypatch.setattr(resample, "SMALL", 3)
    for a, b in zip(run(), want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert list(x) == pytest.approx(list(y))


@pytest.mark.parametrize("stat,reach,repeated", [("meandiff", 6.0, 1), ("t", 6.0, 1), ("meandiff", 0.0, 1), ("meandiff", 0.5, 40)])
def test_sides_of_long_series_by_one_digest(spark, monkeypatch, stat, reach, repeated):
    """Sides are told by digests made once, and by places near the border; where a place is out of reach, by selection.
    One row of repeated observations more or less is the order's choice, so these are all of one value."""
    rng = np.random.default_rng(4)
    rows = [(i // repeated, "ab"[int(u < 0.3)], float(v)) for i, (u, v) in enumerate(zip(rng.random(800), rng.normal(size=800)))]
    df = spark.createDataFrame([(o, g, v if repeated == 1 else float(o % 2)) for o, g, v in rows], "obs int, g string, v double").repartition(3)
    test = lambda: resample.two_sample_permutation_test(df, "v", "g", ("a", "b"), "obs", [], stat=stat, n_resamples=9, return_stats=True)
    want = sorted(test().collect())
    monkeypatch.setattr(resample, "SMALL", 3)
    monkeypatch.setattr(order, "SMALL", 3)
    monkeypatch.setattr(resample, "REACH", reach, raising=False)
    for x, y in zip(sorted(test().collect()), want, strict=True):
        assert list(x) == pytest.approx(list(y))
    assert ("md5" in test()._jdf.queryExecution().optimizedPlan().toString()) == (reach < 6)


def test_groups_that_one_side_lacks(spark):
    df = spark.createDataFrame([(i, "a", float(i)) for i in range(9)], "obs int, g string, v double")
    for groups in (("a", "b"), ("b", "a")):
        r = resample.two_sample_permutation_test(df, "v", "g", groups, "obs", [], stat="meandiff", n_resamples=5).first()
        assert r.stat is None and r.p == 0.2
    none = df.limit(0)
    assert resample.two_sample_permutation_test(none, "v", "g", ("a", "b"), "obs", ["g"], n_resamples=5).collect() == []
    assert resample.one_sample_confints(none, "v", "obs", ["g"], n_resamples=50).collect() == []


@pytest.mark.parametrize("small", [2, 32_768])
def test_numbering(spark, monkeypatch, small):
    monkeypatch.setattr(order, "SMALL", small)
    rows = [(None if i % 9 == 0 else f"s{i * 7 % 5}", i * 31 % 97) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(6)
    for by in ([], ["k"]):
        df_ = df.where("k IS NOT NULL") if by else df
        got = order.numbered(df_, by, ["t"], "at").collect()
        want = {}
        for k, t in sorted(((k if by else "", t) for k, t in rows if k is not None or not by), key=lambda r: (r[0], r[1])):
            want.setdefault(k, []).append(t)
        assert sorted((r.k if by else "", r.at, r.t) for r in got) == sorted((k, i, t) for k, ts in want.items() for i, t in enumerate(ts))


def test_reordered_rows_hold_no_names(spark, monkeypatch):
    """What is shuffled for each draw is the digest's bytes, not the observation's name."""
    monkeypatch.setattr(order, "SMALL", 3)
    monkeypatch.setattr(resample, "SMALL", 3)
    df = spark.range(20).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("obs"), F.col("id").alias("x"), F.col("id").alias("y"))
    got = resample._reordered(df, [], "obs", ["y"], 2, 1)
    assert sorted(got.columns) == ["draw", "x", "y"]
    for d in (1, 2):
        places = sorted(range(20), key=lambda i: hashlib.md5(f"1|{d}|{i:09d}".encode()).hexdigest())
        assert {r.x: r.y for r in got.where(F.col("draw") == d).collect()} == {x: k for k, x in enumerate(places)}


def test_picks_of_many_blocks_are_those_of_sql(spark):
    """A pick's block is told by one number however many blocks there are."""
    n, block, draws = 9000, 2, 3
    md5 = lambda *p: int(hashlib.md5("|".join(map(str, (5, *p))).encode()).hexdigest()[:8], 16) / 2**32
    want = []
    for d in range(1, draws + 1):
        held = Counter(int(md5(d, i) * n) // block for i in range(n))
        want += [(d, b * block + int(md5(d, "b", b, t) * min(block, n - b * block))) for b, m in held.items() for t in range(m)]
    df = spark.range(n).select(F.col("id").alias("obs"), F.col("id").alias("v"))
    got = resample._resample(df, [], "obs", ["v"], draws, 5, block=block).select("draw", "v").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_poisson_weights_are_those_of_the_uniform_number(spark):
    df = spark.range(3000).select("id", resample.poisson_weight(3, "id").alias("w"), resample.uniform(3, "id").alias("u"))
    ends = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) for k in range(13)])
    assert all(r.w == int((ends <= r.u).sum()) for r in df.collect())


@pytest.mark.parametrize("by,portion,share", [([], 1, 7), (["unit", "j"], 300, 1 << 16)])
def test_draws_in_portions(spark, monkeypatch, by, portion, share):
    """Statistics of long series' draws are those of series gathered in a row each, and portions leave no rows behind."""
    df = spark.range(120).select(
        (F.col("id") % 3).alias("j"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("unit"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("obs"),
        F.sin(F.col("id").cast("double")).alias("x"), F.cos(F.col("id") * 2.0).alias("y"), (F.col("id") % 4).alias("g"), (F.col("id") % 5).cast("string").alias("h"),
    )
    tests = [
        lambda: resample.paired_sample_association_permutation_test(df, "x", "y", "obs", by, n_resamples=4, seed=2, return_stats=True),
        lambda: resample.one_way_permutation_test(df, "x", "g", "obs", by, n_resamples=4, seed=2, return_stats=True),
    ]
    rows = lambda t: sorted((tuple(str(r[c]) for c in r.asDict() if c not in ("s", "stat", "p")), round(r.s, 9), round(r.stat, 9), r.p) for r in t.collect())
    want = [rows(t()) for t in tests]
    for m in (resample, order):
        monkeypatch.setattr(m, "SMALL", 3)
    monkeypatch.setattr(resample, "PORTION", portion)
    monkeypatch.setattr(resample, "SHARE", share)
    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(order, "ROWS", 50)
    kept, pieces = [], resample._in_pieces
    monkeypatch.setattr(resample, "_in_pieces", lambda *a: kept.append(pieces(*a)) or kept[-1])
    for t, w in zip(tests, want):
        kept.clear()
        assert rows(t()) == w
        assert len(kept) == (3 if portion == 1 else 2)
        for p in kept:
            assert not any(os.path.exists(f.removeprefix("file://")) for f in p.inputFiles())


def test_reordered_observations_with_many_rows(spark, monkeypatch):
    """Rows of one observation, and those without one, lie beside each other in any order; none is lost."""
    for m in (resample, order):
        monkeypatch.setattr(m, "SMALL", 3)
    monkeypatch.setattr(resample, "BLOCK", 16)
    df = spark.range(90).select(F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.lit(None)).alias("obs"), "id", (F.col("id") * 2).alias("y"))
    got = resample._reordered(df, [], "obs", ["y"], 2, 1)
    for d in (1, 2):
        r = got.where(F.col("draw") == d).collect()
        assert sorted(x.id for x in r) == list(range(90)) and sorted(x.y for x in r) == list(range(0, 180, 2))


def test_labels_permuted_over_many_series_and_missing_values(spark, monkeypatch):
    """Rows without value or label take no part, and text labels keep their counts in each draw."""
    df = spark.range(150).select("id", (F.col("id") % 2).alias("unit"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).alias("x"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("g"))
    counts = lambda d, v, g, b: d.groupBy(*b).agg(F.sum(F.when(F.col(g) == "g1", 1.0)).alias("s"))
    for m in (resample, order):
        monkeypatch.setattr(m, "SMALL", 3)
    monkeypatch.setattr(resample, "PORTION", 1)
    monkeypatch.setattr(resample, "BLOCK", 16)
    got = resample.one_way_permutation_test(df, "x", "g", "id", ["unit"], stat=counts, n_resamples=3, seed=4).collect()
    want = {r.unit: r.n for r in df.where("x IS NOT NULL AND g = 'g1'").groupBy("unit").agg(F.count("*").alias("n")).collect()}
    assert {r.unit: (r.stat, r.p) for r in got} == {k: (float(n), 1.0) for k, n in want.items()}
