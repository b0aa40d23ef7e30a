import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from pulsegrid.llm import whitening
from pulsegrid.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, most=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} by an eigendecomposition of the covariance."""
    good = [(k, [int(np.floor(256 * c)) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(c - s / n) for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k, x in good:
        for c in range(min(most, len(values))):
            w = float((np.array(x) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c]))
            out[k, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), w, values[c] / values.sum())
    return out


def check(got, want):
    assert len(got) == len(want)
    got = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for key, (n, deviation, w, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-6)
        sign = signs.setdefault(key[1], np.sign(r.whitened * w) or 1.0)
        assert r.whitened == pytest.approx(sign * w, abs=1e-7)
        assert r.identity_error < 1e-9


def test_query_against_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, f"{DATA}/sf0.01").collect(), plain(rows))


def test_singular_values_stay_accurate_over_many_magnitudes():
    rng = np.random.default_rng(3)
    q1, q2 = (np.linalg.qr(rng.standard_normal((9, 9)))[0] for _ in range(2))
    want = 10.0 ** -np.arange(9)
    v, sigma = whitening.jacobi(q1 * want @ q2.T)
    assert sigma == pytest.approx(want, rel=1e-6)
    assert np.abs(np.abs(v.T @ q2) - np.eye(9)).max() < 1e-6
    # Columns of very different lengths keep their small ones to full precision.
    graded = np.linalg.qr(rng.standard_normal((9, 9)))[0] * want**2
    assert whitening.jacobi(graded)[1] == pytest.approx(want**2, rel=1e-13)
    assert whitening.jacobi(np.zeros((3, 3)))[1].tolist() == [0, 0, 0]


def test_many_partitions_give_one_factor(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in rng.standard_normal(5) * [1, 3, 0.2, 9, 2]]) for k in range(900)]
    df = spark.createDataFrame(rows, VECTORS).repartition(40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(whitening.whiten(df).collect(), plain(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_unusable_repeated_and_clashing_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, -0.0, 2.0]), (1, [1.0, -0.0, 2.0]), (2, [1.0, 0.001, 2.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 1.0]), (6, [1.0, -inf, 1.0]), (None, [0.5, 0.5, -3.0]), (7, [9.0, 2.0, 1.5]), (8, [4.0, -2.5, 1.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS n", "2 AS component", "3 AS x", "4 AS key")
    got = whitening.whiten(df).collect()
    # 1, 1 and 2 are one vector in the fit; the last two have no entries to project.
    full = [r for r in rows if r[0] is None or r[0] not in (9, 10)]
    want = plain([(99 if k is None else k, v) for k, v in full])
    assert len(got) == 3 * 8
    for r in got:
        if r.vec_id in (9, 10):
            assert r.whitened is None and r.deviation is None and r.n == 4
        else:
            n, deviation, _, explained = want[99 if r.vec_id is None else r.vec_id, r.component]
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-6)


def test_fewer_vectors_than_components(spark):
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])], VECTORS)).collect()
    assert [(r.vec_id, r.component, r.whitened is None) for r in sorted(two)] == [(k, c, c > 1) for k in (1, 2) for c in (1, 2, 3)]
    assert {abs(r.whitened) for r in two if r.component == 1} == {1.0}
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS)).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECTORS)).collect() == []


def test_deviations_are_exact_beyond_double_precision(spark):
    rows = [(k, [float(k * 4096), float(k % 7) / 256, -3.0]) for k in range(3000)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).where("component = 1").collect()}
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    sums, n = [sum(c) for c in zip(*x)], len(x)
    want = {k: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for k, v in enumerate(x)}
    assert got == {k: v if v < 2**63 else None for k, v in want.items()}
    assert any(v is None for v in got.values()) and any(v is not None and v > 2**53 for v in got.values())


def test_numbering_is_by_falling_variance_and_signs_are_fixed(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in rng.standard_normal(3) * [1, 5, 2]]) for k in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    w = whitening.fit(df.select(whitening.whole_entries(F.col("embedding")).alias("x")))
    assert list(w.variances) == sorted(w.variances, reverse=True)
    assert all(c[np.abs(c).argmax()] > 0 for c in w.components.T)
    assert [int(np.abs(c).argmax()) for c in w.components.T] == [1, 2, 0]
