from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import exprs, kernels
from pulsegrid.operators import spectral, sync, windows


@pytest.fixture(scope="module")
def wave(spark):
    t = np.arange(512) / 256.0
    rows = [(k, (np.cos(2 * np.pi * 32 * t + k) + 0.01 * np.cos(2 * np.pi * 5 * t)).tolist()) for k in range(4)]
    return spark.createDataFrame(rows, "trial int, samples array<double>")


@pytest.mark.parametrize("method", ["multitaper", "wavelet", "bandfilter"])
def test_peak_is_where_it_should_be(wave, method):
    options = {"multitaper": {}, "wavelet": {"freqs": [8.0, 16.0, 32.0, 64.0]}, "bandfilter": {"bands": ((4, 12), (24, 40), (60, 90))}}[method]
    s = spectral.power_spectrum(wave, ["trial"], 256.0, method, **options)
    top = {r.trial: r.freq for r in s.groupBy("trial").agg(F.max_by("freq", "value").alias("freq")).collect()}
    assert all(abs(f - 32) <= 4 for f in top.values())


def test_fft_round_trip(wave):
    s = spectral.fft(wave, ["trial"])
    back = {r.trial: np.array(r.samples) for r in spectral.ifft(s, ["trial"]).collect()}
    for r in wave.collect():
        assert np.allclose(back[r.trial], r.samples)
    some = {(r.trial, r.k): (r.re, r.im) for r in s.where("k = 7").collect()}
    for r in spectral.dft(wave, ["trial"], "samples", [7]).collect():
        assert (r.re, r.im) == pytest.approx(some[r.trial, 7], abs=1e-6)


def test_dft_stays_in_its_row(spark):
    d = spark.createDataFrame([(1, [1.0, None, 3.0]), (1, [2.0]), (2, []), (3, None)], "k0 int, samples array<double>")
    s = spectral.dft(d, ["k0"], "samples", [0, 1])
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
    want = [np.fft.fft([1.0, 0.0, 3.0])[:2], [2.0, 2.0]]
    assert np.allclose(sorted(abs(complex(r.re, r.im)) for r in s.collect()), sorted(np.abs(np.concatenate(want))))


def test_kernels():
    assert kernels.f_sf(1.0, 1, 1) == pytest.approx(0.5)
    assert kernels.f_sf(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    v = kernels.tapers(128, 4.0, 7)
    assert np.allclose(v @ v.T, np.eye(7), atol=1e-8)
    f = np.array([0.5, 5.0, 15.0, 18.0, 60.0, 150.0, 400.0])
    for kind, least in (("butter", 0.9), ("cheby1", 0.56), ("cheby2", 0.5), ("ellip", 0.56)):
        for order in (4, 5):
            for low, high in ((10.0, 32.0), (2.0, 8.0), (0.0, 20.0), (100.0, 600.0)):
                d = kernels.filter_design(low, high, 1000.0, kind, order)
                h = np.abs(kernels.frequency_response(d, f, 1000.0))
                wide = 3.0 if kind == "cheby2" else 1.45  # its edges are those of the stopped bands
                inside = (f > low * wide) & (f < high / wide)
                outside = (f < low * 0.5) | (f > high * 2)
                assert (h[inside] > least).all() and (h[inside] < 1.001).all() and (h[outside] < 0.1).all() and (np.abs(d[1]) < 1).all(), (kind, order, low, high, h)
    edge = kernels.frequency_response(kernels.filter_design(0.0, 100.0, 1000.0, "butter", 4), np.array([100.0]), 1000.0)
    assert abs(edge[0]) == pytest.approx(0.5**0.5)
    for kind in ("cheby1", "ellip"):
        edge = kernels.frequency_response(kernels.filter_design(0.0, 100.0, 1000.0, kind, 4, 3.0, 50.0), np.array([100.0]), 1000.0)
        assert abs(edge[0]) == pytest.approx(10 ** (-3.0 / 20))
    x = np.random.default_rng(0).standard_normal(64)
    assert np.allclose(kernels.analytic(x).real, x)
    assert np.allclose(kernels.one_to_two_sided(np.fft.fft(x)[:33], 64), np.fft.fft(x))
    assert kernels.is_positive_definite(np.eye(3)) and not kernels.is_symmetric([[1, 2], [3, 4]])


def test_published_spectrum():
    """Power of a 32 Hz wave in noise, published for multitaper and wavelet spectra."""
    np.random.seed(1)
    n = np.vectorize(NormalDist(0, 1).inv_cdf)(np.random.rand(1000, 4))
    x = (5 * np.cos(2 * np.pi * 32 * np.arange(1000) / 1000.0)[:, None] + n)[:, 0]
    s = kernels.wavelet(x, 1000.0)
    assert np.mean(np.abs(s) ** 2) == pytest.approx(44.9462, rel=0.05)


def test_synchrony_grows_with_phase_locking(spark):
    rng = np.random.default_rng(1)

    def pairs(sd):
        rows = [(k, "f", float(np.cos(p)), float(np.sin(p)), float(np.cos(p + d)), float(np.sin(p + d))) for k in range(300) for p, d in [(rng.uniform(0, 6.28), rng.normal(0.5, sd))]]
        return spark.createDataFrame(rows, "trial int, freq string, re1 double, im1 double, re2 double, im2 double")

    for f, name in ((sync.coherence, "coherence"), (sync.plv, "plv"), (sync.ppc, "ppc")):
        tight, loose = f(pairs(0.1), ["freq"]).first(), f(pairs(2.0), ["freq"]).first()
        assert tight[name] > 0.9 > loose[name] and tight.phase == pytest.approx(-0.5, abs=0.1)
    assert sync.single_trial(pairs(0.1), ["freq"], "trial").count() == 300


def test_spike_field(spark):
    spectra = spark.createDataFrame([(0, 10.0, k / 1000, float(np.cos(0.0628 * k)), float(np.sin(0.0628 * k))) for k in range(1000)], "trial int, freq double, time double, re double, im double")
    events = spark.createDataFrame([(0, k / 1000) for k in range(5, 1000, 100)], "trial int, t double")
    w = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.5, 1.0)], "win int, start double, end double")
    r = sync.spike_field_plv(events, spectra, ["trial"], w).collect()
    assert len(r) == 2 and all(x.plv > 0.99 and x.n == 5 for x in r)
    assert all(x.ppc > 0.98 for x in sync.spike_field_ppc(events, spectra, ["trial"], w).collect())


@pytest.mark.parametrize("fs", [64.0, 1000.0])
def test_events_off_the_grid_all_count(spark, fs):
    """Whatever the field's rate: each event within the windows and the field meets its nearest sample."""
    rng = np.random.default_rng(4)
    n = int(2 * fs)
    spectra = spark.createDataFrame([(0, 10.0, k / fs, float(np.cos(20 * np.pi * k / fs)), float(np.sin(20 * np.pi * k / fs))) for k in range(n)], "trial int, freq double, time double, re double, im double")
    times = [float(t) for t in rng.uniform(0, (n - 0.5) / fs, 200)]
    events = spark.createDataFrame([(0, t) for t in times], "trial int, t double")
    w = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.25, 9.0)], "win int, start double, end double")
    for given in (fs, None):
        r = {x.win: x for x in sync.spike_field_plv(events, spectra, ["trial"], w, fs=given).collect()}
        for win, (a, b) in enumerate(((0, 500), (250, 9000))):
            inside = [t for t in times if a <= round(t * 1000) <= b]
            z = np.mean([np.exp(20j * np.pi * min(round(t * fs), n - 1) / fs) for t in inside])
            assert r[win].n == len(inside) and r[win].plv == pytest.approx(abs(z), abs=1e-9)


@pytest.mark.parametrize("bucket", [None, 0.3, 2.0])
def test_nearest_join(spark, bucket):
    rng = np.random.default_rng(5)
    left = [(int(k % 3), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 9, 150), np.round(rng.uniform(-3, 12, 150), 1)))] + [(0, None, 900), (None, 1.0, 901), (0, 4.0, 902), (0, 4.0, 903)]
    right = [(int(k), float(t), f"r{i}") for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), np.round(rng.uniform(0, 10, 60), 1)))] + [(0, None, "x"), (None, 1.0, "y"), (1, 5.05, "twice"), (1, 5.05, "twice")]
    got = windows.nearest_join(spark.createDataFrame(left, "k int, t double, id int"), spark.createDataFrame(right, "k int, time double, name string"), ["k"], "t", "time", 0.25, bucket).collect()
    want = []
    for k, t, i in left:
        near = sorted({(abs(s - t), s) for j, s, _ in right if None not in (j, s, t, k) and j == k and abs(s - t) <= 0.25 * (1 + 1e-9)})
        want += [(i, s, name) for j, s, name in right if near and j == k and s == near[0][1]]
    assert sorted((r.id, r.time, r.name) for r in got) == sorted(want)
    with pytest.raises(ValueError):
        windows.nearest_join(spark.createDataFrame(left, "k int, t double, id int"), spark.createDataFrame(right, "k int, time double, name string"), ["k"], "t", "time", 0.0)


def test_coupling_by_tapers_and_bands(spark, wave):
    events = spark.createDataFrame([(k, 0.37 + 0.01 * j) for k in range(4) for j in range(40)], "trial int, t double")
    w = spark.createDataFrame([(0, 0.0, 2.0)], "win int, start double, end double")
    r = sync.spike_field_coupling(events, wave, "trial", 256.0, w, "plv", "multitaper", time_width=0.25, spacing=0.125)
    assert r.count() > 1 and r.where("n % 160 <> 0").count() == 0  # an event counts once for each taper
    with pytest.raises(ValueError):
        sync.spike_field_coupling(events, wave, "trial", 256.0, w, "plv", "nonsense")


def test_waveforms(spark):
    w = [0.0, -0.1, -0.6, -1.0, -0.7, -0.2, 0.3, 0.5, 0.4, 0.3, 0.1]
    r = spark.createDataFrame([(w,)], "w array<double>").select(*(exprs.waveform_stats("w", 10.0, s).alias(s) for s in exprs.WAVEFORM_STATS)).first()
    assert r.width == pytest.approx(0.4) and r.amp_ratio == pytest.approx(2.0)
    assert r.trough_width == pytest.approx(0.2) and r.repolarization == pytest.approx(0.2)
    assert spark.createDataFrame([(w + [0.05, 0.04, 0.04],)], "w array<double>").select(exprs.repolarization_time("w", 10.0, "inflection").alias("x")).first().x > 0
    with pytest.raises(ValueError):
        exprs.waveform_stats("w", 10.0, "nonsense")


def test_predicted_part_is_removed(spark):
    rows = [(k, float(k), float(k % 3), 2.0 + 3.0 * k - 1.5 * (k % 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "obs int, a double, b double, y double")
    assert max(abs(r.y) for r in spectral.remove_predicted(df, "y", [], ["a", "b"]).collect()) < 1e-9


def test_composed_synchrony(spark, wave):
    r = sync.synchrony_of_signals(wave, wave, "trial", 256.0, "plv", freqs=[16.0, 32.0])
    assert all(x.plv == pytest.approx(1) and x.n == 4 for x in r.collect())
    events = spark.createDataFrame([(k, 0.5 + 0.001 * j) for k in range(4) for j in (0, 125, 250)], "trial int, t double")
    w = spark.createDataFrame([(0, 0.0, 2.0)], "win int, start double, end double")
    assert sync.spike_field_coupling(events, wave, "trial", 256.0, w, "plv", freqs=[32.0]).count() == 1


def test_plot_data(spark, wave):
    from pulsegrid.operators import plotdata

    long = wave.select("trial", F.posexplode("samples").alias("i", "x"))
    assert plotdata.lines(long, "i", "x", []).count() == 512
    assert plotdata.stacked(long, "trial", "i", "x").agg(F.max("y")).first()[0] <= 3 + 1.5 + 1e-9
    assert plotdata.raster(long.withColumnRenamed("i", "t"), ["trial"]).select("train").distinct().count() == 4
    assert plotdata.mean_waveforms(wave, []).count() == 512
    assert plotdata.waveform_histogram(wave, -2.0, 2.0).agg(F.sum("n")).first()[0] == 4 * 512
    assert plotdata.heatmap(long, "i", "trial", "x").count() == 4 * 512


def test_long_series(spark):
    """What functions of elements refer to is worked out once: a long series costs its length, not its square."""
    n = 200_000
    s = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i == n // 2, -8.0).otherwise(i % 2 + 0.0)).alias("samples"))
    x = spectral.remove_dc(s).select(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("sum"), F.array_min("samples").alias("low")).first()
    assert abs(x["sum"]) < 1e-4 and abs(x["low"] + 8.5) < 1e-3
    assert s.select(exprs.trough_width("samples", 1.0).alias("w")).first()["w"] == 0.0
