"""Queries over embeddings as signals of 64 samples: vec_id is the series, label the condition. Neighbours 2i and
2i + 1 are two channels of trial i."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import info, plotdata, spectral, sync
from ..sources.tables import table

FS, KS = 64.0, (1, 2, 4, 8, 16)
_K = ", ".join(map(str, KS))


def _r(c, n=6):
    return F.round(c, n)


def _signals(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


def _dft(spark, d):
    return spectral.dft(_signals(spark, d), ["vec_id", "label"], "samples", KS)


def dft_power(spark, d):
    return _dft(spark, d).select("vec_id", F.col("k").cast("int").alias("k"), _r(exprs.power()).alias("power"))


def fft_power(spark, d):
    s = spectral.fft(_signals(spark, d), ["vec_id"]).where(F.col("k").isin(*KS))
    return s.select("vec_id", "k", _r(exprs.power()).alias("power"))


def spec_types(spark, d):
    s = _dft(spark, d)
    return s.select("vec_id", F.col("k").cast("int").alias("k"), *(_r(exprs.complex_to_spec_type(t), 5).alias(t) for t in ("magnitude", "real", "imag")))


def band_power(spark, d):
    bands = spark.createDataFrame([("low", 1.0, 2.0), ("mid", 2.0, 8.0), ("high", 8.0, 32.0)], "name string, low double, high double")
    s = _dft(spark, d).withColumn("freq", F.col("k").cast("double")).withColumn("power", exprs.power())
    return spectral.pool_intervals(s, "power", "freq", bands, ["vec_id"]).select("vec_id", "name", _r("power").alias("power"))


def one_over_f(spark, d):
    s = _dft(spark, d).withColumn("value", exprs.power())
    return spectral.one_over_f(s, "value", F.col("k").cast("double"), 1.5).select("vec_id", F.col("k").cast("int").alias("k"), _r("value", 5).alias("value"))


def remove_dc(spark, d):
    s = spectral.remove_dc(_signals(spark, d))
    return s.select("vec_id", F.posexplode("samples").alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def remove_evoked(spark, d):
    long = _signals(spark, d).select("vec_id", "label", F.posexplode("samples").alias("i", "x"))
    return spectral.remove_evoked(long, "x", [], "i", "label").select("vec_id", "i", _r("x").alias("x"))


def _channels(spark, d):
    s = _dft(spark, d).withColumn("trial", F.floor(F.col("vec_id") / 2).cast("long")).withColumn("k", F.col("k").cast("int"))
    return sync.pair(s.where("vec_id % 2 = 0"), s.where("vec_id % 2 = 1"), ["trial", "k"])


def _sync(f, name):
    def query(spark, d):
        return f(_channels(spark, d), ["k"]).select("k", _r(name).alias(name), _r("phase", 4).alias("phase"), "n")

    return query


def coherence_z(spark, d):
    return sync.coherence(_channels(spark, d), ["k"], "z", False).select("k", _r("coherence").alias("z"))


def coherence_trials(spark, d):
    return sync.single_trial(_channels(spark, d), ["k"], "trial").select("k", "trial", _r("coherence", 4).alias("value"))


def _itpc(method):
    def query(spark, d):
        return spectral.itpc(_dft(spark, d), ["label", "k"], "vec_id", method).select("label", F.col("k").cast("int").alias("k"), _r("itpc").alias("itpc"))

    return query


def _wave(stat):
    def query(spark, d):
        return _signals(spark, d).select("vec_id", _r(exprs.waveform_stats("samples", FS, stat)).alias("value"))

    return query


def mean_waveform(spark, d):
    return plotdata.mean_waveforms(_signals(spark, d), ["label"]).select("label", "i", _r("mean").alias("mean"), _r("sd").alias("sd"))


def waveform_histogram(spark, d):
    long = _signals(spark, d).select(F.posexplode("samples").alias("i", "x"))
    return long.groupBy("i", F.floor(F.col("x") / 0.05).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def multitaper(spark, d):
    return spectral.power_spectrum(_signals(spark, d), ["vec_id"], FS, freq_width=4.0).select("vec_id", "freq", _r("value").alias("power"))


def multitaper_spectrogram(spark, d):
    return spectral.power_spectrogram(_signals(spark, d), ["vec_id"], FS, "multitaper", time_width=0.5, freq_width=8.0).select("vec_id", "freq", "time", _r("value").alias("power"))


def wavelet(spark, d):
    return spectral.power_spectrogram(_signals(spark, d), ["vec_id"], FS, freqs=[4.0, 8.0, 16.0], every=4).select("vec_id", "freq", "time", _r("value").alias("power"))


def _wavelets(spark, d, spec_type):
    return spectral.spectrogram(_signals(spark, d), ["vec_id"], FS, "wavelet", spec_type, freqs=[4.0, 8.0, 16.0], every=4)


def wavelet_complex(spark, d):
    return _wavelets(spark, d, "complex").select("vec_id", "freq", "time", _r("re").alias("re"), _r("im").alias("im"))


def wavelet_phase(spark, d):
    return spectral.phase_spectrogram(_signals(spark, d), ["vec_id"], FS, freqs=[4.0, 8.0, 16.0], every=4).select("vec_id", "freq", "time", _r("value", 5).alias("phase"))


def wavelet_spectrum(spark, d):
    return spectral.power_spectrum(_signals(spark, d), ["vec_id"], FS, "wavelet", freqs=[4.0, 8.0, 16.0]).select("vec_id", "freq", _r("value").alias("power"))


def bandfilter_spectrum(spark, d):
    return spectral.spectrum(_signals(spark, d), ["vec_id"], FS, "bandfilter", "magnitude", bands=((4, 8), (10, 20)), every=4).select("vec_id", "freq", _r("value").alias("magnitude"))


def bandfilter(spark, d):
    return spectral.power_spectrogram(_signals(spark, d), ["vec_id"], FS, "bandfilter", bands=((4, 8), (10, 20)), every=4).select("vec_id", "freq", "time", _r("value").alias("power"))


def signal_bursts(spark, d):
    return spectral.burst_analysis(_signals(spark, d), ["vec_id"], FS, freqs=[4.0, 8.0, 16.0], threshold=1.0, min_cycles=1.0).select("vec_id", "freq", "first", "last", "n")


def decode_lda(spark, d):
    s = _signals(spark, d).withColumn("half", F.when(F.col("label") < 5, "low").otherwise("high"))
    return info.decode(s, "samples", "half", "vec_id", []).select(_r("accuracy").alias("accuracy"), "n")


QUERIES = {
    "dft_power": dft_power, "fft_power": fft_power, "spec_types": spec_types, "band_power": band_power, "one_over_f": one_over_f, "remove_dc": remove_dc, "remove_evoked": remove_evoked,
    "coherence": _sync(sync.coherence, "coherence"), "plv": _sync(sync.plv, "plv"), "ppc": _sync(sync.ppc, "ppc"), "coherence_z": coherence_z, "coherence_trials": coherence_trials,
    "itpc_plv": _itpc("plv"), "itpc_ppc": _itpc("ppc"), "itpc_z": _itpc("z"), "waveform_width": _wave("width"), "waveform_amp_ratio": _wave("amp_ratio"), "waveform_trough_width": _wave("trough_width"), "waveform_repolarization": _wave("repolarization"),
    "mean_waveform": mean_waveform, "waveform_histogram": waveform_histogram, "multitaper": multitaper, "multitaper_spectrogram": multitaper_spectrogram, "wavelet": wavelet, "bandfilter": bandfilter, "wavelet_complex": wavelet_complex, "wavelet_phase": wavelet_phase, "wavelet_spectrum": wavelet_spectrum, "bandfilter_spectrum": bandfilter_spectrum, "signal_bursts": signal_bursts, "decode_lda": decode_lda,
}

_L = "l AS (SELECT vec_id, label, (unnest(embedding))::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings)"
_S = f"{_L}, k AS (SELECT unnest([{_K}])::INTEGER AS k), s AS (SELECT vec_id, label, k, sum(x * cos({2 * math.pi!r}::DOUBLE * k * i / n)) AS re, -sum(x * sin({2 * math.pi!r}::DOUBLE * k * i / n)) AS im FROM l, k GROUP BY ALL)"
_P = f"{_S}, p AS (SELECT a.vec_id // 2 AS trial, k, a.re AS r1, a.im AS i1, b.re AS r2, b.im AS i2 FROM s AS a JOIN s AS b USING (k) WHERE a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1), x AS (SELECT *, r1 * r2 + i1 * i2 AS re, i1 * r2 - r1 * i2 AS im FROM p)"
_COH = "c AS (SELECT k, avg(re) AS re, avg(im) AS im, avg(r1 * r1 + i1 * i1) AS p1, avg(r2 * r2 + i2 * i2) AS p2, count(*) AS n FROM x GROUP BY k)"
_PLV = "c AS (SELECT k, avg(re / sqrt(re * re + im * im)) AS re, avg(im / sqrt(re * re + im * im)) AS im, count(*) AS n FROM x GROUP BY k)"
_ITPC = f"WITH {_S}, c AS (SELECT label, k, avg(cos(atan2(im, re))) AS c, avg(sin(atan2(im, re))) AS s, count(*)::DOUBLE AS n FROM s GROUP BY ALL)"
_W = "w AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_position(embedding, list_min(embedding)) AS t FROM embeddings), v AS (SELECT *, e[t:] AS tail FROM w), z AS (SELECT *, list_max(tail) AS peak, list_position(tail, list_max(tail)) AS p FROM v)"
# Spectra of the demeaned samples at frequencies 1 to 31, times a wavelet's bell, and back at every sample.
_SCALE = f"({6 + math.sqrt(38)!r}::DOUBLE / (4 * pi() * freq))"
_MORLET = f"""{_L}, m AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / n)) AS re, -sum(x * sin(2 * pi() * k * i / n)) AS im FROM l, (SELECT unnest(range(1, 32)) AS k) GROUP BY ALL),
    g AS (SELECT freq, k, pow(pi(), -0.25::DOUBLE) * sqrt({_SCALE} * 2 * pi() * 64) * exp(-0.5::DOUBLE * pow({_SCALE} * 2 * pi() * k - 6, 2)) AS g FROM (SELECT unnest([4.0, 8.0, 16.0])::DOUBLE AS freq), (SELECT unnest(range(1, 32)) AS k)),
    z AS (SELECT vec_id, freq, i, sum(g * (re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64))) / 64 AS re, sum(g * (re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64))) / 64 AS im FROM m JOIN g USING (k), (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL),
    power AS (SELECT vec_id, freq, i, re * re + im * im AS power FROM z)"""
# Demeaned samples with their odd reflection (63 on either side, sample 0 at place 63), transformed at 512 points, times
# the squared response of a Butterworth band of order 4 after the bilinear transform, and back; then the analytic signal.
_WARP = lambda f: f"(128 * tan(pi() * {f} / 64))"
_BANDS = f"""{_L}, c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM l),
    e AS (SELECT vec_id, max(x) FILTER (i = 0) AS a, max(x) FILTER (i = 63) AS b FROM c GROUP BY vec_id),
    y AS (SELECT vec_id, i + 63 AS p, x FROM c UNION ALL SELECT vec_id, 63 - i, 2 * a - x FROM c JOIN e USING (vec_id) WHERE i > 0 UNION ALL SELECT vec_id, 189 - i, 2 * b - x FROM c JOIN e USING (vec_id) WHERE i < 63),
    s AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * p / 512)) AS re, -sum(x * sin(2 * pi() * k * p / 512)) AS im FROM y, (SELECT unnest(range(1, 256)) AS k) GROUP BY ALL),
    h AS (SELECT (lo + hi) / 2.0::DOUBLE AS freq, k, 1 / (1 + pow((pow({_WARP("k / 8")}, 2) - {_WARP("lo")} * {_WARP("hi")}) / ({_WARP("k / 8")} * ({_WARP("hi")} - {_WARP("lo")})), 8)) AS h FROM (VALUES (4.0::DOUBLE, 8.0::DOUBLE), (10.0::DOUBLE, 20.0::DOUBLE)) AS b(lo, hi), (SELECT unnest(range(1, 256)) AS k)),
    f AS (SELECT vec_id, freq, i, sum(h * (re * cos(2 * pi() * k * (i + 63) / 512) - im * sin(2 * pi() * k * (i + 63) / 512))) / 256 AS x FROM s JOIN h USING (k), (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL),
    t AS (SELECT vec_id, freq, k, sum(g * x * cos(2 * pi() * k * i / 64)) AS re, -sum(g * x * sin(2 * pi() * k * i / 64)) AS im FROM f, (SELECT k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS g FROM (SELECT unnest(range(0, 33)) AS k)) GROUP BY ALL),
    z AS (SELECT vec_id, freq, i, sum(re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64)) / 64 AS re, sum(re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64)) / 64 AS im FROM t, (SELECT unnest(range(0, 64, 4)) AS i) GROUP BY ALL)"""
ORACLES = {
    "wavelet": f"WITH {_MORLET} SELECT vec_id, freq, i / 64.0::DOUBLE AS time, round(power, 6) AS power FROM power WHERE i % 4 = 0",
    "wavelet_complex": f"WITH {_MORLET} SELECT vec_id, freq, i / 64.0::DOUBLE AS time, round(re, 6) AS re, round(im, 6) AS im FROM z WHERE i % 4 = 0",
    "wavelet_phase": f"WITH {_MORLET} SELECT vec_id, freq, i / 64.0::DOUBLE AS time, round(atan2(im, re), 5) AS phase FROM z WHERE i % 4 = 0",
    "wavelet_spectrum": f"WITH {_MORLET} SELECT vec_id, freq, round(avg(power), 6) AS power FROM power GROUP BY ALL",
    "bandfilter_spectrum": f"WITH {_BANDS} SELECT vec_id, freq, round(avg(sqrt(re * re + im * im)), 6) AS magnitude FROM z GROUP BY ALL",
    "bandfilter": f"WITH {_BANDS} SELECT vec_id, freq, i / 64.0::DOUBLE AS time, round(re * re + im * im, 6) AS power FROM z",
    "signal_bursts": f"""WITH {_MORLET}, d AS (SELECT freq, avg(power) AS m, stddev_pop(power) AS d FROM power GROUP BY freq), o AS (SELECT vec_id, freq, i, i - row_number() OVER (PARTITION BY vec_id, freq ORDER BY i) AS run FROM power JOIN d USING (freq) WHERE (power - m) / d > 1),
        r AS (SELECT vec_id, freq, min(i) AS first, max(i) AS last, count(*) AS n FROM o GROUP BY vec_id, freq, run)
        SELECT vec_id, freq, first, last, n FROM r WHERE n >= 64 / freq OR last = 63 AND n >= 64 / freq - 1""",
    "dft_power": f"WITH {_S} SELECT vec_id, k, round(re * re + im * im, 6) AS power FROM s",
    "fft_power": f"WITH {_S} SELECT vec_id, k, round(re * re + im * im, 6) AS power FROM s",
    "spec_types": f"WITH {_S} SELECT vec_id, k, round(sqrt(re * re + im * im), 5) AS magnitude, round(re, 5) AS real, round(im, 5) AS imag FROM s",
    "band_power": f"WITH {_S}, b AS (SELECT * FROM (VALUES ('low', 1, 2), ('mid', 2, 8), ('high', 8, 32)) AS v(name, a, z)) SELECT vec_id, name, round(avg(re * re + im * im), 6) AS power FROM s JOIN b ON k BETWEEN a AND z GROUP BY ALL",
    "one_over_f": f"WITH {_S} SELECT vec_id, k, round((re * re + im * im) * power(k, 1.5::DOUBLE), 5) AS value FROM s",
    "remove_dc": f"WITH {_L} SELECT vec_id, i::INTEGER AS i, round(x - avg(x) OVER (PARTITION BY vec_id), 6) AS x FROM l",
    "remove_evoked": f"WITH {_L} SELECT vec_id, i::INTEGER AS i, round(x - avg(x) OVER (PARTITION BY label, i), 6) AS x FROM l",
    "coherence": f"WITH {_P}, {_COH} SELECT k, round(sqrt(re * re + im * im) / sqrt(p1 * p2), 6) AS coherence, round(atan2(im, re), 4) AS phase, n FROM c",
    "plv": f"WITH {_P}, {_PLV} SELECT k, round(sqrt(re * re + im * im), 6) AS plv, round(atan2(im, re), 4) AS phase, n FROM c",
    "ppc": f"WITH {_P}, {_PLV} SELECT k, round((n * (re * re + im * im) - 1) / (n - 1), 6) AS ppc, round(atan2(im, re), 4) AS phase, n FROM c",
    "coherence_z": f"WITH {_P}, {_COH} SELECT k, round(1.15::DOUBLE * (sqrt(-(2 * n - 2) * ln(1 - (re * re + im * im) / (p1 * p2))) - 1.15::DOUBLE), 6) AS z FROM c",
    "coherence_trials": f"WITH {_P}, c AS (SELECT *, r1 * r1 + i1 * i1 AS p1, r2 * r2 + i2 * i2 AS p2 FROM x), t AS (SELECT k, trial, count(*) OVER w AS n, sum(re) OVER w AS a, sum(im) OVER w AS b, sum(p1) OVER w AS c, sum(p2) OVER w AS d, re, im, p1, p2 FROM c WINDOW w AS (PARTITION BY k)) SELECT k, trial, round(n * sqrt(a * a + b * b) / sqrt(c * d) - (n - 1) * sqrt((a - re) * (a - re) + (b - im) * (b - im)) / sqrt((c - p1) * (d - p2)), 4) AS value FROM t",
    "itpc_plv": f"{_ITPC} SELECT label, k, round(sqrt(c * c + s * s), 6) AS itpc FROM c",
    "itpc_ppc": f"{_ITPC} SELECT label, k, round((n * (c * c + s * s) - 1) / (n - 1), 6) AS itpc FROM c",
    "itpc_z": f"{_ITPC} SELECT label, k, round(n * (c * c + s * s), 6) AS itpc FROM c",
    "waveform_width": f"WITH {_W} SELECT vec_id, round((p - 1) / {FS}::DOUBLE, 6) AS value FROM z",
    "waveform_amp_ratio": f"WITH {_W} SELECT vec_id, round(abs(list_min(e)) / peak, 6) AS value FROM z",
    "waveform_trough_width": f"WITH {_W} SELECT vec_id, round((list_min([i FOR x, i IN e IF x > list_min(e) / 2 AND i > t]) - list_max([i FOR x, i IN e IF x > list_min(e) / 2 AND i < t]) - 2) / {FS}::DOUBLE, 6) AS value FROM z",
    "waveform_repolarization": f"WITH {_W} SELECT vec_id, round((list_min([i FOR x, i IN tail[p:] IF x <= 0.75::DOUBLE * peak]) - 1) / {FS}::DOUBLE, 6) AS value FROM z",
    "mean_waveform": f"WITH {_L} SELECT label, i::INTEGER AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM l GROUP BY ALL",
    "waveform_histogram": f"WITH {_L} SELECT i::INTEGER AS i, floor(x / 0.05::DOUBLE)::INTEGER AS bin, count(*) AS n FROM l GROUP BY ALL",
}
