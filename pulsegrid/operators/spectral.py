"""Spectral analysis of regularly sampled series.

A series is one row with an array of samples, so transforms are local to a row: they run in Arrow batches without a
shuffle, and what follows (bands, normalisation, averages over trials) is native again on long tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import bound, complex_to_spec_type, div
from . import stats
from .windows import pool_intervals, runs


def _long(df: DataFrame, keys: list[str], samples: str, make: Callable[[np.ndarray], list[tuple[dict, np.ndarray]]], extra: str) -> DataFrame:
    """For each row, the rows that make() gives for its samples: columns of coordinates, and complex values."""
    names = [x.split()[0] for x in extra.split(", ")]
    kinds = {"double": pa.float64(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in extra.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(len(keys)).to_pylist()
            for k, x in enumerate(held):
                if not x:
                    continue
                where, values = make(np.array(x, float))
                v = values.ravel()
                cols = [batch.column(c).take(pa.array(np.full(len(v), k))) for c in range(len(keys))]
                cols += [pa.array(np.broadcast_to(where[n], values.shape).ravel(), t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(v.real.astype(float)), pa.array(v.imag.astype(float))], [*keys, *names, "re", "im"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), extra, "re double, im double"])
    return df.select(*keys, samples).mapInArrow(run, schema)


def fft(df: DataFrame, keys: list[str], samples: str = "samples", n_fft: int | None = None) -> DataFrame:
    """(keys..., k, re, im): the discrete Fourier transform, k from 0."""
    return _long(df, keys, samples, lambda x: ({"k": np.arange(n_fft or len(x))}, np.fft.fft(x, n_fft)), "k int")


def ifft(df: DataFrame, keys: list[str], re: str = "re", im: str = "im", k: str = "k") -> DataFrame:
    """(keys..., samples): the inverse, real part, of a long spectrum."""
    s = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), F.col(re).alias("re"), F.col(im).alias("im")))).alias("s"))
    s = s.select(*keys, F.col("s.re").cast("array<double>").alias("re"), F.col("s.im").cast("array<double>").alias("im"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(len(keys) + c)] for c in (0, 1)]
            out = [np.fft.ifft(a + 1j * b).real for a, b in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.list_(pa.float64()))], [*keys, "samples"])

    return s.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "samples array<double>"]))


def dft(df: DataFrame, keys: list[str], samples: str, ks: Sequence[int]) -> DataFrame:
    """(keys..., k, re, im) for some frequencies only, by native sums of products within a row, without a shuffle; for
    short series. Null samples count as zero; empty and null arrays have no rows."""
    each = df.where(F.size(samples) > 0).select(*keys, F.col(samples).cast("array<double>").alias("__x"), F.explode(F.array(*(F.lit(int(k)) for k in ks))).alias("k"))
    turn = 2 * math.pi * F.col("k")
    terms = lambda f: F.transform("__x", lambda x, p: F.coalesce(x, F.lit(0.0)) * f(turn * p / F.size("__x")))
    total = lambda f: F.aggregate(terms(f), F.lit(0.0), lambda a, x: a + x)
    return each.select(*keys, "k", total(F.cos).alias("re"), (-total(F.sin)).alias("im"))


def multitaper_spectrum(df: DataFrame, keys: list[str], fs: float, samples: str = "samples", freq_width: float = 4.0, n_tapers: int | None = None, freq_range=None, pad: bool = True, remove_dc: bool = True, points: bool = False) -> DataFrame:
    """(keys..., freq, taper, re, im). Average what you need over tapers: see over_tapers."""

    def make(x: np.ndarray):
        f, s = kernels.multitaper(x, fs, kernels.taper_set(fs, len(x) / fs, freq_width, n_tapers), freq_range, pad, remove_dc, points)
        return {"freq": f[None, :], "taper": np.arange(len(s))[:, None]}, s

    return _long(df, keys, samples, make, "freq double, taper int")


def multitaper_spectrogram(df: DataFrame, keys: list[str], fs: float, samples: str = "samples", time_width: float = 0.5, freq_width: float = 4.0, spacing: float | None = None, n_tapers: int | None = None, freq_range=None, pad: bool = True, remove_dc: bool = True, points: bool = False) -> DataFrame:
    """(keys..., time, freq, taper, re, im): windows of time_width, time at their middle."""
    n, step = int(round(time_width * fs)), int(round((spacing or time_width) * fs))

    def make(x: np.ndarray):
        starts = np.arange(0, len(x) - n + 1, step)
        taper = kernels.taper_set(fs, time_width, freq_width, n_tapers)
        f, s = kernels.multitaper(x[starts[:, None] + np.arange(n)], fs, taper, freq_range, pad, remove_dc, points)
        return {"time": ((starts + (n - 1) / 2) / fs)[:, None, None], "freq": f[None, None, :], "taper": np.arange(len(taper))[None, :, None]}, s

    return _long(df, keys, samples, make, "time double, freq double, taper int")


def over_tapers(spectra: DataFrame, keys: list[str], spec_type: str = "power") -> DataFrame:
    """Mean over tapers of a spectral type; of phases the circular mean."""
    if spec_type == "complex":
        return spectra.groupBy(*keys).agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    if spec_type == "phase":
        a = F.atan2("im", "re")
        return spectra.groupBy(*keys).agg(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))).alias("value"))
    return spectra.groupBy(*keys).agg(F.avg(complex_to_spec_type(spec_type)).alias("value"))


def wavelet_spectrogram(df: DataFrame, keys: list[str], fs: float, samples: str = "samples", freqs: Sequence[float] | None = None, wavenumber: float = 6.0, pad: bool = False, buffer: float = 0.0, every: int = 1, remove_dc: bool = True) -> DataFrame:
    """(keys..., freq, time, re, im) by Morlet wavelets."""
    f = np.asarray(freqs if freqs is not None else kernels.WAVELET_FREQS, float)

    def make(x: np.ndarray):
        s = kernels.wavelet(x, fs, f, wavenumber, pad, buffer, every, remove_dc)
        return {"freq": f[:, None], "time": ((int(round(buffer * fs)) + every * np.arange(s.shape[-1])) / fs)[None, :]}, s

    return _long(df, keys, samples, make, "freq double, time double")


def bandfilter_spectrogram(df: DataFrame, keys: list[str], fs: float, samples: str = "samples", bands: Sequence[tuple[float, float]] = ((2, 8), (10, 32), (40, 100)), order: int = 4, buffer: float = 0.0, every: int = 1, remove_dc: bool = True, kind: str = "butter", **shape: float) -> DataFrame:
    """(keys..., freq, time, re, im): zero-phase bands, freq their middle, as analytic signals.

    kind: butter, cheby1, cheby2 or ellip; ripple and stop in decibels."""
    f = np.array([(low + high) / 2 for low, high in bands])

    def make(x: np.ndarray):
        s = kernels.bandfilter(x, fs, bands, order, buffer, every, remove_dc, kind, **shape)
        return {"freq": f[:, None], "time": ((int(round(buffer * fs)) + every * np.arange(s.shape[-1])) / fs)[None, :]}, s

    return _long(df, keys, samples, make, "freq double, time double")


bandfilter = bandfilter_spectrogram
SPECTROGRAMS = {"wavelet": wavelet_spectrogram, "multitaper": multitaper_spectrogram, "bandfilter": bandfilter_spectrogram}


def spectrogram(df: DataFrame, keys: list[str], fs: float, method: str = "wavelet", spec_type: str = "complex", **options) -> DataFrame:
    """(keys..., freq, time, value), or re and im for complex, averaged over tapers."""
    if method == "burst":
        return burst_analysis(df, keys, fs, **options)
    if method not in SPECTROGRAMS:
        raise ValueError(f"unknown method {method!r}: one of {sorted(SPECTROGRAMS)} or burst")
    s = SPECTROGRAMS[method](df, keys, fs, **options)
    if method == "multitaper":
        return over_tapers(s, [*keys, "freq", "time"], spec_type)
    return s if spec_type == "complex" else s.select(*keys, "freq", "time", complex_to_spec_type(spec_type).alias("value"))


def spectrum(df: DataFrame, keys: list[str], fs: float, method: str = "multitaper", spec_type: str = "complex", **options) -> DataFrame:
    """(keys..., freq, value), or re and im; other methods than multitaper average their spectrogram over time."""
    if method == "multitaper":
        return over_tapers(multitaper_spectrum(df, keys, fs, **options), [*keys, "freq"], spec_type)
    s = spectrogram(df, keys, fs, method, spec_type, **options)
    names = ["re", "im"] if spec_type == "complex" else ["value"]
    return s.groupBy(*keys, "freq").agg(*(F.avg(c).alias(c) for c in names))


def power_spectrum(df, keys, fs, method="multitaper", **options) -> DataFrame:
    return spectrum(df, keys, fs, method, "power", **options)


def power_spectrogram(df, keys, fs, method="wavelet", **options) -> DataFrame:
    return spectrogram(df, keys, fs, method, "power", **options)


def phase_spectrogram(df, keys, fs, method="wavelet", **options) -> DataFrame:
    return spectrogram(df, keys, fs, method, "phase", **options)


def itpc(spectra: DataFrame, by: list[str], trial: str, method: str = "plv") -> DataFrame:
    """(by..., itpc): how alike phases are over trials. plv, ppc, or z (Rayleigh's). Of several tapers all are
    averaged; n counts trials."""
    if method not in ("plv", "ppc", "z"):
        raise ValueError("method must be plv, ppc or z")
    a = F.atan2("im", "re")
    s = spectra.groupBy(*by).agg(F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"), F.countDistinct(trial).cast("double").alias("n"))
    r2 = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    value = {"plv": F.sqrt(r2), "ppc": div(F.col("n") * r2 - 1.0, F.col("n") - 1.0), "z": F.col("n") * r2}[method]
    return s.select(*by, value.alias("itpc"))


intertrial_phase_clustering = itpc


def burst_analysis(df: DataFrame, keys: list[str], fs: float, bands: DataFrame | None = None, threshold: float = 2.0, min_cycles: float = 3.0, samples: str = "samples", series: list[str] = (), freq_exp: float | None = None, **options) -> DataFrame:
    """(keys..., freq, first, last, n): bursts of power above threshold standard deviations.

    z-scores are over the time points of all rows of a `series` and frequency; runs shorter than min_cycles periods
    are dropped (one that reaches the last sample may be one shorter)."""
    power = spectrogram(df, keys, fs, "wavelet", "power", samples=samples, **options)
    if freq_exp is not None:
        power = power.withColumn("value", F.col("value") * F.pow("freq", F.lit(float(freq_exp))))
    if bands is not None:
        power = pool_intervals(power, "value", "freq", bands, [*keys, "time"]).join(bands.select("name", ((F.col("low") + F.col("high")) / 2).alias("freq")), "name").drop("name")
    z = stats.zscore(power, "value", [*series, "freq"]).withColumn("i", F.rint(F.col("time") * fs).cast("long"))
    r = runs(z, F.col("z") > threshold, [*keys, "freq"], "i")
    least = F.ceil(F.lit(float(min_cycles)) / F.col("freq") * fs - 1e-9)
    return r.where((F.col("n") >= least) | F.col("touches_end") & (F.col("n") >= least - 1)).drop("touches_end")


def remove_dc(df: DataFrame, samples: str = "samples") -> DataFrame:
    """samples less their mean; empty arrays stay."""
    mean = div(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x), F.size(samples))
    return df.withColumn(samples, bound(mean, lambda m: F.transform(samples, lambda x: x - m)))


def remove_evoked(long: DataFrame, value: str, by: list[str], time: str, label: str | None = None) -> DataFrame:
    """value less its mean over trials at each time point (and label)."""
    keys = [*by, time, *([label] if label else [])]
    return long.join(long.groupBy(*keys).agg(F.avg(value).alias("__evoked")), keys).withColumn(value, F.col(value) - F.col("__evoked")).drop("__evoked")


def remove_predicted(long: DataFrame, value: str, by: list[str], design: list[str]) -> DataFrame:
    """value less its least-squares prediction from the design's columns and a constant, fitted for each series.

    One aggregate sums the products of the columns; the few coefficients of a series are joined back."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in design), F.col(value).cast("double")]
    k = len(x)
    sums = long.groupBy(*by).agg(*(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)))

    def fit(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                out.append(kernels.coefficients(m).tolist())
            yield frame[list(by)].assign(__b=out)

    b = sums.mapInPandas(fit, ", ".join([*(f"`{c}` {long.schema[c].dataType.simpleString()}" for c in by), "__b array<double>"]))
    joined = long.join(b, by) if by else long.crossJoin(F.broadcast(b))  # without keys, one row
    predicted = F.get("__b", F.lit(0))
    for i, c in enumerate(design, 1):
        predicted = predicted + F.get("__b", F.lit(i)) * F.col(c)
    return joined.withColumn(value, F.col(value) - predicted).drop("__b")


def cut_windows(df: DataFrame, keys: list[str], events: DataFrame, fs: float, window: tuple[float, float], samples: str = "samples") -> DataFrame:
    """(keys..., onset, samples): windows of one length at each event that lie within the series; onsets are rounded
    down, lengths half to even."""
    low, high = (int(round(x * fs)) for x in window)
    at = F.floor(F.col("onset") * fs) + low
    joined = df.join(events, [c for c in keys if c in events.columns])
    return joined.where((at >= 0) & (at + (high - low) < F.size(samples))).select(*keys, "onset", F.slice(samples, at.cast("int") + 1, high - low + 1).alias("samples"))


def one_over_f(long: DataFrame, value: str = "value", freq: str | Column = "freq", exponent: float = 1.0) -> DataFrame:
    return long.withColumn(value, F.col(value) * F.pow(freq, F.lit(float(exponent))))
