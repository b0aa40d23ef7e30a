"""Synchrony of two channels: joins of their spectra and averages of cross-products, all native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import div, plv_to_ppc, ztransform_coherence
from . import spectral
from .windows import interval_join, nearest_join


def pair(spectra1: DataFrame, spectra2: DataFrame, on: list[str]) -> DataFrame:
    """(on..., re1, im1, re2, im2): the same trial, frequency, time (and taper) of two channels."""
    return spectra1.select(*on, F.col("re").alias("re1"), F.col("im").alias("im1")).join(spectra2.select(*on, F.col("re").alias("re2"), F.col("im").alias("im2")), on)


def _cross() -> tuple[Column, Column]:
    """First times the conjugate of second."""
    r1, i1, r2, i2 = (F.col(c) for c in ("re1", "im1", "re2", "im2"))
    return r1 * r2 + i1 * i2, i1 * r2 - r1 * i2


def _finish(s: DataFrame, by: list[str], value: Column, transform, return_phase: bool, name: str) -> DataFrame:
    if transform is not None and not callable(transform):
        raise ValueError("transform must be a function of a column")
    out = [(transform(value) if transform else value).alias(name)]
    return s.select(*by, *out, *([F.atan2("im", "re").alias("phase")] if return_phase else []), "n")


def coherence(pairs: DataFrame, by: list[str], transform: str | Callable[[Column], Column] | None = None, return_phase: bool = True) -> DataFrame:
    """(by..., coherence[, phase], n) over trials (and tapers); transform "z" is the z-transform with 2n degrees of freedom."""
    re, im = _cross()
    s = pairs.groupBy(*by).agg(F.avg(re).alias("re"), F.avg(im).alias("im"), F.avg(F.col("re1") ** 2 + F.col("im1") ** 2).alias("p1"), F.avg(F.col("re2") ** 2 + F.col("im2") ** 2).alias("p2"), F.count("*").alias("n"))
    if transform == "z":
        transform = lambda c: ztransform_coherence(c, 2 * F.col("n"))
    return _finish(s, by, div(F.hypot("re", "im"), F.sqrt(F.col("p1") * F.col("p2"))), transform, return_phase, "coherence")


def plv(pairs: DataFrame, by: list[str], transform: Callable[[Column], Column] | None = None, return_phase: bool = True) -> DataFrame:
    """(by..., plv[, phase], n): length of the mean unit vector of phase differences."""
    re, im = _cross()
    size = F.hypot(re, im)
    s = pairs.groupBy(*by).agg(F.avg(div(re, size)).alias("re"), F.avg(div(im, size)).alias("im"), F.count("*").alias("n"))
    return _finish(s, by, F.hypot("re", "im"), transform, return_phase, "plv")


phase_locking_value = plv


def ppc(pairs: DataFrame, by: list[str], return_phase: bool = True) -> DataFrame:
    """(by..., ppc[, phase], n): phase-locking without the bias of few observations; may be negative."""
    return plv(pairs, by, None, return_phase).withColumn("plv", plv_to_ppc("plv", "n")).withColumnRenamed("plv", "ppc")


pairwise_phase_consistency = ppc


def single_trial(pairs: DataFrame, by: list[str], trial: str, method: str = "pseudo", stat: str = "coherence") -> DataFrame:
    """(by..., trial, coherence | plv | ppc): jackknife pseudo-values, or with "richter" the leave-one-out values themselves.

    Left-out sums are the totals less a trial's own, so trials aren't paired with each other."""
    if method not in ("pseudo", "richter"):
        raise ValueError("method must be pseudo or richter")
    if stat not in METHODS:
        raise ValueError(f"unknown stat {stat!r}: one of {sorted(METHODS)}")
    re, im = _cross()
    if stat == "coherence":
        parts = {"re": re, "im": im, "p1": F.col("re1") ** 2 + F.col("im1") ** 2, "p2": F.col("re2") ** 2 + F.col("im2") ** 2}
        value = lambda c: div(F.hypot(c["re"], c["im"]), F.sqrt(c["p1"] * c["p2"]))
    else:
        size = F.hypot(re, im)
        parts = {"re": div(re, size), "im": div(im, size), "m": F.lit(1.0)}
        length = lambda c: div(F.hypot(c["re"], c["im"]), c["m"])
        value = length if stat == "plv" else (lambda c: plv_to_ppc(length(c), c["m"]))
    own = pairs.groupBy(*by, trial).agg(*(F.sum(c).alias(n) for n, c in parts.items()))
    total = own.groupBy(*by).agg(*(F.sum(n).alias("t_" + n) for n in parts), F.count("*").alias("n"))
    j = own.join(total, by)
    left = value({n: F.col("t_" + n) - F.col(n) for n in parts})
    whole = value({n: F.col("t_" + n) for n in parts})
    return j.select(*by, trial, (left if method == "richter" else F.col("n") * whole - (F.col("n") - 1) * left).alias(stat))


METHODS = {"coherence": coherence, "plv": plv, "ppc": ppc}


def synchrony(spectra1: DataFrame, spectra2: DataFrame, on: list[str], by: list[str], method: str = "ppc", **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {sorted(METHODS)}")
    return METHODS[method](pair(spectra1, spectra2, on), by, **options)


def _step(spectra: DataFrame, on: list[str]) -> float:
    """The time between two samples of the field: the least mean step of its series."""
    s = spectra.groupBy(*on).agg(F.min("time").alias("a"), F.max("time").alias("b"), F.count_distinct("time").alias("n")).where("n > 1")
    step = s.agg(F.min((F.col("b") - F.col("a")) / (F.col("n") - 1))).first()[0]
    if step is None:
        raise ValueError("give fs: the samples' times don't tell their rate")
    return step


def spike_field_plv(events: DataFrame, spectra: DataFrame, on: list[str], windows: DataFrame, by: list[str] = ("freq",), t: str = "t", return_phase: bool = True, fs: float | None = None) -> DataFrame:
    """(by..., win, plv[, phase], n): phase of the field at events, within windows (win, start, end) that hold both ends.

    Each event meets its trial's nearest sample within half a step of the field, 1 / fs (worked out if None), so all
    events count that lie in a window and no further from the field. Several tapers count as so many trials. Bounds of
    windows and times of events are compared in whole milliseconds. Windows without events are left out."""
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    w = windows.select("win", ms("start").alias("start"), ms("end").alias("end"))
    inside = interval_join(events.select(*on, F.col(t).alias("__at")).withColumn("__ms", ms("__at")), "__ms", w, closed=True)
    met = nearest_join(inside, spectra, list(on), "__at", "time", 0.5 / fs if fs else _step(spectra, list(on)) / 2)
    size = F.hypot("re", "im")
    s = met.groupBy(*by, "win").agg(F.avg(div("re", size)).alias("re"), F.avg(div("im", size)).alias("im"), F.count("*").alias("n"))
    return _finish(s, [*by, "win"], F.hypot("re", "im"), None, return_phase, "plv")


def spike_field_ppc(events: DataFrame, spectra: DataFrame, on: list[str], windows: DataFrame, by: list[str] = ("freq",), **options) -> DataFrame:
    return spike_field_plv(events, spectra, on, windows, by, **options).withColumn("plv", plv_to_ppc("plv", "n")).withColumnRenamed("plv", "ppc")


spike_field_phase_locking_value, spike_field_pairwise_phase_consistency = spike_field_plv, spike_field_ppc


def spike_field_coherence(event_spectra: DataFrame, field_spectra: DataFrame, on: list[str], by: list[str], **options) -> DataFrame:
    """Coherence of the spectra of an event grid and of a field."""
    return coherence(pair(event_spectra, field_spectra, on), by, **options)


def synchrony_of_signals(df1: DataFrame, df2: DataFrame, trial: str, fs: float, method: str = "ppc", spec_method: str = "wavelet", samples: str = "samples", return_phase: bool = True, **options) -> DataFrame:
    """(freq, time, value..., n) over the trials of two channels of samples; tapers, if any, count as trials do."""
    extra = ["taper"] if spec_method == "multitaper" else []
    s1, s2 = (spectral.SPECTROGRAMS[spec_method](d, [trial], fs, samples, **options) for d in (df1, df2))
    return synchrony(s1, s2, [trial, "freq", "time", *extra], ["freq", "time"], method, return_phase=return_phase)


def spike_field_coupling(events: DataFrame, signals: DataFrame, trial: str, fs: float, windows: DataFrame, method: str = "ppc", spec_method: str = "wavelet", samples: str = "samples", **options) -> DataFrame:
    """(freq, win, value..., n): phase of the field's spectrogram at events, by "ppc" or "plv"; tapers count as trials do."""
    if method not in ("ppc", "plv"):
        raise ValueError("method must be ppc or plv; for coherence see spike_field_coherence")
    if spec_method not in spectral.SPECTROGRAMS:
        raise ValueError(f"unknown spec_method {spec_method!r}: one of {sorted(spectral.SPECTROGRAMS)}")
    s = spectral.SPECTROGRAMS[spec_method](signals, [trial], fs, samples, **options)
    return (spike_field_ppc if method == "ppc" else spike_field_plv)(events, s, [trial], windows)
