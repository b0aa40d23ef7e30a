"""Scalar functions as column builders. Division by zero gives null, the stand-in for not-a-number."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def bound(value, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once. What a function of an array's elements refers to is worked out anew for
    each element, so that a least value of an array in there would cost the square of its length."""
    return F.get(F.transform(F.array(col(value)), use), F.lit(0))


# Transforms of correlations and coherences.
def fisherz(r) -> Column:
    return F.atanh(col(r))


def inverse_fisherz(z) -> Column:
    return F.tanh(col(z))


def plv_to_ppc(plv, n) -> Column:
    """Pairwise phase consistency from the phase-locking value over n observations."""
    n = col(n).cast("double")
    return div(n * col(plv) * col(plv) - 1.0, n - 1.0)


def ztransform_coherence(coh, df, beta: float = 23 / 20) -> Column:
    c, d = col(coh), col(df).cast("double")
    return beta * (F.sqrt(-(d - 2.0) * F.log(1.0 - c * c)) - beta)


# Complex values as re and im columns.
def power(re="re", im="im") -> Column:
    return col(re) * col(re) + col(im) * col(im)


def magnitude(re="re", im="im") -> Column:
    return F.hypot(col(re), col(im))


def phase(re="re", im="im") -> Column:
    return F.atan2(col(im), col(re))


def real(re="re", im="im") -> Column:
    return col(re)


def imag(re="re", im="im") -> Column:
    return col(im)


SPEC_TYPES = {"power": power, "magnitude": magnitude, "phase": phase, "real": real, "imag": imag}


def complex_to_spec_type(spec_type: str, re="re", im="im") -> Column:
    """One of power, magnitude, phase, real, imag."""
    if spec_type not in SPEC_TYPES:
        raise ValueError(f"unknown spec_type {spec_type!r}: one of {sorted(SPEC_TYPES)}")
    return SPEC_TYPES[spec_type](re, im)


def one_over_f_norm(x, freq, exponent: float = 1.0) -> Column:
    return col(x) * F.pow(col(freq), F.lit(float(exponent)))


# Bells.
def gaussian(x, center: float = 0.0, width: float = 1.0, amplitude: float = 1.0, baseline: float = 0.0) -> Column:
    z = (col(x) - float(center)) / float(width)
    return float(amplitude) * F.exp(-0.5 * z * z) + float(baseline)


gaussian_1d = gaussian


def gaussian_2d(x, y, center=(0.0, 0.0), width=(1.0, 1.0), amplitude: float = 1.0, baseline: float = 0.0, orientation: float = 0.0) -> Column:
    """orientation: anti-clockwise turn of the axes, in radians."""
    dx, dy = col(x) - float(center[0]), col(y) - float(center[1])
    c, s = F.cos(F.lit(float(orientation))), F.sin(F.lit(float(orientation)))
    u, v = (dx * c + dy * s) / float(width[0]), (dy * c - dx * s) / float(width[1])
    return float(amplitude) * F.exp(-0.5 * (u * u + v * v)) + float(baseline)


def gaussian_nd(point, center, precision, amplitude: float = 1.0, baseline: float = 0.0) -> Column:
    """point: array column; center: numbers; precision: inverse covariance (see kernels.precision)."""
    q = F.lit(0.0)
    for i, row in enumerate(precision):
        for j, p in enumerate(row):
            if p:
                q = q + float(p) * (F.get(col(point), F.lit(i)) - float(center[i])) * (F.get(col(point), F.lit(j)) - float(center[j]))
    return float(amplitude) * F.exp(-0.5 * q) + float(baseline)


# Explained variance.
def r_squared(ss_model, ss_total) -> Column:
    return div(ss_model, ss_total)


eta_squared = r_squared


def r_squared_partial(ss_model, ss_error) -> Column:
    return div(ss_model, col(ss_model) + col(ss_error))


eta_squared_partial = r_squared_partial


def omega_squared(ss_model, ss_total, ms_error, df_model) -> Column:
    return div(col(ss_model) - col(df_model) * col(ms_error), col(ss_total) + col(ms_error))


def omega_squared_partial(ss_model, ss_total, ms_error, df_model, n) -> Column:
    return div(col(ss_model) - col(df_model) * col(ms_error), col(ss_total) + (col(n) - col(df_model)) * col(ms_error))


def entropy(p) -> Column:
    """-p log2 p of one probability; its sum is the entropy."""
    p = col(p)
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


# Wavelet constants (Morlet).
def _morlet_scale(wavenumber: float) -> float:
    return (wavenumber + (2.0 + wavenumber * wavenumber) ** 0.5) / (4.0 * 3.141592653589793)


def wavelet_frequency_width(freq, wavenumber: float = 6.0, full: bool = True) -> Column:
    return (2.0 if full else 1.0) * col(freq) / float(wavenumber)


def wavelet_time_width(freq, wavenumber: float = 6.0, full: bool = True) -> Column:
    return (2.0 if full else 1.0) * float(wavenumber) / (2.0 * 3.141592653589793 * col(freq))


def wavelet_edge_extent(freq, wavenumber: float = 6.0) -> Column:
    """Seconds from either end within which the wavelet at freq reaches over it."""
    return 2.0**0.5 * _morlet_scale(wavenumber) / col(freq)


# Sequences and sets.
def unsorted_unique(values) -> Column:
    """An array's distinct elements, in order of first appearance."""
    return F.array_distinct(col(values))


def all_subsets(values, empty: bool = False, full: bool = True) -> Column:
    """All subsets of an array's elements, by the bits of 0 to 2**n - 1; at most 20 elements."""
    v = col(values)
    n = F.when(F.size(v) <= 20, F.size(v)).otherwise(F.raise_error(F.lit("more than 20 elements")).cast("int"))
    codes = F.sequence(F.lit(0 if empty else 1), F.call_function("shiftleft", F.lit(1), n) - (1 if full else 2))
    pick = lambda k: F.filter(v, lambda x, i: F.call_function("shiftright", k, i).bitwiseAND(F.lit(1)) == 1)
    return F.transform(codes, pick)


def iarange(start: float, stop: float, step: float = 1) -> Column:
    """Numbers from start to stop by step, stop included (within 1e-12 of it); whole numbers if all three are."""
    n = math.floor((stop - start + math.copysign(1e-12, step)) / step)
    if n < 0:
        return F.array().cast("array<double>")
    if all(float(x).is_integer() and isinstance(x, int) for x in (start, stop, step)):
        return F.sequence(F.lit(start), F.lit(start + n * step), F.lit(step))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(float(start)) + i * float(step))


def object_array_equal(a, b) -> Column:
    """Whether two ragged cells hold the same values; nulls equal nulls."""
    return col(a).eqNullSafe(col(b))


def object_array_compare(a, b) -> Column:
    """Elementwise equality of two arrays of one length; null where the lengths differ."""
    return F.when(F.size(col(a)) == F.size(col(b)), F.zip_with(col(a), col(b), lambda x, y: x.eqNullSafe(y)))


def remove_buffer(values, n: int) -> Column:
    """An array without n elements at either end."""
    return F.slice(col(values), n + 1, F.greatest(F.size(col(values)) - 2 * n, F.lit(0)))


def convert_string(binary, encoding: str = "UTF-16LE") -> Column:
    return F.decode(col(binary), encoding)


# Waveforms: arrays of samples with a trough and a later peak.
def _trough(w: Column) -> Column:
    return F.array_position(w, F.array_min(w)).cast("int")  # from 1


def _after_trough(w: Column) -> Column:
    t = _trough(w)
    return F.slice(w, t, F.size(w) - t + 1)


def trough_to_peak_width(wave, fs: float) -> Column:
    """Seconds from the least sample to the greatest behind it."""
    tail = _after_trough(col(wave))
    return (F.array_position(tail, F.array_max(tail)) - 1).cast("double") / float(fs)


def trough_width(wave, fs: float) -> Column:
    """Seconds between the first and last samples around the trough that are at least half as deep; null if an end is missing."""
    w = col(wave)

    def ends(half: Column) -> Column:
        above = F.transform(w, lambda x, i: F.when(x > half, i + 1))
        inner = lambda t: F.array_min(F.filter(above, lambda i: i > t)) - F.array_max(F.filter(above, lambda i: i < t)) - 2
        return bound(_trough(w), inner)

    return bound(F.array_min(w) / 2.0, ends).cast("double") / float(fs)


def repolarization_time(wave, fs: float, criterion: float | str = 0.75) -> Column:
    """Seconds from the peak behind the trough until criterion times the peak is reached, or "inflection"; null if it isn't."""
    if criterion == "inflection":
        return kernels.inflection(col(wave), fs)
    def first(tail: Column) -> Column:
        at = F.array_position(tail, F.array_max(tail)).cast("int")
        falling = F.slice(tail, at, F.size(tail) - at + 1)
        reached = lambda level: F.array_min(F.filter(F.transform(falling, lambda x, i: F.when(x <= level, i)), lambda i: i.isNotNull()))
        return bound(criterion * F.array_max(tail), reached)

    return bound(_after_trough(col(wave)), first).cast("double") / float(fs)


def trough_peak_amp_ratio(wave) -> Column:
    w = col(wave)
    return div(F.abs(F.array_min(w)), F.array_max(_after_trough(w)))


WAVEFORM_STATS = {"width": trough_to_peak_width, "trough_width": trough_width, "repolarization": repolarization_time, "amp_ratio": lambda wave, fs: trough_peak_amp_ratio(wave)}


def waveform_stats(wave, fs: float, stat: str = "width") -> Column:
    if stat not in WAVEFORM_STATS:
        raise ValueError(f"unknown stat {stat!r}: one of {sorted(WAVEFORM_STATS)}")
    return WAVEFORM_STATS[stat](wave, fs)
