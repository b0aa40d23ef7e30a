"""Small numerical kernels for what column expressions can't do, applied to one series or one small table a row."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

# --- distributions --------------------------------------------------------------------------------


def beta_regularised(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 400):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + n * d) or tiny)
            c = (1.0 + n / c) or tiny
            f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * f


def f_sf(f: float, df1: float, df2: float) -> float:
    """Chance that an F variable exceeds f."""
    if not (f == f and df1 > 0 and df2 > 0):
        return float("nan")
    return 1.0 if f <= 0 else beta_regularised(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def f_survival(f, df1, df2) -> Column:
    """f_sf over columns; meant for tables of statistics, of a row for each series."""

    @pandas_udf("double")
    def run(f: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else f_sf(x, p, q) for x, p, q in zip(f, a, b)], dtype="float64")

    return run(f, df1, df2)


# --- linear models --------------------------------------------------------------------------------


def term_variance(m: np.ndarray, sizes: Sequence[int], names: Sequence[str], omega: bool, partial: bool) -> list[tuple[str, float, float, float]]:
    """(term, share of variance, F, p) from the sums of products of constant, columns and value."""
    k = len(m) - 1
    n, y, yy = m[0, 0], m[:k, k], m[k, k]
    total = yy - m[0, k] ** 2 / n

    def error(keep: list[int]) -> float:
        a, b = m[np.ix_(keep, keep)], y[keep]
        return yy - b @ np.linalg.lstsq(a, b, rcond=None)[0]

    full, dfe = error(list(range(k))), n - k
    out, at = [], 1
    for name, size in zip(names, sizes):
        extra = error([i for i in range(k) if not at <= i < at + size]) - full
        at += size
        if total <= 0:
            out.append((name, 0.0, 0.0, 1.0))
            continue
        mse = full / dfe
        if partial:
            share = (extra - size * mse) / (total + (n - size) * mse) if omega else extra / (extra + full)
        else:
            share = (extra - size * mse) / (total + mse) if omega else extra / total
        f = extra / size / mse
        out.append((name, share, f, f_sf(f, size, dfe)))
    return out


def lda(x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Linear discriminant with equal priors and a pooled covariance."""
    labels = np.unique(y)
    means = np.stack([x[y == g].mean(0) for g in labels])
    rest = np.concatenate([x[y == g] - m for g, m in zip(labels, means)])
    weights, offsets = lda_weights(means, rest.T @ rest, len(x))
    return labels[np.argmax(test @ weights - offsets, axis=1)]


def lda_weights(means: np.ndarray, cross: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of each label's score, from labels' means and the cross-products within labels of n rows."""
    precise = np.linalg.pinv(cross / max(1, n - len(means)))
    return precise @ means.T, 0.5 * np.einsum("ij,jk,ik->i", means, precise, means)


def logistic(x: np.ndarray, y: np.ndarray, test: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression by Newton steps; one against the rest beyond two labels."""
    labels = np.unique(y)
    one = np.c_[np.ones(len(x)), x]
    scores = []
    for g in labels if len(labels) > 2 else labels[1:]:
        w = np.zeros(one.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
            h = (one * (p * (1 - p))[:, None]).T @ one + ridge * np.eye(len(w))
            step = np.linalg.lstsq(h, one.T @ ((y == g) - p) - ridge * w, rcond=None)[0]
            w += step
            if np.abs(step).max() < 1e-8:
                break
        scores.append(np.c_[np.ones(len(test)), test] @ w)
    return labels[np.argmax(scores, axis=0)] if len(labels) > 2 else labels[(scores[0] > 0).astype(int)] if scores else np.full(len(test), labels[0])


def linear_svm(x: np.ndarray, y: np.ndarray, test: np.ndarray, c: float = 1.0, epochs: int = 60) -> np.ndarray:
    """Linear support vectors by dual coordinate steps; one against the rest beyond two labels."""
    labels = np.unique(y)
    one, scores = np.c_[x, np.ones(len(x))], []
    for g in labels if len(labels) > 2 else labels[1:]:
        s = np.where(y == g, 1.0, -1.0)
        a, w, q = np.zeros(len(x)), np.zeros(one.shape[1]), (one * one).sum(1)
        for e in range(epochs):
            for i in np.random.default_rng(e).permutation(len(x)):
                new = min(max(a[i] - (s[i] * (one[i] @ w) - 1) / q[i], 0.0), c)
                w += (new - a[i]) * s[i] * one[i]
                a[i] = new
        scores.append(np.c_[test, np.ones(len(test))] @ w)
    return labels[np.argmax(scores, axis=0)] if len(labels) > 2 else labels[(scores[0] > 0).astype(int)] if scores else np.full(len(test), labels[0])


DECODERS = {"lda": lda, "logistic": logistic, "svm": linear_svm}


# --- matrices -------------------------------------------------------------------------------------


def precision(width: Sequence[float] | None = None, covariance: Sequence[Sequence[float]] | None = None) -> list[list[float]]:
    """Inverse covariance of a bell, from widths or a covariance that has to be symmetric and semi-definite."""
    if covariance is None:
        return np.diag(1.0 / np.square(np.asarray(width, float))).tolist()
    c = np.asarray(covariance, float)
    if not is_symmetric(c) or not is_positive_definite(c, semi=True):
        raise ValueError("covariance must be symmetric and positive semi-definite")
    return np.linalg.pinv(c).tolist()


def is_symmetric(x) -> bool:
    x = np.asarray(x, float)
    return x.ndim == 2 and x.shape[0] == x.shape[1] and bool((x == x.T).all())


def is_positive_definite(x, semi: bool = False) -> bool:
    x = np.asarray(x, float)
    try:
        np.linalg.cholesky(x + (1e-14 * np.eye(len(x)) if semi else 0.0))
    except np.linalg.LinAlgError:
        return False
    return True


# --- signals: the last axis of each array is time -------------------------------------------------


def next_power_of_2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def frequencies(fs: float, n: int, freq_range: tuple[float, float] | None = None, two_sided: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, which of an n-point transform they are)."""
    f = np.fft.fftfreq(n, 1 / fs)
    if not two_sided:
        f = np.abs(f[: n // 2 + 1])
    low, high = freq_range or (-np.inf, np.inf)
    keep = (f >= low) & (f <= high)
    return f[keep], np.flatnonzero(keep)


def tapers(n: int, half_bandwidth: float, k: int) -> np.ndarray:
    """(k, n) discrete prolate spheroidal sequences of unit energy, the most concentrated first.

    Eigenvectors of the tridiagonal matrix that commutes with the concentration problem."""
    t = np.arange(n)
    w = half_bandwidth / n
    m = np.diag(((n - 1 - 2 * t) / 2.0) ** 2 * np.cos(2 * np.pi * w)) + np.diag(t[1:] * (n - t[1:]) / 2.0, 1) + np.diag(t[1:] * (n - t[1:]) / 2.0, -1)
    v = np.linalg.eigh(m)[1][:, ::-1][:, :k].T
    for i, x in enumerate(v):
        if (x.sum() if i % 2 == 0 else x[: n // 2].sum()) < 0:
            v[i] = -x
    return v


def taper_set(fs: float, seconds: float, freq_width: float, n_tapers: int | None = None) -> np.ndarray:
    """(k, n) tapers for windows of so many seconds, smoothing over +-freq_width, scaled by the root of fs."""
    tw = seconds * freq_width
    return tapers(int(round(fs * seconds)), tw, n_tapers or max(1, int(np.floor(2 * tw - 1)))) * np.sqrt(fs)


def multitaper(x: np.ndarray, fs: float, taper: np.ndarray, freq_range=None, pad: bool = True, remove_dc: bool = True, points: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, spectra (..., taper, frequency)) of the last axis; points: a point process, not scaled by fs."""
    if remove_dc:
        x = x - x.mean(-1, keepdims=True)
    n = x.shape[-1]
    f, at = frequencies(fs, next_power_of_2(n) if pad else n, freq_range)
    s = np.fft.fft(x[..., None, :] * taper, next_power_of_2(n) if pad else n, axis=-1)[..., at]
    return f, s if points else s / fs


def morlet_bank(n: int, fs: float, freqs: np.ndarray, wavenumber: float = 6.0) -> np.ndarray:
    """(frequency, n) Morlet wavelets in the Fourier domain, zero at and below frequency 0."""
    w = 2 * np.pi * np.fft.fftfreq(n, 1 / fs)
    scale = (wavenumber + np.sqrt(2 + wavenumber**2)) / (4 * np.pi * freqs)
    bank = np.exp(-0.5 * (scale[:, None] * w - wavenumber) ** 2) * (w > 0)
    return np.pi**-0.25 * np.sqrt(scale * (w[1] if n > 1 else 1.0) * n)[:, None] * bank


WAVELET_FREQS = 2.0 ** np.arange(1, 7.26, 0.25)


def wavelet(x: np.ndarray, fs: float, freqs: np.ndarray = WAVELET_FREQS, wavenumber: float = 6.0, pad: bool = False, buffer: float = 0.0, every: int = 1, remove_dc: bool = True) -> np.ndarray:
    """(..., frequency, time) complex spectrogram of the last axis, without `buffer` seconds at either end."""
    if remove_dc:
        x = x - x.mean(-1, keepdims=True)
    n = x.shape[-1]
    size = next_power_of_2(n) if pad else n
    s = np.fft.ifft(np.fft.fft(x, size)[..., None, :] * morlet_bank(size, fs, freqs, wavenumber), axis=-1)[..., :n]
    b = int(round(buffer * fs))
    return s[..., b : n - b : every]


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-15:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _elliptic(w, k: float):
    """cd and sn of Jacobi share this ascending recursion, from cos or sin of the argument."""
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _inverse_sn(w: complex, k: float) -> complex:
    before = k
    for v in _landen(k):
        w = w / (1 + np.sqrt(1 - w * w * before * before)) * 2 / (1 + v)
        before = v
    return 1 - 2 / np.pi * np.arccos(w + 0j)


def _prototype(kind: str, order: int, ripple: float, stop: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain at 0) of the analogue low-pass filter with edge 1."""
    m = np.arange(1, order + 1)
    angle = np.pi * (2 * m - 1) / (2 * order)
    if kind == "butter":
        return np.array([]), np.exp(1j * (angle + np.pi / 2)), 1.0
    if kind == "cheby1":
        eps = np.sqrt(10 ** (ripple / 10) - 1)
        a = np.arcsinh(1 / eps) / order
        return np.array([]), -np.sinh(a) * np.sin(angle) + 1j * np.cosh(a) * np.cos(angle), 1.0 if order % 2 else 1 / np.sqrt(1 + eps * eps)
    if kind == "cheby2":
        a = np.arcsinh(np.sqrt(10 ** (stop / 10) - 1)) / order
        zeros = 1j / np.cos(angle[np.abs(np.cos(angle)) > 1e-12])
        return zeros, 1 / (-np.sinh(a) * np.sin(angle) + 1j * np.cosh(a) * np.cos(angle)), 1.0
    if kind == "ellip":
        ep, es = (np.sqrt(10 ** (x / 10) - 1) for x in (ripple, stop))
        k1, u = ep / es, (2 * np.arange(1, order // 2 + 1) - 1) / order
        k1c = np.sqrt(1 - k1 * k1)
        kc = k1c**order * np.prod(_elliptic(np.sin(u * np.pi / 2), k1c)) ** 4
        k = np.sqrt(1 - kc * kc)
        v0 = -1j * _inverse_sn(1j / ep, k1) / order
        zeros = 1j / (k * _elliptic(np.cos(u * np.pi / 2), k))
        poles = 1j * _elliptic(np.cos((u - 1j * v0) * np.pi / 2), k)
        lone = [1j * _elliptic(np.sin(1j * v0 * np.pi / 2), k)] if order % 2 else []
        return np.concatenate([zeros, zeros.conj()]), np.concatenate([poles, poles.conj(), lone]), 1.0 if order % 2 else 1 / np.sqrt(1 + ep * ep)
    raise ValueError(f"unknown filter {kind!r}: butter, cheby1, cheby2 or ellip")


def filter_design(low: float, high: float, fs: float, kind: str = "butter", order: int = 4, ripple: float = 5.0, stop: float = 40.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain) of a digital filter: band-pass, low-pass (low <= 0) or high-pass (high >= fs / 2).

    As zeros and poles, since the polynomials of narrow low bands are lost to rounding."""
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    zeros, poles, level = _prototype(kind, order, ripple, stop)
    more = len(poles) - len(zeros)
    if low <= 0 and high >= fs / 2:
        return np.array([]), np.array([]), 1.0
    if low <= 0:
        zeros, poles, at, extra = zeros * warp(high), poles * warp(high), 0.0, [-1.0] * more
    elif high >= fs / 2:
        zeros, poles, at, extra = warp(low) / zeros, warp(low) / poles, fs / 2, [1.0] * more
    else:
        lo, hi = warp(low), warp(high)
        split = lambda r: np.concatenate([r * (hi - lo) / 2 + sign * np.sqrt((r * (hi - lo) / 2 + 0j) ** 2 - lo * hi) for sign in (1, -1)])
        zeros, poles, at, extra = split(zeros), split(poles), fs / np.pi * np.arctan(np.sqrt(lo * hi) / (2 * fs)), [1.0, -1.0] * more
    zeros, poles = (np.concatenate([(2 * fs + r) / (2 * fs - r), e]) for r, e in ((zeros, extra), (poles, [])))
    gain = level / abs(frequency_response((zeros, poles, 1.0), np.array([at]), fs)[0])
    return zeros, poles, float(gain)


def frequency_response(design: tuple[np.ndarray, np.ndarray, float], freqs: np.ndarray, fs: float) -> np.ndarray:
    e = np.exp(2j * np.pi * freqs / fs)[:, None]
    return design[2] * np.prod(e - design[0], axis=1) / np.prod(e - design[1], axis=1)


def zero_phase(x: np.ndarray, design: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """x filtered both ways over the last axis, by the squared response of a transform padded by odd reflection,
    which a recursion gives too where it has died away within the padding."""
    n = x.shape[-1]
    k = min(n - 1, 3 * n // 4 + 64) if n > 1 else 0
    left, right = 2 * x[..., :1] - x[..., k:0:-1], 2 * x[..., -1:] - x[..., -2 : -k - 2 : -1]
    y = np.concatenate([left, x, right], axis=-1) if k else x
    size = next_power_of_2(2 * y.shape[-1])
    h = np.abs(frequency_response(design, np.fft.rfftfreq(size), 1.0)) ** 2
    return np.fft.irfft(np.fft.rfft(y, size) * h, size)[..., k : k + n]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of the last axis."""
    n = x.shape[-1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * keep)


def bandfilter(x: np.ndarray, fs: float, bands: Sequence[tuple[float, float]], order: int = 4, buffer: float = 0.0, every: int = 1, remove_dc: bool = True, kind: str = "butter", **shape: float) -> np.ndarray:
    """(..., band, time) analytic signals of zero-phase band-passed x."""
    if remove_dc:
        x = x - x.mean(-1, keepdims=True)
    s = np.stack([analytic(zero_phase(x, filter_design(low, min(high, fs / 2), fs, kind, order, **shape))) for low, high in bands], axis=-2)
    b = int(round(buffer * fs))
    return s[..., b : s.shape[-1] - b : every]


def one_to_two_sided(half: np.ndarray, n: int) -> np.ndarray:
    """A full spectrum of a real series of n samples from frequencies 0 to n // 2 on the last axis."""
    return np.concatenate([half, np.conj(half[..., 1 : (n + 1) // 2])[..., ::-1]], axis=-1)


def inflection(wave: Column, fs: float) -> Column:
    """Seconds from the peak behind a waveform's trough to the first change of sign of its curvature; null if none."""

    @pandas_udf("double")
    def run(waves: pd.Series) -> pd.Series:
        out = []
        for w in waves:
            tail = np.asarray([] if w is None else w, float)
            tail = tail[tail.argmin() :] if len(tail) else tail
            tail = tail[tail.argmax() :] if len(tail) else tail
            bend = np.sign(np.gradient(np.gradient(tail))) if len(tail) > 1 else np.zeros(1)
            at = np.flatnonzero(np.diff(bend))
            out.append(at[0] / fs if len(at) else None)
        return pd.Series(out, dtype="float64")

    return run(wave)


def coefficients(m: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of the last variable on the others, from sums of products."""
    return np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through four or more points, its third derivative smooth at the second and last but one;
    not-a-number outside them. Second derivatives come from one tridiagonal elimination."""
    n, h = len(x), np.diff(x)
    slope = np.diff(y) / h
    lower, diag, upper, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    # The outer second derivatives are linear in the next two, which folds them into the first and last equation.
    diag[0] += h[0] * (1 + h[0] / h[1])
    upper[0] -= h[0] * h[0] / h[1]
    diag[-1] += h[-1] * (1 + h[-1] / h[-2])
    lower[-1] -= h[-1] * h[-1] / h[-2]
    for i in range(1, n - 2):
        w = lower[i] / diag[i - 1]
        diag[i] -= w * upper[i - 1]
        right[i] -= w * right[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (right[i] - (upper[i] * m[i + 2] if i < n - 3 else 0.0)) / diag[i]
    m[0] = m[1] * (1 + h[0] / h[1]) - m[2] * h[0] / h[1]
    m[-1] = m[-2] * (1 + h[-1] / h[-2]) - m[-3] * h[-1] / h[-2]
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    out = a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6
    return np.where((at >= x[0]) & (at <= x[-1]), out, np.nan)
