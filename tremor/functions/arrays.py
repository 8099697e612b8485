"""Features of arrays of samples and of one-sided spectra, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_sum(x: Column, of=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + of(v))


def let(value: Column, of) -> Column:
    """of(value), with value computed once for a row, also inside functions of elements."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def mean(x: Column) -> Column:
    return F.try_divide(array_sum(x), F.size(x))


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(array_sum(x, lambda v: v * v), F.size(x)))


def centered(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def crest_factor(centered: Column) -> Column:
    """Largest magnitude over RMS of values whose mean is removed; 0 without any energy."""
    return F.when(rms(centered) > 0, F.array_max(F.transform(centered, F.abs)) / rms(centered)).otherwise(0.0)


def kurtosis(centered: Column, eps: float | None = None) -> Column:
    """Fisher's population kurtosis of values whose mean is removed; 0 below four values. Without variance it is null, or 0 where eps bounds it."""
    m2 = array_sum(centered, lambda v: v * v) / F.size(centered)
    m4 = array_sum(centered, lambda v: v * v * v * v) / F.size(centered)
    flat = m2 <= (eps or 0.0)
    return F.when(F.size(centered) < 4, 0.0).when(flat, F.lit(None if eps is None else 0.0)).otherwise(F.try_divide(m4, m2 * m2) - 3.0)


def hann(x: Column) -> Column:
    """Times the symmetric Hann window."""
    n = F.size(x)
    return F.transform(x, lambda v, i: v * (0.5 - 0.5 * F.cos(2 * math.pi * i / F.greatest(n - 1, F.lit(1)))))


def tapered_energy(x: Column) -> Column:
    return array_sum(hann(x), lambda v: v * v)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rfft_magnitude(signals: pd.Series) -> pd.Series:
    """One-sided magnitudes of each signal's Fourier transform over its length; null for null or empty. Signals of one length are transformed together."""
    out = [None] * len(signals)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(signals):
        if x is not None and len(x):
            by_size.setdefault(len(x), []).append(i)
    for n, rows in by_size.items():
        found = np.abs(np.fft.rfft(np.stack([np.asarray(signals.iloc[i], float) for i in rows]), axis=1)) / n
        for i, m in zip(rows, found):
            out[i] = m
    return pd.Series(out, dtype=object)


def frequency(index: Column, rate_hz: float, n: int) -> Column:
    return index * (rate_hz / n)


def dominant_frequency(mag: Column, rate_hz: float, n: int) -> Column:
    return frequency(F.array_position(mag, F.array_max(mag)) - 1, rate_hz, n)


def population_std(x: Column) -> Column:
    return let(mean(x), lambda m: F.sqrt(array_sum(x, lambda v: (v - m) * (v - m)) / F.size(x)))


def weighted(mag: Column, of) -> Column:
    """The sum of of(index, magnitude)."""
    return array_sum(F.transform(mag, lambda m, i: of(i, m)))


def spectral_centroid(mag: Column, rate_hz: float, n: int) -> Column:
    total = array_sum(mag)
    return F.when(total > 0, weighted(mag, lambda i, m: frequency(i, rate_hz, n) * m) / total).otherwise(0.0)


def spectral_bandwidth(mag: Column, centroid: Column, rate_hz: float, n: int) -> Column:
    total = array_sum(mag)
    spread = weighted(mag, lambda i, m: (frequency(i, rate_hz, n) - centroid) * (frequency(i, rate_hz, n) - centroid) * m)
    return F.when(total > 0, F.sqrt(spread / total)).otherwise(0.0)


def band_power(mag: Column, low: float, high: float, rate_hz: float, n: int, closed: bool = False, normalize: bool = True, nyquist: bool = True) -> Column:
    """Sum of squared magnitudes in [low, high), or [low, high] if closed. normalize off: of the unscaled transform; nyquist off: without the last bin."""
    bins = range(n // 2 + 1 if nyquist else n // 2)
    inside = [k for k in bins if low <= k * rate_hz / n and (k * rate_hz / n < high or closed and k * rate_hz / n <= high)]
    return _bins(mag, inside, 1.0 if normalize else float(n) * n)


def band_power_bins(mag: Column, low: float, high: float, rate_hz: float, n: int, closed: bool = False) -> Column:
    """The same by whole bins: from trunc(low / resolution) to trunc(high / resolution), the last exclusive unless closed, none above n / 2."""
    first, last = int(low / (rate_hz / n)), min(int(high / (rate_hz / n)), n // 2)
    return _bins(mag, range(first, last + 1 if closed else last), 1.0)


def _bins(mag: Column, inside: Sequence[int], scale: float) -> Column:
    if not len(inside):
        return F.lit(0.0)
    return array_sum(F.slice(mag, inside[0] + 1, len(inside)), lambda m: m * m) * scale


def finite(x: Column) -> Column:
    """Whether a value is neither missing nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
