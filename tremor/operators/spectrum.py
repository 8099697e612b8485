"""Spectra of windows, their checks and band shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.config import BANDS, CLASSES
from tremor.functions import arrays as A


def spectra(windows: DataFrame, signal: str = "accZ_filt", name: str = "mag") -> DataFrame:
    """windows with the one-sided magnitudes of the tapered signal. No mean is removed."""
    return windows.withColumn(name, A.rfft_magnitude(A.hann(F.col(signal))))


def spectral_table(df: DataFrame, keys: list[str], rate_hz: float, n: int, mag: str = "mag") -> DataFrame:
    """All spectral values of each row."""
    m = F.col(mag)
    rows = df.select(
        *keys, mag, A.dominant_frequency(m, rate_hz, n).alias("dominant_frequency"), F.array_max(m).alias("max_magnitude"), A.mean(m).alias("mean_magnitude"), A.population_std(m).alias("std_magnitude"),
        A.array_sum(m, lambda v: v * v).alias("total_energy"), A.spectral_centroid(m, rate_hz, n).alias("spectral_centroid"),
    )
    rows = rows.withColumn("spectral_bandwidth", A.spectral_bandwidth(m, F.col("spectral_centroid"), rate_hz, n))
    return rows.withColumns(band_columns(m, rate_hz, n)).drop(mag)


def band_columns(mag: Column, rate_hz: float, n: int, prefix: str = "Band_Power_Z_", bands=BANDS) -> dict[str, Column]:
    last = bands[-1][0]
    return {f"{prefix}{name.capitalize()}": A.band_power(mag, low, high, rate_hz, n, name == last) for name, low, high in bands}


def explode_spectrum(df: DataFrame, keys: list[str], rate_hz: float, n: int) -> DataFrame:
    return df.select(*keys, F.posexplode("mag").alias("bin", "magnitude")).withColumn("frequency_hz", A.frequency(F.col("bin"), rate_hz, n))


def band_power_by_table(bins: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Power of each band of a table (band, low, high, closed): exploded bins joined with the bands by range. The table of bands is small and its size fixed."""
    f = F.col("frequency_hz")
    inside = (f >= F.col("low")) & ((f < F.col("high")) | (F.col("closed") & (f <= F.col("high"))))
    return bins.join(F.broadcast(bands), inside).groupBy(*keys, "band").agg(F.sum(F.col("magnitude") * F.col("magnitude")).alias("power"))


def spectrum_warnings(freq: Column, mag: Column, bins: int, most_hz: float) -> Column:
    """The faults of a spectrum, in order, as an array of text."""
    low, high = F.array_min(freq), F.array_max(freq)
    any_of = lambda test: F.exists(freq, test) | F.exists(mag, test)
    near = lambda x, y: F.abs(x - y) <= 1e-6
    return F.array_compact(F.array(
        F.when(F.size(freq) != bins, "invalid_bins"),
        F.when(F.size(freq) != F.size(mag), "length_mismatch"),
        F.when(~near(low, F.lit(0.0)), "unexpected_minimum_frequency"),
        F.when(~near(high, F.lit(most_hz)), "unexpected_maximum_frequency"),
        F.when(any_of(lambda v: v.isNull() | F.isnan(v)), "nan_found"),
        F.when(any_of(lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False))), "infinite_found"),
        F.when(F.exists(mag, lambda v: F.coalesce(v < 0, F.lit(False))), "negative_magnitude"),
    ))


def fft_report(spectra: DataFrame, keys: list[str], size: int, rate_hz: float, signal: str = "accZ_filt", mag: str = "mag") -> DataFrame:
    """keys, label, status and reason: whether a window was one to transform, and whether its spectrum has the bins and the top frequency that its size and rate ask for.

    n_bins, max_frequency_hz and resolution_hz are those of the spectrum at hand; null where the window was none to transform. A window without any label counts as mixed.
    """
    x, m = F.col(signal), F.col(mag)
    bins, top = F.size(m), (F.size(m) - 1) * (F.lit(float(rate_hz)) / F.size(x))
    early = (
        F.when(x.isNull() | (F.size(x) != size), "invalid_window_size").when(F.col("mixed_labels") | F.col("label").isNull(), "mixed_labels").when(~F.col("label").isin(*CLASSES), "invalid_label")
        .when(F.exists(x, lambda v: v.isNull() | F.isnan(v)), "non_numeric_values")
    )
    near = F.abs(top - rate_hz / 2) <= 1e-8 + 1e-5 * rate_hz / 2
    reason = F.coalesce(early, F.when(m.isNull() | (bins != size // 2 + 1), "invalid_bins").when(~near, "invalid_max_frequency"), F.lit("valid"))
    own = lambda c, name: F.when(early.isNull() & m.isNotNull(), c).alias(name)
    return spectra.select(
        *keys, "label", F.when(reason == "valid", "OK").otherwise("FAIL").alias("status"), reason.alias("reason"), own(bins, "n_bins"), own(top, "max_frequency_hz"),
        own(F.lit(float(rate_hz)) / F.size(x), "resolution_hz"), F.lit(False).alias("dc_removed"),
    )


def band_share(mag: Column, rate_hz: float, n: int) -> dict[str, Column]:
    """Shares of the unscaled power up to 300 Hz: at most 50 Hz, at most 200 Hz, above."""
    f = [k * rate_hz / n for k in range(n // 2 + 1)]
    bins = {"low": [k for k, v in enumerate(f) if v <= 50], "mid": [k for k, v in enumerate(f) if 50 < v <= 200], "high": [k for k, v in enumerate(f) if 200 < v <= 300]}
    power = {b: A._bins(mag, inside, float(n) * n) for b, inside in bins.items()}
    total = power["low"] + power["mid"] + power["high"] + 1e-9
    return {b: p / total for b, p in power.items()}


def band_level(high: Column, mid: Column) -> Column:
    return F.when(high > 0.3, "high").when(mid > 0.3, "medium").otherwise("normal")
