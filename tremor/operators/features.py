"""Time-domain features, the joined feature row and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.config import DEFAULT, Sampling
from tremor.functions import arrays as A
from tremor.operators import spectrum

FEATURES = ("RMS_X", "RMS_Y", "RMS_Z", "Band_Power_Z_Low", "Band_Power_Z_Mid", "Band_Power_Z_High", "CrestFactor_Z", "Kurtosis_Z")


def time_features(windows: DataFrame, keys: list[str]) -> DataFrame:
    z = F.col("accZ_raw")
    rows = windows.withColumn("_centered", A.centered(z))
    c = F.col("_centered")
    return rows.select(*keys, A.rms(F.col("accX_raw")).alias("RMS_X"), A.rms(F.col("accY_raw")).alias("RMS_Y"), A.rms(z).alias("RMS_Z"), A.crest_factor(c).alias("CrestFactor_Z"), A.kurtosis(c).alias("Kurtosis_Z"))


def window_quality(windows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, warnings and usable: a window needs size samples whose three raw axes are finite."""
    axes = ["accX_raw", "accY_raw", "accZ_raw"]
    any_of = lambda test: F.exists(axes[0], test) | F.exists(axes[1], test) | F.exists(axes[2], test)
    valid = F.filter(F.arrays_zip(*axes), lambda r: A.finite(r[axes[0]]) & A.finite(r[axes[1]]) & A.finite(r[axes[2]]))
    warnings = F.array_compact(F.array(F.when(any_of(lambda v: v.isNull() | F.isnan(v)), "nan_in_window"), F.when(any_of(lambda v: F.coalesce(F.abs(v) == float("inf"), F.lit(False))), "infinite_in_window")))
    return windows.select(*keys, warnings.alias("warnings"), (F.size(valid) == size).alias("usable"))


def join_spectra_windows(spectra: DataFrame, windows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spectra with their windows, and the spectra that have none, as FAILED rows."""
    return spectra.join(windows, keys), spectra.join(windows, keys, "left_anti").select(*keys, F.lit("FAILED").alias("status"))


def with_features(windows: DataFrame, p: Sampling = DEFAULT, n: int | None = None) -> DataFrame:
    """windows with mag and the eight features; everything comes from one row, so nothing is shuffled, and streams can be given too."""
    n = n or p.window
    rows = spectrum.spectra(windows)
    c = F.col("_centered")
    rows = rows.withColumn("_centered", A.centered(F.col("accZ_raw"))).withColumns(spectrum.band_columns(F.col("mag"), p.rate_hz, n))
    time = {"RMS_X": A.rms(F.col("accX_raw")), "RMS_Y": A.rms(F.col("accY_raw")), "RMS_Z": A.rms(F.col("accZ_raw")), "CrestFactor_Z": A.crest_factor(c), "Kurtosis_Z": A.kurtosis(c)}
    return rows.withColumns(time).drop("_centered")


def usable(windows: DataFrame, size: int) -> DataFrame:
    """The windows that can have features: size samples whose three raw axes are finite."""
    axes = ["accX_raw", "accY_raw", "accZ_raw"]
    good: Column = F.lit(True)
    for c in axes:
        good = good & (F.size(c) == size) & F.forall(c, A.finite)
    return windows.where(F.coalesce(good, F.lit(False)))


def features(windows: DataFrame, keys: list[str], p: Sampling = DEFAULT, n: int | None = None) -> DataFrame:
    """keys, the eight features and label of each usable window."""
    n = n or p.window
    return with_features(usable(windows, n), p, n).select(*keys, *FEATURES, "label")


def feature_report(windows: DataFrame, keys: list[str], size: int, p: Sampling = DEFAULT) -> DataFrame:
    """keys, label, status (OK, WARNING or FAILED), n_bins, freq_min and freq_max as measured, and the warnings of the window and of its spectrum as text."""
    n = F.size("accZ_filt")
    freq = F.transform(F.sequence(F.lit(0), F.size("mag") - 1), lambda k: k * (F.lit(p.rate_hz) / n))
    rows = spectrum.spectra(windows).withColumn("_freq", F.when(F.size("mag") > 0, freq))
    found = spectrum.spectrum_warnings(F.col("_freq"), F.col("mag"), size // 2 + 1, p.rate_hz / 2)
    extra = [F.col("label"), F.size("mag").alias("n_bins"), F.array_min("_freq").alias("freq_min"), F.array_max("_freq").alias("freq_max"), F.coalesce(found, F.array()).alias("found")]
    quality = window_quality(rows, [*keys, *extra], size).withColumn("warnings", F.concat("warnings", "found"))
    status = F.when(~F.col("usable"), "FAILED").when(F.size("warnings") > 0, "WARNING").otherwise("OK")
    return quality.select(*keys, "label", status.alias("status"), "n_bins", "freq_min", "freq_max", F.array_join("warnings", " | ").alias("warnings"))


def missing_per_column(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and missing, one row for each column, from a single aggregation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(c) if t == "double" else F.lit(False))).alias(c) for c, t in df.dtypes if c in columns])
    return counts.unpivot([], columns, "column", "missing")


def feature_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("rows"))


def transients(rows: DataFrame, partition: list[str], order: list[str], rms: str = "RMS_Z", threshold: float = 0.5) -> DataFrame:
    """is_transient: the RMS changed by more than threshold of the window before, whether that was a transient or not."""
    before = F.lag(rms).over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("is_transient", F.coalesce((before > 0) & (F.abs(F.col(rms) - before) / before > threshold), F.lit(False)))


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidates that is a column, whatever its case."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c.lower() in by_name:
            return by_name[c.lower()]
    raise ValueError(f"none of {candidates} is a column")


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    keep: Column = F.lit(True)
    for c in columns:
        keep = keep & A.finite(F.col(c))
    return df.where(keep)
