"""Checks and exploration of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.arrays import finite
from tremor.operators.scan import running_number


def check_features(df: DataFrame, features: list[str], expected_rows: int, dominant: str, most_hz: float = 100.0) -> DataFrame:
    """check, failures and ok: rows, missing values, and for each feature values that aren't finite or are negative; the dominant frequency in [0, most_hz]. One aggregation."""
    counts = {"row_count": F.abs(F.count("*") - expected_rows)}
    for c in features:
        counts[f"missing:{c}"] = F.count_if(F.col(c).isNull() | F.isnan(c))
        counts[f"not_finite:{c}"] = F.count_if(~finite(F.col(c)))
        if c != dominant:
            counts[f"negative:{c}"] = F.count_if(F.col(c) < 0)
    counts[f"out_of_range:{dominant}"] = F.count_if((F.col(dominant) < 0) | (F.col(dominant) > most_hz))
    # plain names inside the aggregation: the checks' names hold colons
    names = list(counts)
    one = df.agg(*[counts[n].cast("long").alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("failures")) for i, n in enumerate(names)])).alias("r")
    return one.select(rows).select("r.check", "r.failures", (F.col("r.failures") == 0).alias("ok"))


def class_distribution(df: DataFrame, expected: DataFrame) -> DataFrame:
    """label, rows, expected and ok of all labels on either side."""
    counts = df.groupBy("label").agg(F.count("*").alias("rows"))
    both = counts.join(expected, "label", "full_outer")
    return both.select("label", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), (F.coalesce("rows", F.lit(0)) == F.coalesce("expected", F.lit(0))).alias("ok"))


def class_means(df: DataFrame, features: list[str]) -> DataFrame:
    return df.groupBy("label").agg(*[F.avg(c).alias(c) for c in features])


def class_balance(df: DataFrame) -> DataFrame:
    counts = df.groupBy("label").agg(F.count("*").alias("rows"))
    return counts.withColumn("percent", F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy(F.lit(1))))  # a row for each class


def window_index(df: DataFrame, order: list[str]) -> DataFrame:
    """window_index: a running number from 0 in each class, in an order of columns of any type. Rows are numbered over ranges of (label, order), less the rows of the classes before."""
    numbered = running_number(df.withColumn("_one", F.lit(1).cast("long")), ["label", *order], "_one", "_number").drop("_one")
    first = numbered.groupBy("label").agg(F.min("_number").alias("_first"))  # a row for each class
    return numbered.join(F.broadcast(first), numbered["label"].eqNullSafe(first["label"])).drop(first["label"]).withColumn("window_index", F.col("_number") - F.col("_first")).drop("_number", "_first")


def clipping(df: DataFrame, axes: list[str], limit: float) -> DataFrame:
    """label, axis, peak and clipped (the peak reaches the limit)."""
    peaks = df.groupBy("label").agg(*[F.max(F.abs(c)).alias(c) for c in axes])
    return peaks.unpivot(["label"], axes, "axis", "peak").withColumn("clipped", F.col("peak") >= limit)


def snr(df: DataFrame, value: str, baseline: str) -> DataFrame:
    """For each other class the ratio of its variance to the baseline's, in dB, and how well that separates them."""
    variances = df.groupBy("label").agg(F.var_pop(value).alias("variance"))
    base = variances.where(F.col("label") == baseline).select(F.col("variance").alias("noise"))
    rows = variances.where(F.col("label") != baseline).join(F.broadcast(base))  # one row
    db = 10 * F.log10(F.try_divide("variance", "noise"))
    return rows.select("label", "variance", "noise", db.alias("snr_db")).withColumn("separable", F.when(F.col("snr_db") > 10, "well").when(F.col("snr_db") > 3, "fairly").otherwise("poorly"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin, low, high and rows of bins of equal width; the last one holds the largest value too."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.select(value).where(F.col(value).isNotNull()).join(F.broadcast(bounds))  # one row
    # of equal values alone, all are in the first bin
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    return placed.groupBy(at.alias("bin"), "lo", width.alias("width")).agg(F.count("*").alias("rows")).select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "rows")
