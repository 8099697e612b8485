"""Validation of recordings: one row for each stream, with its status and the reasons in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tremor.config import AXES, CLASSES, DEFAULT, VALUES, Sampling
from tremor.functions.labels import normalize_label
from tremor.operators.scan import with_before
from tremor.sources.shared import exists, written

#: Rows of a stream that are put in order at once.
CHUNK = 1_000_000


def in_order() -> WindowSpec:
    return Window.partitionBy("stream_id").orderBy("seq")


def no_nan(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))


def with_dt(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """dt_ms to the sample before in row order; null for the first and where either time is missing. Streams are put in order by chunks of rows."""
    t = no_nan("timestamp_ms")
    return with_before(samples, t, "_before", chunk).withColumn("dt_ms", t - F.col("_before")).drop("_before", "chunk")


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).cast("long").alias(name)


def dt_aggregates(p: Sampling) -> list[Column]:
    gap = F.col("dt_ms") > p.gap_ms
    return [
        F.avg("dt_ms").alias("mean_dt_ms"),
        F.stddev_samp("dt_ms").alias("std_dt_ms"),
        F.min("dt_ms").alias("min_dt_ms"),
        F.max("dt_ms").alias("max_dt_ms"),
        _count(F.col("dt_ms") <= 0, "num_non_increasing_ts"),
        _count((F.col("dt_ms") < p.min_dt_ms) | (F.col("dt_ms") > p.max_dt_ms), "num_bad_dt"),
        _count(gap, "num_large_gaps"),
        # halves go to the even number
        F.greatest(F.lit(0.0), F.coalesce(F.sum(F.when(gap, F.rint(F.col("dt_ms") / p.expected_dt_ms) - 1)), F.lit(0.0))).cast("long").alias("estimated_missing_samples"),
    ]


def dt_profile(samples: DataFrame, p: Sampling = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    """Sampling interval of each stream: mean, sample deviation, extremes, effective rate, its error and the jitter."""
    return with_rates(with_dt(samples, chunk).groupBy("stream_id").agg(*dt_aggregates(p)[:4]), p)


def with_rates(profile: DataFrame, p: Sampling) -> DataFrame:
    usable = F.col("mean_dt_ms") > 0
    rate = F.when(usable, F.try_divide(F.lit(1000.0), "mean_dt_ms"))
    return profile.withColumn("effective_fs", rate).withColumns({
        "fs_error_ratio": F.abs(F.col("effective_fs") - p.rate_hz) / p.rate_hz,
        "jitter_ratio": F.when(usable, F.coalesce(F.try_divide("std_dt_ms", "mean_dt_ms"), F.lit(0.0))),
    })


def duplicate_times(samples: DataFrame) -> DataFrame:
    """num_duplicate_timestamps: rows beyond the first of each time, a missing time being a value. Two aggregations on (stream, time), no distinct set in one task."""
    times = samples.groupBy("stream_id", no_nan("timestamp_ms").alias("t")).agg(F.count("*").alias("n"))
    return times.groupBy("stream_id").agg(F.sum(F.col("n") - 1).alias("num_duplicate_timestamps"))


def timing_faults(samples: DataFrame, p: Sampling = DEFAULT, chunk: int = CHUNK) -> DataFrame:
    faults = with_dt(samples, chunk).groupBy("stream_id").agg(*dt_aggregates(p)[4:])
    return faults.join(duplicate_times(samples), "stream_id")


def value_aggregates(p: Sampling) -> list[Column]:
    def any_of(test, names=VALUES) -> Column:
        out = F.lit(False)
        for c in names:
            out = out | F.coalesce(test(F.col(c)), F.lit(False))
        return out

    return [
        _count(any_of(lambda c: c.isNull() | F.isnan(c)), "num_nan_rows"),
        _count(any_of(lambda c: F.abs(c) == float("inf")), "num_inf_rows"),
        _count(any_of(lambda c: ~F.isnan(c) & (F.abs(c) > p.extreme), AXES[:3]), "num_extreme_sensor_rows"),
    ]


def value_faults(samples: DataFrame, p: Sampling = DEFAULT) -> DataFrame:
    """Rows of each stream with any missing, any infinite and any extreme value."""
    return samples.groupBy("stream_id").agg(*value_aggregates(p))


def label_aggregates() -> list[Column]:
    own = F.trim("label")
    return [F.count("*").alias("total_samples"), F.count_distinct(own).alias("n_labels"), F.min(own).alias("raw_label")]


def label_profile(samples: DataFrame) -> DataFrame:
    """The labels of each stream: how many, and them in order of first sight, joined by ';'."""
    first = samples.where(F.col("label").isNotNull()).groupBy("stream_id", F.trim("label").alias("label")).agg(F.min("seq").alias("first"))
    # as many rows as labels: few
    labels = first.groupBy("stream_id").agg(F.count("*").alias("n_labels"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]), ";").alias("labels"))
    known = samples.select("stream_id").distinct().join(labels, "stream_id", "left")
    n = F.coalesce("n_labels", F.lit(0)).cast("long")
    return known.select("stream_id", n.alias("n_labels"), F.when(n == 1, normalize_label(F.col("labels"))).otherwise(F.col("labels")).alias("label"), (F.coalesce(normalize_label(F.col("labels")) != F.lower("labels"), F.lit(False)) & (n == 1)).alias("renamed"))


#: What the reader may know of a stream's file: io.file_facts.
FILE_FACTS = "stream_id string, early_reason string, missing_columns string, missing_label boolean, repeated_header boolean, stem_label string"


def stream_facts(samples: DataFrame, p: Sampling = DEFAULT, files: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row for each stream, and each file without samples: its label, the counts of each fault and what the reader found; judged tells what they mean in a mode."""
    dt = with_dt(samples, chunk)
    facts = dt.groupBy("stream_id").agg(F.count("*").alias("total_samples"), *dt_aggregates(p), *value_aggregates(p))
    facts = with_rates(facts, p).join(duplicate_times(samples), "stream_id").join(label_profile(samples), "stream_id")
    if files is None:
        files = samples.sparkSession.createDataFrame([], FILE_FACTS).withColumn("stream_id", F.col("stream_id").cast(dict(samples.dtypes)["stream_id"]))
    facts = facts.join(files.select("stream_id", "early_reason", "missing_columns", "missing_label", "repeated_header", "stem_label"), "stream_id", "full_outer")
    counts = [c for c in facts.columns if c.startswith(("num_", "estimated_", "n_labels", "total_"))]
    return facts.fillna(0, counts).withColumn("label", F.when(F.col("early_reason").isNotNull(), F.lit(None)).when(F.col("n_labels") == 0, F.col("stem_label")).otherwise(F.col("label")))


def validate(samples: DataFrame, mode: str = "mock", p: Sampling = DEFAULT, files: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row for each stream, and each file without samples: label, the counts of each fault, reasons in a fixed order and status.

    Columns that hold text should have gone through to_number. files (io.file_facts) tells what the reader found: files that can't be judged have that reason alone. To judge in both
    modes, store stream_facts and judge them twice.
    """
    return judged(stream_facts(samples, p, files, chunk), mode, p)


def judged(facts: DataFrame, mode: str = "mock", p: Sampling = DEFAULT) -> DataFrame:
    """stream_facts with reasons and status; columns that were added to them stay.

    mode "real" makes warnings of uneven intervals, gaps, rate and jitter. A file without a label column fails in both modes, with the label in its name; one whose labels are all
    empty takes the label in its name, which warns in mode "mock" and fails in "real". Streams of one sample end after their label; those with missing columns before it.
    Statuses: the worst of the reasons, PASS with the reason ok.
    """
    real = mode == "real"
    read = F.col("early_reason").isNull()
    one = read & F.col("missing_columns").isNull()
    two = one & (F.col("total_samples") >= 2)
    no_column = F.coalesce("missing_label", F.lit(False))
    empty = one & (F.col("n_labels") == 0) & ~no_column
    label, error, soft = F.col("label"), F.col("fs_error_ratio"), "WARNING" if real else "FAIL"
    rules = [
        ("FAIL", ~read, F.col("early_reason")),
        ("FAIL", read & F.coalesce("repeated_header", F.lit(False)), F.lit("duplicated_header_rows_detected")),
        ("FAIL", read & ~one, F.concat(F.lit("missing_required_columns: "), "missing_columns")),
        ("WARNING", one & F.coalesce("renamed", F.lit(False)), F.concat(F.lit("label_normalized_to_"), label)),
        ("FAIL", empty, F.lit("missing_label_column_and_cannot_infer_from_filename")) if real else ("WARNING", empty, F.lit("label_column_empty_using_filename")),
        ("FAIL", one & (F.col("n_labels") > 1), F.lit("mixed_labels_in_file")),
        ("FAIL", one & no_column, F.lit("missing_label_column")),
        ("FAIL", one & ~F.coalesce(label.isin(*CLASSES), F.lit(False)), F.concat(F.lit("invalid_or_missing_label: "), F.coalesce(label, F.lit("None")))),
        ("FAIL", one & (F.col("total_samples") < 2), F.lit("not_enough_samples")),
        ("FAIL", two & (F.col("num_nan_rows") > 0), F.lit("nan_or_non_numeric_values_detected")),
        ("FAIL", two & (F.col("num_inf_rows") > 0), F.lit("inf_values_detected")),
        ("WARNING", two & (F.col("num_extreme_sensor_rows") > 0), F.lit("extreme_sensor_values_detected")),
        ("FAIL", two & (F.col("num_non_increasing_ts") > 0), F.lit("non_increasing_timestamp")),
        ("FAIL", two & (F.col("num_duplicate_timestamps") > 0), F.lit("duplicate_timestamps")),
        (soft, two & (F.col("num_bad_dt") > 0), F.lit("inconsistent_sampling_interval")),
        (soft, two & (F.col("num_large_gaps") > 0), F.lit("large_timestamp_gap_warning" if real else "large_timestamp_gap")),
        (soft, two & (error > p.rate_fail), F.lit(f"effective_sampling_rate_deviation_{'warning' if real else 'fail'}")),
        ("WARNING", two & (error > p.rate_warn) & (error <= p.rate_fail), F.lit("effective_sampling_rate_deviation_warning")),
        (soft, two & (F.col("jitter_ratio") > p.jitter_fail), F.lit(f"high_sampling_jitter_{'warning' if real else 'fail'}")),
    ]
    found = facts.withColumn("found", F.array_compact(F.array(*[F.when(when, F.struct(F.lit(severity).alias("severity"), text.alias("text"))) for severity, when, text in rules])))
    worst = F.when(F.exists("found", lambda x: x["severity"] == "FAIL"), "FAIL").when(F.size("found") > 0, "WARNING").otherwise("PASS")
    reasons = F.when(F.size("found") == 0, F.array(F.lit("ok"))).otherwise(F.transform("found", lambda x: x["text"]))
    return found.withColumns({"status": worst, "reasons": reasons}).drop("found", "renamed", "early_reason", "missing_columns", "missing_label", "repeated_header", "stem_label")


def report_rows(report: DataFrame) -> DataFrame:
    """The report with its reasons as text."""
    return report.withColumn("reasons", F.array_join("reasons", ";"))


def validation_summary(report: DataFrame) -> DataFrame:
    """Streams by status, in one row."""
    return report.agg(F.count("*").alias("total"), *[_count(F.col("status") == s, s.lower()) for s in ("PASS", "WARNING", "FAIL")])


def with_expected_status(clean: DataFrame, corrupted: DataFrame) -> DataFrame:
    return clean.withColumn("expected_status", F.lit("PASS")).unionByName(corrupted.withColumn("expected_status", F.lit("FAIL")))


def status_mismatch(report: DataFrame) -> DataFrame:
    """How many streams have another status than expected."""
    return report.agg(_count(F.col("expected_status") != F.col("status"), "mismatches"), F.count("*").alias("total"))


def route(samples: DataFrame, report: DataFrame, accept_warnings: bool = False) -> tuple[DataFrame, DataFrame]:
    """The samples of accepted and of rejected streams. The report has one row a stream; Spark broadcasts it while it is small."""
    good = F.col("status").isin("PASS", "WARNING") if accept_warnings else F.col("status") == "PASS"
    accepted = samples.join(report.where(good).select("stream_id"), "stream_id", "left_semi")
    return accepted, samples.join(report.where(good).select("stream_id"), "stream_id", "left_anti")


def ingest(samples: DataFrame, report: DataFrame, path: str, accept_warnings: bool = False) -> str:
    """Writes accepted and rejected streams below path in one pass, by side and by ingest: the id of this batch, from the digests of its streams. Gives the id.

    A run that is repeated, or taken up after a loss, replaces its own folders, so it adds nothing; streams of the same rows that another batch has brought are left out. What was
    written is read back from path/samples, and path/streams lists stream_id, digest, status, side and ingest.
    """
    spark = samples.sparkSession
    row = F.xxhash64(*sorted(samples.columns)).cast("decimal(38,0)")  # a sum of hashes doesn't depend on the order of rows
    content = samples.groupBy("stream_id").agg(F.sum(row).alias("_sum"), F.count("*").alias("_n")).select("stream_id", F.sha2(F.concat_ws(":", "_sum", "_n"), 256).alias("digest"))
    good = F.col("status").isin("PASS", "WARNING") if accept_warnings else F.col("status") == "PASS"
    sided = content.join(report.select("stream_id", "status"), "stream_id").select("stream_id", "digest", "status", F.when(good, "accepted").otherwise("rejected").alias("side"))
    total = sided.agg(F.sum(F.xxhash64("stream_id", "digest", "side").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).select(F.sha2(F.concat_ws(":", "s", "n"), 256).alias("id"))
    batch = total.first().id[:16]
    if exists(spark, f"{path}/streams"):
        sided = sided.join(spark.read.parquet(f"{path}/streams").where(F.col("ingest") != batch).select("stream_id", "digest"), ["stream_id", "digest"], "left_anti")
    fresh = written(sided.withColumn("ingest", F.lit(batch)), "ingest")
    for name, rows in (("samples", samples.join(fresh.select("stream_id", "side", "ingest"), "stream_id")), ("streams", fresh)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("side", "ingest").parquet(f"{path}/{name}")
    return batch


def rewrite_labels(samples: DataFrame, inferred: Column) -> tuple[DataFrame, DataFrame]:
    """Samples with the inferred label, and for each stream whether any label differed from it."""
    marked = samples.withColumn("inferred", inferred)
    differed = marked.groupBy("stream_id").agg(F.max(F.coalesce(normalize_label(F.col("label")) != F.col("inferred"), F.col("inferred").isNotNull())).alias("relabeled"))
    return marked.withColumn("label", F.col("inferred")).drop("inferred"), differed
