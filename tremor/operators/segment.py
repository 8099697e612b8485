"""Gap-free segments of recordings, by gaps and islands in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.config import CLASSES, DEFAULT, VALUES, Sampling
from tremor.functions.labels import normalize_label
from tremor.operators.scan import running_sum, with_before
from tremor.operators.validate import in_order, no_nan


def drop_bad_rows(samples: DataFrame) -> DataFrame:
    """Without rows that miss a core value; infinities stay. seq keeps its gaps, which have no meaning."""
    return samples.dropna(subset=list(VALUES))


def breakpoints(samples: DataFrame, p: Sampling = DEFAULT) -> DataFrame:
    """is_break: the time doesn't rise, or rises by more than the segment gap."""
    dt = F.col("timestamp_ms") - F.lag("timestamp_ms").over(in_order())
    return samples.withColumn("is_break", F.coalesce((dt <= 0) | (dt > p.segment_gap_ms), F.lit(False)))


def split_segments(samples: DataFrame, p: Sampling = DEFAULT) -> DataFrame:
    """segment_id (from 0 in each stream) and idx (from 0 in each segment). All windows share the partitioning and order of the stream."""
    marked = breakpoints(samples, p)
    segments = marked.withColumn("segment_id", F.sum(F.col("is_break").cast("long")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return with_idx(segments).drop("is_break")


def with_idx(segments: DataFrame) -> DataFrame:
    within = Window.partitionBy("stream_id", "segment_id").orderBy("seq")
    return segments.withColumn("idx", F.row_number().over(within).cast("long") - 1)


def split_long_streams(samples: DataFrame, p: Sampling = DEFAULT, chunk: int = 1_000_000) -> DataFrame:
    """split_segments for streams too long for one sorted partition: by chunks of rows, whose breaks are summed over a small table of chunks.

    The last time of each chunk is handed to the next. Needs a dense seq.
    """
    within = Window.partitionBy("stream_id", "chunk").orderBy("seq")
    dt = F.col("timestamp_ms") - F.col("t_before")
    marked = with_before(samples, F.col("timestamp_ms"), "t_before", chunk).withColumn("is_break", F.coalesce((dt <= 0) | (dt > p.segment_gap_ms), F.lit(False)))
    numbered = running_sum(marked, F.col("is_break").cast("long"), "segment_id", ["stream_id"])
    # a segment begins at the last break so far: of the chunk, or else of the chunks before it
    lasts = marked.groupBy("stream_id", "chunk").agg(F.max(F.when(F.col("is_break"), F.col("seq"))).alias("last"), F.min("seq").alias("least"))
    before = Window.partitionBy("stream_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = Window.partitionBy("stream_id")
    carried = lasts.select("stream_id", "chunk", F.coalesce(F.max("last").over(before), F.min("least").over(start)).alias("carried"))  # a row for each chunk of a stream
    so_far = F.max(F.when(F.col("is_break"), F.col("seq"))).over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = numbered.join(carried, ["stream_id", "chunk"]).withColumn("idx", F.col("seq") - F.coalesce(so_far, F.col("carried")))
    return placed.drop("carried", "chunk", "t_before", "is_break")


def segment_report(segments: DataFrame, p: Sampling = DEFAULT) -> DataFrame:
    """A row for each segment: place, times, samples, duration, KEPT or REJECTED, and the dense number of kept ones in their stream."""
    rows = segments.groupBy("stream_id", "segment_id").agg(
        F.min_by("label", "seq").alias("label"), F.count("*").alias("samples"), F.min_by("timestamp_ms", "seq").alias("start_ms"), F.max_by("timestamp_ms", "seq").alias("end_ms")
    )
    kept = F.col("samples") >= p.min_segment
    rows = rows.withColumns({"duration_s": F.col("samples") / p.rate_hz, "status": F.when(kept, "KEPT").otherwise("REJECTED"), "reason": F.when(kept, "valid").otherwise("too_short")})
    number = F.sum(kept.cast("long")).over(Window.partitionBy("stream_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return rows.withColumn("kept_segment_id", F.when(F.col("status") == "KEPT", number))


def kept_samples(segments: DataFrame, report: DataFrame) -> DataFrame:
    return segments.join(report.where("status = 'KEPT'").select("stream_id", "segment_id"), ["stream_id", "segment_id"], "left_semi")


def segment_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("label", "status").agg(F.count("*").alias("segments"))


def segment_precheck(samples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """stream_id, status and reason of streams that can't be segmented; others are OK. A stream's label is that of its first row, aliases resolved.

    files (stream_id, missing_columns, and missing_label if it is known, as io.file_facts gives them) adds recordings without a row, and those that lack a column; label is one of them.
    """
    valid = F.lit(True)
    for c in VALUES:
        valid = valid & no_nan(c).isNotNull()
    facts = samples.groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(valid).alias("numeric"), normalize_label(F.min_by("label", "seq")).alias("label"))
    if files is None:
        facts = facts.withColumn("lacking", F.lit(None).cast("string"))
    else:
        label = F.when(F.col("missing_label"), "label") if "missing_label" in files.columns else F.lit(None).cast("string")
        facts = facts.join(files.select("stream_id", F.nullif(F.concat_ws(", ", "missing_columns", label), F.lit("")).alias("lacking")), "stream_id", "full_outer")
    reason = (
        F.when(F.col("n").isNull(), "empty_input").when(F.col("lacking").isNotNull(), F.concat(F.lit("missing_columns: "), "lacking"))
        .when(F.col("label").isNull(), "no_label").when(~F.col("label").isin(*CLASSES), "invalid_label").when(F.col("numeric") == 0, "no_numeric_rows").otherwise("ok")
    )
    return facts.select("stream_id", F.when(reason == "ok", "OK").otherwise("FAILED").alias("status"), reason.alias("reason"))
