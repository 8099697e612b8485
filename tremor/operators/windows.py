"""Count windows over segments, as one row with an array for each axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.config import AXES, CLASSES, DEFAULT, Sampling
from tremor.operators.scan import running_number
from tremor.operators.validate import no_nan

KEYS = ["stream_id", "segment_id"]
ARRAYS = ["timestamp_ms", *AXES]


def validate_segments(segments: DataFrame, p: Sampling = DEFAULT, chunk: int = 1_000_000) -> DataFrame:
    """stream_id, segment_id, status and reason: whether a whole segment may be cut into windows.

    A segment is checked in chunks of rows, whose ends meet over the small table of chunks, so a long one is not one task's.
    """
    numeric = F.lit(True)
    for c in AXES:
        numeric = numeric & no_nan(c).isNotNull()
    own, t = F.lower(F.trim("label")), no_nan("timestamp_ms")
    chunked = segments.withColumn("chunk", F.floor(F.col("idx") / chunk).cast("long"))
    dt = t - F.lag(t).over(Window.partitionBy(*KEYS, "chunk").orderBy("idx"))
    parts = chunked.withColumn("dt", dt).groupBy(*KEYS, "chunk").agg(
        F.count("*").alias("n"), F.count_if(t.isNull()).alias("no_time"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.count_if(~numeric).alias("bad"), F.min(own).alias("label"), F.max(own).alias("last_label"),
        F.min_by(t, "idx").alias("first_t"), F.max_by(t, "idx").alias("last_t"),
    )
    edges = parts.withColumn("edge", F.col("first_t") - F.lag("last_t").over(Window.partitionBy(*KEYS).orderBy("chunk")))
    facts = edges.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n", "no_time", "bad")], F.min(F.least("min_dt", "edge")).alias("min_dt"), F.max(F.greatest("max_dt", "edge")).alias("max_dt"), F.min("label").alias("label"), F.max("last_label").alias("last_label")
    )
    one_label = F.coalesce(F.col("label") == F.col("last_label"), F.lit(False))
    reason = (
        F.when(F.col("n") < p.window, "too_short").when(F.col("no_time") > 0, "non_numeric_timestamps").when(F.col("min_dt") <= 0, "non_increasing_timestamps").when(F.col("max_dt") > p.segment_gap_ms, "large_timestamp_gaps")
        .when(F.col("bad") > 0, "non_numeric_sensor_values").when(~one_label, "mixed_labels").when(~F.col("label").isin(*CLASSES), "invalid_label").otherwise("valid")
    )
    return facts.select(*KEYS, F.when(reason == "valid", "OK").otherwise("FAILED").alias("status"), reason.alias("reason"))


def _arrays(names: list[str]) -> list:
    """One array for each column, in order of idx; a group is bounded by the block's size."""
    rows = F.array_sort(F.collect_list(F.struct("idx", *names)))
    return [rows[c].alias(c) for c in names]


def sliding_windows(segments: DataFrame, size: int, hop: int, chunk: int = 4096) -> DataFrame:
    """Complete windows of size samples at 0, hop, ... of each segment: local_id, start_idx, label (the first sample's), mixed_labels (it holds two labels) and an array for each column.

    Samples are grouped once into blocks of hop, and a window joins its block with the next ones, so no row is doubled. A long segment is dealt out by
    chunks of blocks; the first blocks of a chunk are also lent to the one before it. size must be a multiple of hop.
    """
    if size % hop:
        raise ValueError("size must be a multiple of hop")
    ahead = size // hop - 1
    chunk = max(chunk, ahead)
    blocks = segments.groupBy(*KEYS, F.floor(F.col("idx") / hop).cast("long").alias("local_id")).agg(F.min_by("label", "idx").alias("label"), F.min("label").alias("_least"), F.max("label").alias("_most"), *_arrays(ARRAYS))
    own = F.floor(F.col("local_id") / chunk).cast("long")
    lent = (own > 0) & (F.col("local_id") % chunk < ahead)
    dealt = blocks.withColumn("chunk", F.explode(F.when(lent, F.array(own, own - 1)).otherwise(F.array(own))))
    order = Window.partitionBy(*KEYS, "chunk").orderBy("local_id")
    joined = [F.concat(F.col(c), *[F.coalesce(F.lead(c, i).over(order), F.array().cast("array<double>")) for i in range(1, ahead + 1)]).alias(c) for c in ARRAYS]
    # the least and the greatest label of a block tell those of its windows
    over = lambda f, c: f(F.col(c), *[F.lead(c, i).over(order) for i in range(1, ahead + 1)]) if ahead else F.col(c)
    mixed = F.coalesce(over(F.least, "_least") != over(F.greatest, "_most"), F.lit(False))
    windows = dealt.select(*KEYS, "chunk", "local_id", (F.col("local_id") * hop).alias("start_idx"), "label", mixed.alias("mixed_labels"), *joined)
    return windows.where((own == F.col("chunk")) & (F.size("timestamp_ms") == size)).drop("chunk")


def tumbling_windows(segments: DataFrame, size: int) -> DataFrame:
    """Complete windows of size samples without overlap; the rest of a segment is dropped."""
    return sliding_windows(segments, size, size)


def window_report(windows: DataFrame, p: Sampling = DEFAULT) -> DataFrame:
    n = F.size("timestamp_ms")
    return windows.select(
        *KEYS, "local_id", "label", "start_idx", (F.col("start_idx") + n).alias("end_idx_exclusive"), (F.col("start_idx") + n - 1).alias("end_idx_inclusive"),
        F.get("timestamp_ms", F.lit(0)).alias("start_ms"), F.get("timestamp_ms", n - 1).alias("end_ms"), n.cast("long").alias("size"), (n / p.rate_hz).alias("duration_s"),
    )


def cap_per_label(windows: DataFrame, most: int) -> DataFrame:
    """The first most windows of each label, in order of stream, segment and local_id.

    Ranks are taken of keys alone: first the first most of each label and share of windows, then of what is left, so that few classes don't mean few tasks.
    """
    keys = windows.select("label", *KEYS, "local_id")
    order = [*KEYS, "local_id"]
    # a salted share of windows keeps its first rows; no row of the result ranks behind most others of its share
    partial = Window.partitionBy("label", F.pmod(F.xxhash64(*order), F.lit(64))).orderBy(*order)
    first = keys.withColumn("rank", F.row_number().over(partial)).where(F.col("rank") <= most)
    kept = first.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("rank") <= most).drop("rank")
    return windows.join(kept, ["label", *order], "left_semi")


def label_shortfall(windows: DataFrame, wanted: int) -> DataFrame:
    """label, windows and missing for every class, also those with none."""
    classes = windows.sparkSession.createDataFrame([(c,) for c in CLASSES], "label string")
    counts = windows.groupBy("label").agg(F.count("*").alias("windows"))
    return F.broadcast(classes).join(counts, "label", "left").select("label", F.coalesce("windows", F.lit(0)).alias("windows"), F.greatest(F.lit(0), F.lit(wanted) - F.coalesce("windows", F.lit(0))).cast("long").alias("missing"))


def global_window_id(windows: DataFrame, chunk: int = 100_000) -> DataFrame:
    """window_id from 0 over all windows in order of class, stream (of any type), segment and local_id, without sorting all, or a long stream, in one task.

    Windows are counted by chunks of segments first; a chunk's offset is a running sum over the table of chunks.
    """
    place = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label"))
    part = ["label", *KEYS, "_chunk"]
    chunked = windows.withColumn("_chunk", F.floor(F.col("local_id") / chunk).cast("long"))
    parts = chunked.groupBy(*part).agg(F.count("*").alias("n"), F.first(place).alias("place"))
    offsets = running_number(parts, ["place", *part[1:]], "n", "offset").select(*part, "offset")
    local = F.row_number().over(Window.partitionBy(*part).orderBy("local_id")) - 1
    return chunked.withColumn("local", local).join(offsets, part).withColumn("window_id", F.col("local") + F.col("offset")).drop("local", "offset", "_chunk")


def window_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy("label").agg(F.count("*").alias("windows"))
