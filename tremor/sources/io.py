"""Reading recordings, log lines and telemetry; writing tables by class, logs and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.config import CLASSES, VALUES
from tremor.functions.labels import label_from_stem, to_number
from tremor.sources.recordings import recording_files, recording_lines
from tremor.sources.shared import written

#: Texts that count as missing in recordings.
MISSING = ("", "na", "n/a", "nan", "null", "none", "<na>", "#n/a", "-nan")


def csv_lines(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """file, seq, header and value of every line of the CSV files below path that isn't blank; a file's first line is its header and has seq -1. One scan. files: recording_files of it, if they are listed."""
    return recording_lines((recording_files(spark, path) if files is None else files).where("is_csv"))


def names_of(header: Column) -> Column:
    return cells(F.regexp_replace(header, "^\ufeff", ""))


def cells(line: Column) -> Column:
    """The cells of a line, trimmed and without the quotes around them; cells of recordings have no commas inside."""
    return F.transform(F.split(line, ","), lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))


def read_samples(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """Every CSV file below path as a stream: stream_id (the file), seq (its row order) and all columns as text. lines: csv_lines of it, if they are read already.

    Cells are placed by their own file's header, so files may have other columns or another order; missing columns and empty cells are null. Of two columns of one name the first is
    taken. Only the distinct names of columns come to the driver.
    """
    lines = csv_lines(spark, path) if lines is None else lines
    names = [r.name for r in lines.where("seq = -1").select(F.explode(names_of(F.col("header"))).alias("name")).where("name <> ''").distinct().orderBy("name").collect()]
    if not names:
        return spark.createDataFrame([], "stream_id string, seq long")
    rows = lines.where("seq >= 0").select("seq", F.col("file").alias("_file"), names_of(F.col("header")).alias("_names"), cells(F.col("value")).alias("_cells"))
    cell = lambda c: F.nullif(F.get("_cells", F.array_position("_names", c).cast("int") - 1), F.lit(""))
    return rows.select(*[F.when(F.array_contains("_names", c), cell(c)).alias(c) for c in names if c not in ("stream_id", "seq")], F.col("_file").alias("stream_id"), "seq")


def file_facts(spark: SparkSession, path: str, lines: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """A row for every file below path: stream_id (the file), bytes, rows, early_reason (why it can't be judged at all: not_csv_file, cannot_read_file, empty_file; else null), missing_columns (those
    of VALUES that it lacks, joined by ', '), missing_label (it has no label column), repeated_header (a row has a cell that is its own column's name) and stem_label (the class in its name).

    Inventory and lines meet in an outer join, so empty files and other files than CSV are rows too. lines, files: csv_lines and recording_files of path, if they are read and stored already.
    """
    files = written(recording_files(spark, path), "files") if files is None else files
    lines = csv_lines(spark, path, files) if lines is None else lines
    names, own = names_of(F.col("header")), cells(F.col("value"))
    again = F.exists(F.zip_with(names, own, lambda n, c: F.coalesce((n == c) & (n != ""), F.lit(False))), lambda x: x)
    told = lines.groupBy("file").agg(F.count_if(F.col("seq") >= 0).alias("rows"), F.bool_or(again & (F.col("seq") >= 0)).alias("repeated_header"), F.any_value("header").alias("header"))
    held = names_of(F.col("header"))
    lacking = F.array_except(F.array(*map(F.lit, VALUES)), held)
    told = told.select("file", "rows", "repeated_header", F.when(F.size(lacking) > 0, F.array_join(lacking, ", ")).alias("missing_columns"), (~F.array_contains(held, "label")).alias("missing_label"))
    n = F.coalesce("rows", F.lit(0))
    early = F.when(~F.col("is_csv"), "not_csv_file").when(F.col("missing_label").isNull(), "cannot_read_file").when(n == 0, "empty_file")
    both = files.join(told, "file", "left")
    return both.select(
        F.col("file").alias("stream_id"), "bytes", n.alias("rows"), early.alias("early_reason"), "missing_columns", F.coalesce("missing_label", F.lit(False)).alias("missing_label"),
        F.coalesce("repeated_header", F.lit(False)).alias("repeated_header"), label_from_stem(F.col("file")).alias("stem_label"),
    )


def as_samples(text: DataFrame) -> DataFrame:
    """Numbers from the text of read_samples; columns that no file has are null. Texts of MISSING are no labels, and no numbers to begin with."""
    held = lambda c: F.col(c) if c in text.columns else F.lit(None).cast("string")
    label = F.when(~F.lower(F.trim(held("label"))).isin(*MISSING), held("label"))
    return text.select("stream_id", "seq", *[to_number(held(c)).alias(c) for c in VALUES], label.alias("label"))


def header_rows(text: DataFrame) -> DataFrame:
    """stream_id and repeated_header: whether a row has a cell that is its own column's name."""
    names = [c for c in text.columns if c not in ("stream_id", "seq")]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.trim(c) == c, F.lit(False))
    return text.groupBy("stream_id").agg(F.bool_or(hit).alias("repeated_header"))


def list_incoming(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, rows, status and reason of every file below path: other files than CSV and files without rows FAIL."""
    facts = file_facts(spark, path)
    reason = F.when(F.col("early_reason") == "cannot_read_file", "empty_file").otherwise(F.coalesce("early_reason", F.lit("ok")))
    return facts.select(F.col("stream_id").alias("file"), "bytes", "rows", F.when(reason == "ok", "PASS").otherwise("FAIL").alias("status"), reason.alias("reason"))


def parse_serial_lines(lines: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Samples (with the session's label) and rejects (with their kind) of a device's log lines, in column value; blank lines and headers are neither.

    A line of fewer than five fields is malformed; one whose first five aren't all numbers is a message of the system. Works on streams too.
    """
    parts = F.transform(F.split(F.trim("value"), ","), lambda p: F.trim(p))
    number = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
    kind = (
        F.when(F.col("value").isNull() | (F.trim("value") == ""), "blank").when(F.lower(F.trim("value")).startswith("timestamp"), "header").when(F.size("_parts") < 5, "malformed")
        .when(~F.forall(F.slice("_parts", 1, 5), lambda p: p.rlike(number)), "system").otherwise("sample")
    )
    marked = lines.withColumn("_parts", parts).withColumn("kind", kind)
    samples = marked.where("kind = 'sample'").select(*lines.columns, *[F.get("_parts", F.lit(i)).cast("double").alias(c) for i, c in enumerate(VALUES)], F.lit(label).alias("label"))
    return samples.drop("value"), marked.where("kind IN ('malformed', 'system')").drop("_parts")


TELEMETRY = """timestamp string, inference struct<prediction: string, confidence: double, scores: map<string, double>>, status struct<fan_state: string, sensor_health: string, connection: string>,
features struct<rms: struct<x: double, y: double, z: double>, band_power: struct<low: double, mid: double, high: double>, band_level: string>,
fft struct<frequencies: array<double>, magnitudes: array<double>>, raw struct<ax: array<double>, ay: array<double>, az: array<double>>"""


def parse_telemetry(df: DataFrame, column: str = "payload") -> DataFrame:
    """df with message: the parsed payloads that are JSON objects and have an inference; others are left out.

    The message comes out of a generator, so that a payload is parsed once however many of its fields are read.
    """
    return df.select("*", F.explode(F.array(F.from_json(column, TELEMETRY))).alias("message")).where(F.col("message.inference").isNotNull())


def telemetry_to_log(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Log rows of messages; those without prediction, confidence or the fan's state are left out, missing features are null."""
    m = "message"
    rows = parsed.select(
        *keys, F.col(f"{m}.timestamp").alias("timestamp"), F.col(f"{m}.inference.prediction").alias("prediction"), F.col(f"{m}.inference.confidence").alias("confidence"), F.col(f"{m}.status.fan_state").alias("fan_state"),
        *[F.col(f"{m}.features.rms.{a}").alias(f"rms_{a}") for a in "xyz"], *[F.col(f"{m}.features.band_power.{b}").alias(f"bp_{b}") for b in ("low", "mid", "high")],
    )
    return rows.dropna(subset=["prediction", "confidence", "fan_state"])


def explode_scores(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.select(*keys, F.explode("message.inference.scores").alias("class", "score")).withColumn("percent", F.round(F.round(F.col("score") * 100, 6), 1))


def latest_snapshot(parsed: DataFrame, device: str, order: str) -> DataFrame:
    """The last message with an inference of each device, whether or not the log takes it."""
    return parsed.groupBy(device).agg(F.max(order).alias(order), F.max_by(F.struct("message.*"), order).alias("message"))


def latest_of_payloads(df: DataFrame, device: str, order: str, column: str = "payload") -> DataFrame:
    """latest_snapshot of raw payloads: only whether a payload has an inference is read from all of them, and one payload a device is parsed whole."""
    held = df.where(F.from_json(column, "inference struct<prediction: string>")["inference"].isNotNull())
    last = held.groupBy(device).agg(F.max(order).alias(order), F.max_by(column, order).alias(column))
    return parse_telemetry(last, column).drop(column)


def history(log: DataFrame, order: str, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def export_log_csv(log: DataFrame, path: str, order: str) -> None:
    """The whole log, newest first, with headers; part files in order."""
    log.orderBy(F.desc(order)).write.mode("overwrite").option("header", True).csv(path)


def write_by_label(df: DataFrame, path: str, clean: bool = True) -> None:
    """One folder for each class. clean: what stands there goes; else rows are added."""
    df.write.mode("overwrite" if clean else "append").partitionBy("label").parquet(path)


def write_features(features: DataFrame, report: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(f"{path}/features")
    report.write.mode("overwrite").option("header", True).csv(f"{path}/report")


def to_telemetry_json(windows: DataFrame, keys: list[str], timestamp: Column, scores: Column | None = None) -> DataFrame:
    """keys and payload: the last 20 raw samples of each axis, the first 32 magnitudes, features, scores by class and status as JSON."""
    last = lambda c: F.slice(F.col(c), F.greatest(F.size(c) - 19, F.lit(1)), F.lit(20))
    parts = [timestamp.cast("string").alias("timestamp")]
    if scores is not None:
        parts.append(F.struct(F.col("prediction"), F.col("confidence"), F.map_from_arrays(F.array(*map(F.lit, CLASSES)), scores).alias("scores")).alias("inference"))
    features = F.struct(F.struct(*[F.col(f"RMS_{a.upper()}").alias(a) for a in "xyz"]).alias("rms"), F.struct(*[F.col(f"Band_Power_Z_{b.capitalize()}").alias(b) for b in ("low", "mid", "high")]).alias("band_power"))
    parts += [features.alias("features"), F.struct(F.slice("mag", 1, 32).alias("magnitudes")).alias("fft"), F.struct(last("accX_raw").alias("ax"), last("accY_raw").alias("ay"), last("accZ_raw").alias("az")).alias("raw"), F.struct(F.lit("on").alias("fan_state"), F.lit("ok").alias("sensor_health")).alias("status")]
    return windows.select(*keys, F.to_json(F.struct(*parts)).alias("payload"))
