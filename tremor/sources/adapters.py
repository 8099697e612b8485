"""The driver's tables seen as recordings, windows and telemetry."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.config import CLASSES, DEFAULT

#: Events come minutes to days apart; their recordings are judged on that scale.
EVENTS = replace(DEFAULT, expected_dt_ms=26e6, min_dt_ms=13e6, max_dt_ms=39e6, gap_ms=86.4e6, rate_hz=1000 / 26e6, segment_gap_ms=86.4e6, min_segment=16, window=16, hop=8, extreme=100.0)
#: Lineitems as recordings at 500 Hz, with windows small enough to overlap.
LINES = replace(DEFAULT, min_segment=512, window=128, hop=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_of(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod(k, F.lit(3)) + 1).cast("int"))


def millis(ts: Column) -> Column:
    """Milliseconds since 1970; the session's time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1000.0


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def event_samples(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """Events as samples of one recording for each user. With faults, every 50th event is set back by two days and every 77th repeats the time before it."""
    rows = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    t = millis(F.col("ts"))
    rows = rows.withColumns({"seq": F.row_number().over(order).cast("long") - 1, "t": F.when(F.col("event_id") % 50 == 0, t - 172.8e6).otherwise(t) if faults else t})
    if faults:
        rows = rows.withColumn("t", F.when(F.col("event_id") % 77 == 0, F.coalesce(F.lag("t").over(order), "t")).otherwise(F.col("t")))
    return rows.select(
        F.col("user_id").alias("stream_id"), "seq", F.col("t").alias("timestamp_ms"), F.col("value").alias("accX_raw"), (F.col("value") / 2).alias("accY_raw"),
        props_k().alias("accZ_raw"), (props_k() - 50).alias("accZ_filt"), class_of(F.col("user_id")).alias("label"),
    )


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as samples of one recording for each supplier, two milliseconds apart."""
    rows = table(spark, sf_dir, "lineitem")
    clean = [(F.col(c) + 0.0).alias(c) if c in ("l_discount", "l_tax") else F.col(c) for c in rows.columns]  # no negative zeros
    rows = rows.select(*clean)
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*rows.columns)).cast("long") - 1
    return rows.withColumn("seq", seq).select(
        F.col("l_suppkey").alias("stream_id"), "seq", (F.col("seq") * 2.0).alias("timestamp_ms"), F.col("l_quantity").alias("accX_raw"), (F.col("l_tax") * 100).alias("accY_raw"),
        (F.col("l_extendedprice") / 1000).alias("accZ_raw"), (F.col("l_discount") * 100 - 5).alias("accZ_filt"), class_of(F.col("l_suppkey")).alias("label"),
    )


def embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of 64 samples of the filtered axis: vec_id, z, label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z"), class_of(F.col("label")).alias("label"))


#: The first eight elements of an embedding serve as the eight features.
FEATURES = ("RMS_X", "RMS_Y", "RMS_Z", "Band_Power_Z_Low", "Band_Power_Z_Mid", "Band_Power_Z_High", "CrestFactor_Z", "Kurtosis_Z")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.get(z, F.lit(i)).alias(c) for i, c in enumerate(FEATURES)], class_of(F.col("label")).alias("label"))


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry messages: device, event_id (the order of arrival) and payload. Errors are broken text, views lack inference, signups lack the fan's state, clicks lack features."""
    k = props_k()
    healthy = F.least(F.lit(1.0), F.col("value") / 100)
    score = F.create_map(F.lit("healthy"), F.round(healthy, 4), F.lit("imbalanced"), F.round(1 - healthy, 4))
    inference = F.struct(class_of(F.col("user_id")).alias("prediction"), F.round(healthy, 4).alias("confidence"), score.alias("scores"))
    status = F.when(F.col("event_type") != "signup", F.struct(F.lit("on").alias("fan_state"), F.lit("ok").alias("sensor_health")))
    features = F.when(
        F.col("event_type") != "click",
        F.struct(F.struct(F.col("value").alias("x"), (F.col("value") / 2).alias("y"), k.alias("z")).alias("rms"), F.struct((k / 2).alias("low"), (k / 4).alias("mid"), (k / 8).alias("high")).alias("band_power")),
    )
    whole = F.to_json(F.struct(F.col("event_id").cast("string").alias("timestamp"), F.when(F.col("event_type") != "view", inference).alias("inference"), status.alias("status"), features.alias("features")))
    payload = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(whole)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), "event_id", payload.alias("payload"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a device's log: samples, headers (views), malformed lines (signups) and messages of the system (errors)."""
    k = props_k().cast("int").cast("string")
    sample = F.concat_ws(",", F.col("event_id").cast("string"), F.round("value", 2).cast("string"), k, F.concat(F.lit("-"), k), k, F.lit("device"))
    line = F.when(F.col("event_type") == "view", "timestamp_ms,accX_raw,accY_raw,accZ_raw,accZ_filt,label").when(F.col("event_type") == "signup", F.concat(F.lit("1,2,"), k)).when(F.col("event_type") == "error", F.concat(F.lit("sensor,reset,after,"), k, F.lit(",faults"))).otherwise(sample)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), "event_id", line.alias("value"))


def recording_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as paths of recordings: a folder named by an alias, a class or neither, and a name with another."""
    names = [*"healthy normal good imbalance imbalanced obstruction clogged blocked unknown".split()]
    pick = lambda c: F.element_at(F.array(*map(F.lit, names)), (F.pmod(c, F.lit(len(names))) + 1).cast("int"))
    path = F.concat(F.lit("recordings/"), pick(F.col("event_id")), F.lit("/"), F.col("user_id").cast("string"), F.lit("_"), pick(F.col("user_id")), F.lit("_"), F.col("event_type"), F.lit(".csv"))
    return table(spark, sf_dir, "events").select("event_id", path.alias("path"))
