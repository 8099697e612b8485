"""One query for each operator, over the driver's tables through their adapters. Doubles are rounded so that both engines give the same digits."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.config import BANDS, CLASSES, VALUES
from tremor.functions import arrays as A
from tremor.functions import labels as L
from tremor.operators import checks, features, model, scan, segment, spectrum, training, validate, windows
from tremor.sources import adapters as ad
from tremor.sources import io
from tremor.sources.recordings import recording_files, write_recordings
from tremor.sources.shared import new_path
from tremor.sources.shared import written as stored
from tremor.sources.tables import write_bucketed

KEYS = ["stream_id", "segment_id", "local_id"]
RATE, SIZE, N = 500.0, 128, 64


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "events")


def line_windows(spark: SparkSession, d: str) -> DataFrame:
    segments = segment.split_segments(ad.line_samples(spark, d), ad.LINES)
    return windows.sliding_windows(segments, SIZE, ad.LINES.hop)


def event_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.split_segments(ad.event_samples(spark, d, True), ad.EVENTS)


def embedding_spectra(spark: SparkSession, d: str) -> DataFrame:
    return spectrum.spectra(ad.embedding_windows(spark, d), "z")


# Labels and scalars


def q_normalize_label(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.upper(F.regexp_extract("path", "recordings/([a-z]+)/", 1)))
    return ad.recording_paths(spark, d).groupBy(raw.alias("raw"), L.normalize_label(raw).alias("label")).agg(F.count("*").alias("n"))


def q_path_labels(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return ad.recording_paths(spark, d).groupBy(L.label_from_stem(p).alias("by_stem"), L.label_from_path(p).alias("by_path"), L.label_from_path_first(p).alias("by_first")).agg(F.count("*").alias("n"))


def q_rewrite_labels(spark: SparkSession, d: str) -> DataFrame:
    samples = ad.event_samples(spark, d).withColumn("path", F.concat(F.lit("recordings/"), F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("stream_id") % 2 + 1).cast("int")), F.lit("/a.csv")))
    relabeled, differed = validate.rewrite_labels(samples, L.label_from_path(F.col("path")))
    return relabeled.groupBy("stream_id", "label").agg(F.count("*").alias("n")).join(differed, "stream_id")


def q_to_number(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("string")
    text = F.when(F.col("event_type") == "error", "abc").when(F.col("event_type") == "view", F.concat(F.lit(" "), v, F.lit(" "))).when(F.col("event_type") == "signup", "nan").when(F.col("event_type") == "click", F.concat(v, F.lit("d"))).otherwise(v)
    return rounded(events(spark, d).select("event_id", L.to_number(text).alias("number")))


def q_drop_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    samples = ad.event_samples(spark, d)
    holes = samples.withColumn("accX_raw", F.when(F.col("seq") % 7 != 0, F.col("accX_raw")))
    return segment.drop_bad_rows(holes).groupBy("stream_id").agg(F.count("*").alias("n"))


def q_header_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = ad.log_lines(spark, d)
    cells = F.split("value", ",")
    text = lines.select(F.col("device").alias("stream_id"), F.col("event_id").alias("seq"), F.get(cells, F.lit(0)).alias("timestamp_ms"), F.get(cells, F.lit(1)).alias("accX_raw"))
    return io.header_rows(text)


def q_resolve_column(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d)
    return df.select("event_id", F.col(features.resolve_column(df, ["accel_x", "VALUE", "ts"])).alias("x")).groupBy().agg(F.count("x").alias("n"), F.round(F.sum("x"), 2).alias("total"))


def q_scale_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.table(spark, d, "lineitem").select("l_suppkey", L.scale_counts(F.col("l_quantity"), 2048.0).alias("g"), L.scale_counts(F.col("l_extendedprice"), 16384.0).alias("fine"), (F.col("l_partkey") / 1000.0).alias("ms"))
    return rounded(rows.groupBy("l_suppkey").agg(F.sum("g").alias("g"), F.sum("fine").alias("fine"), F.max("ms").alias("ms")))


def q_finite_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.line_samples(spark, d)
    odd = rows.withColumn("accX_raw", F.when(F.col("seq") % 11 == 0, F.lit(float("inf"))).when(F.col("seq") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("accX_raw")))
    return features.finite_rows(odd, ["accX_raw", "accY_raw", "accZ_raw"]).groupBy("stream_id").agg(F.count("*").alias("n"))


def q_confidence_level(spark: SparkSession, d: str) -> DataFrame:
    c = F.round(F.col("value") / 100, 1)
    return events(spark, d).groupBy(L.confidence_level(c).alias("level"), L.confidence_level(c, True).alias("bar")).agg(F.count("*").alias("n"))


# Validation


def q_dt_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validate.dt_profile(ad.event_samples(spark, d, True), ad.EVENTS), 2)


def q_timing_faults(spark: SparkSession, d: str) -> DataFrame:
    return validate.timing_faults(ad.event_samples(spark, d, True), ad.EVENTS)


def q_value_faults(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("seq") % 17 == 0, F.lit(None)).when(F.col("seq") % 19 == 0, F.lit(float("-inf"))).otherwise(F.col("accX_raw"))
    return validate.value_faults(ad.event_samples(spark, d).withColumn("accX_raw", x), ad.EVENTS)


def odd_labels(spark: SparkSession, d: str) -> DataFrame:
    """Recordings with one label, an alias, several or none, by stream."""
    kind = F.col("stream_id") % 4
    label = F.when(kind == 1, "Normal").when((kind == 2) & (F.col("seq") % 2 == 1), "obstruction").when(kind == 3, F.lit(None)).otherwise(F.col("label"))
    return ad.event_samples(spark, d, True).withColumn("label", label)


def q_label_profile(spark: SparkSession, d: str) -> DataFrame:
    return validate.label_profile(odd_labels(spark, d))


def q_validate_mock(spark: SparkSession, d: str) -> DataFrame:
    report = validate.report_rows(validate.validate(odd_labels(spark, d), "mock", ad.EVENTS))
    return report.select("stream_id", "label", "total_samples", "status", "reasons")


def q_validate_real(spark: SparkSession, d: str) -> DataFrame:
    report = validate.report_rows(validate.validate(odd_labels(spark, d), "real", ad.EVENTS))
    return report.select("stream_id", "label", "total_samples", "status", "reasons")


def line_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(ad.line_samples(spark, d), "mock", ad.LINES)


def q_validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.validation_summary(validate.validate(odd_labels(spark, d), "real", ad.EVENTS).select("status").unionByName(line_report(spark, d).select("status")))


def q_status_mismatch(spark: SparkSession, d: str) -> DataFrame:
    clean, corrupted = ad.line_samples(spark, d), ad.event_samples(spark, d, True)
    reports = validate.with_expected_status(validate.validate(clean, "mock", ad.LINES).select("stream_id", "status"), validate.validate(corrupted, "mock", ad.EVENTS).select("stream_id", "status"))
    return validate.status_mismatch(reports)


def q_route(spark: SparkSession, d: str) -> DataFrame:
    samples = ad.line_samples(spark, d).withColumn("accX_raw", F.when((F.col("stream_id") % 3 == 0) & (F.col("seq") == 5), F.lit(5000.0)).otherwise(F.col("accX_raw")))
    report = validate.validate(samples, "real", ad.LINES)
    out = None
    for flag in (False, True):
        for name, part in zip(("accepted", "rejected"), validate.route(samples, report, flag)):
            rows = part.agg(F.count("*").alias("samples"), F.count_distinct("stream_id").alias("streams")).select(F.lit(flag).alias("accept_warnings"), F.lit(name).alias("side"), "samples", "streams")
            out = rows if out is None else out.unionByName(rows)
    return out


def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of even suppliers brought in twice, then those of all: what is stored, by side."""
    path = new_path(spark, "ingested")
    samples = ad.line_samples(spark, d).withColumn("accX_raw", F.when((F.col("stream_id") % 3 == 0) & (F.col("seq") == 5), F.lit(5000.0)).otherwise(F.col("accX_raw")))
    samples = stored(samples, "samples")  # put in order once; validation and three ingests read them
    report = stored(validate.validate(samples, "real", ad.LINES).select("stream_id", "status"), "report")
    for some in (samples.where("stream_id % 2 = 0"), samples.where("stream_id % 2 = 0"), samples):
        validate.ingest(some, report, path)
    return spark.read.parquet(f"{path}/samples").groupBy("side").agg(F.count("*").alias("samples"), F.count_distinct("stream_id").alias("streams"), F.count_distinct("ingest").alias("ingests"))


# Segments


def q_segment_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segment.segment_report(event_segments(spark, d), ad.EVENTS), 3)


def q_split_long_streams(spark: SparkSession, d: str) -> DataFrame:
    rows = segment.split_long_streams(ad.event_samples(spark, d, True), ad.EVENTS, chunk=10)
    return rows.groupBy("stream_id", "segment_id").agg(F.count("*").alias("samples"), F.min("seq").alias("first"), F.max("idx").alias("last_idx"))


def q_kept_samples(spark: SparkSession, d: str) -> DataFrame:
    segments = event_segments(spark, d)
    kept = segment.kept_samples(segments, segment.segment_report(segments, ad.EVENTS))
    return rounded(kept.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("accX_raw").alias("x")), 4)


def q_segment_summary(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment_summary(segment.segment_report(event_segments(spark, d), ad.EVENTS))


def q_segment_precheck(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("stream_id") % 5
    # the first row's label counts, by its alias
    label = F.when(kind == 1, F.lit(None)).when(kind == 2, "broken").when((kind == 0) & (F.col("seq") > 0), "broken").when(kind == 4, " Normal ").otherwise(F.col("label"))
    samples = ad.event_samples(spark, d).withColumn("label", label).withColumn("accX_raw", F.when(kind != 3, F.col("accX_raw")))
    return segment.segment_precheck(samples)


# Windows


def q_validate_segments(spark: SparkSession, d: str) -> DataFrame:
    return windows.validate_segments(event_segments(spark, d), ad.EVENTS)


def q_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    w = line_windows(spark, d)
    return rounded(w.select(*KEYS, "start_idx", "label", A.array_sum(F.col("accX_raw")).alias("x"), A.array_sum(F.col("accZ_filt")).alias("z"), F.get("accZ_raw", F.lit(0)).alias("first"), F.get("accZ_raw", F.lit(SIZE - 1)).alias("last")))


def q_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows.tumbling_windows(segment.split_segments(ad.line_samples(spark, d), ad.LINES), SIZE)
    return rounded(w.select(*KEYS, "start_idx", A.array_sum(F.col("accX_raw")).alias("x")), 4)


def q_window_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_report(line_windows(spark, d), ad.LINES))


def q_cap_per_label(spark: SparkSession, d: str) -> DataFrame:
    return windows.cap_per_label(line_windows(spark, d).select(*KEYS, "label"), 100)


def q_label_shortfall(spark: SparkSession, d: str) -> DataFrame:
    return windows.label_shortfall(line_windows(spark, d).where("label <> 'obstruction'").select("label"), 250)


def q_global_window_id(spark: SparkSession, d: str) -> DataFrame:
    return windows.global_window_id(line_windows(spark, d).select(*KEYS, "label"))


def q_window_summary(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_summary(line_windows(spark, d).select("label"))


# Spectra


def q_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.explode_spectrum(embedding_spectra(spark, d), ["vec_id"], RATE, N), 8)


def q_fft_report(spark: SparkSession, d: str) -> DataFrame:
    """Windows of every seventh recording change their label at sample 100; some windows are cut short, and some labels unknown."""
    samples = ad.line_samples(spark, d).withColumn("label", F.when(F.col("stream_id") % 7 != 0, F.col("label")).when(F.col("seq") < 100, "healthy").otherwise("obstruction"))
    w = windows.sliding_windows(segment.split_segments(samples, ad.LINES), SIZE, ad.LINES.hop)
    odd = w.withColumn("accZ_filt", F.when(F.col("local_id") == 3, F.slice("accZ_filt", 1, 100)).otherwise(F.col("accZ_filt"))).withColumn("label", F.when(F.col("stream_id") % 10 == 0, "unknown").otherwise(F.col("label")))
    return spectrum.fft_report(spectrum.spectra(odd), KEYS, SIZE, RATE)


def q_spectrum_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding_spectra(spark, d)
    k = F.col("vec_id") % 5
    mag = F.when(k == 1, F.slice("mag", 1, 20)).when(k == 2, F.transform("mag", lambda m: -m)).when(k == 3, F.transform("mag", lambda m, i: F.when(i == 3, F.lit(float("nan"))).otherwise(m))).otherwise(F.col("mag"))
    freq = F.transform(F.sequence(F.lit(0), F.when(k == 4, 31).otherwise(32)), lambda i: i * (RATE / N))
    found = spectrum.spectrum_warnings(F.col("freq"), F.col("m"), N // 2 + 1, RATE / 2)
    return rows.select("vec_id", mag.alias("m"), freq.alias("freq")).select("vec_id", F.array_join(found, " | ").alias("warnings"))


def q_spectral_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spectrum.spectral_table(embedding_spectra(spark, d), ["vec_id"], RATE, N))


def q_band_power_by_table(spark: SparkSession, d: str) -> DataFrame:
    bins = spectrum.explode_spectrum(embedding_spectra(spark, d), ["vec_id"], RATE, N)
    bands = spark.createDataFrame([(n, lo, hi, n == "high") for n, lo, hi in BANDS], "band string, low double, high double, closed boolean")
    return rounded(spectrum.band_power_by_table(bins, bands, ["vec_id"]), 8)


def q_band_power_bins(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mag")
    return rounded(embedding_spectra(spark, d).select("vec_id", *[A.band_power_bins(m, lo, hi, RATE, N, n == "high").alias(n) for n, lo, hi in BANDS]), 8)


def q_band_power_unscaled(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mag")
    return rounded(embedding_spectra(spark, d).select("vec_id", *[A.band_power(m, lo, hi, RATE, N, False, False, False).alias(n) for n, lo, hi in BANDS]), 6)


def q_band_share(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding_spectra(spark, d)
    shares = rows.select("vec_id", *[c.alias(b) for b, c in spectrum.band_share(F.col("mag"), RATE, N).items()])
    return rounded(shares.withColumn("level", spectrum.band_level(F.col("high"), F.col("mid"))))


def q_tapered_energy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ad.embedding_windows(spark, d).select("vec_id", A.tapered_energy(F.col("z")).alias("energy")), 8)


# Features


def q_time_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.time_features(line_windows(spark, d), KEYS))


def q_edge_kurtosis(spark: SparkSession, d: str) -> DataFrame:
    flat = F.when(F.col("stream_id") % 4 == 0, F.transform("accZ_raw", lambda v: F.lit(1.5))).otherwise(F.col("accZ_raw"))
    rows = line_windows(spark, d).select(*KEYS, A.centered(flat).alias("c"))
    return rounded(rows.select(*KEYS, A.kurtosis(F.col("c"), 1e-10).alias("kurtosis"), A.crest_factor(F.when(F.array_max("c") > 1e-9, F.col("c")).otherwise(F.transform("c", lambda v: F.lit(0.0)))).alias("crest")))


def q_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.features(line_windows(spark, d), KEYS, ad.LINES, SIZE))


def holed_windows(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform("accX_raw", lambda v, i: F.when((F.col("stream_id") % 9 == 0) & (i == 7), F.lit(None)).when((F.col("stream_id") % 9 == 1) & (i == 9), F.lit(float("inf"))).otherwise(v))
    return line_windows(spark, d).withColumn("accX_raw", x)


def q_window_quality(spark: SparkSession, d: str) -> DataFrame:
    return features.window_quality(holed_windows(spark, d), KEYS, SIZE).withColumn("warnings", F.array_join("warnings", "|"))


def q_feature_report(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_report(holed_windows(spark, d), KEYS, SIZE, ad.LINES)


def q_join_spectra_windows(spark: SparkSession, d: str) -> DataFrame:
    w = line_windows(spark, d)
    spectra = spectrum.spectra(w).select(*KEYS, "mag")
    both, lost = features.join_spectra_windows(spectra, w.where("local_id <> 2").select(*KEYS, "label"), KEYS)
    return both.select(*KEYS, F.lit("OK").alias("status")).unionByName(lost)


def bucketed_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spectra and windows (of all but the second hop) as tables bucketed by window."""
    w, name = line_windows(spark, d), f"w{uuid.uuid4().hex}"
    spectra = write_bucketed(spectrum.spectra(w).select(*KEYS, "mag"), f"{name}_spectra", new_path(spark, "spectra"), KEYS)
    return spectra, write_bucketed(w.where("local_id <> 2").select(*KEYS, "label"), f"{name}_windows", new_path(spark, "windows"), KEYS, partition="label")


def q_join_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """join_spectra_windows on bucketed tables, windows in folders of their class."""
    both, lost = features.join_spectra_windows(*bucketed_windows(spark, d), KEYS)
    return both.select(*KEYS, F.lit("OK").alias("status")).unionByName(lost)


def q_kept_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """kept_samples on bucketed tables: samples and report dealt by segment."""
    segments, name = event_segments(spark, d), f"s{uuid.uuid4().hex}"
    keys = KEYS[:2]
    samples = write_bucketed(segments, f"{name}_samples", new_path(spark, "samples"), keys)
    report = write_bucketed(segment.segment_report(samples, ad.EVENTS), f"{name}_report", new_path(spark, "report"), keys)
    kept = segment.kept_samples(samples, report)
    return rounded(kept.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("accX_raw").alias("x")), 4)


def q_feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_summary(features.features(line_windows(spark, d), KEYS, ad.LINES, SIZE))


def q_missing_per_column(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.embedding_features(spark, d)
    return features.missing_per_column(rows.withColumn("RMS_X", F.when(F.col("vec_id") % 6 != 0, F.col("RMS_X"))), list(ad.FEATURES))


def q_high_pass(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.high_pass(ad.line_samples(spark, d), {"accZ_raw": "hp_z", "accX_raw": "hp_x"}, 0.9936, chunk=100, warmup=500)
    return rounded(rows.select("stream_id", "seq", "hp_x", "hp_z"))


def q_transients(spark: SparkSession, d: str) -> DataFrame:
    w = windows.sliding_windows(segment.split_segments(ad.event_samples(spark, d, True), ad.EVENTS), 16, 8)
    rows = w.select(*KEYS, A.rms(F.col("accZ_filt")).alias("RMS_Z"))
    return rounded(features.transients(rows, ["stream_id"], ["segment_id", "local_id"], threshold=0.1))


# Checks


def q_check_features(spark: SparkSession, d: str) -> DataFrame:
    return checks.check_features(ad.embedding_features(spark, d), list(ad.FEATURES), 500, "RMS_Y", 0.2)


def q_class_distribution(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("healthy", 200), ("imbalanced", 150), ("other", 1)], "label string, expected long")
    return checks.class_distribution(ad.embedding_features(spark, d), expected)


def q_class_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.class_means(ad.embedding_features(spark, d), list(ad.FEATURES)))


def q_class_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.class_balance(ad.embedding_features(spark, d)))


def q_window_index(spark: SparkSession, d: str) -> DataFrame:
    return checks.window_index(ad.embedding_features(spark, d).select("vec_id", "label"), ["vec_id"])


def q_clipping(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.clipping(ad.event_samples(spark, d), ["accX_raw", "accY_raw", "accZ_filt"], 50.0))


def q_snr(spark: SparkSession, d: str) -> DataFrame:
    loud = F.when(F.col("label") == "obstruction", F.col("accX_raw") * 4).otherwise(F.col("accX_raw"))
    return rounded(checks.snr(ad.event_samples(spark, d).withColumn("accX_raw", loud), "accX_raw", "healthy"), 4)


def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(checks.histogram(ad.event_samples(spark, d), "accX_raw"), 4)


# Models


def q_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = model.clean_features(ad.embedding_features(spark, d), list(ad.FEATURES))
    return model.stratified_split(rows, "vec_id").select("vec_id", "label", "is_test")


def q_scaled_features(spark: SparkSession, d: str) -> DataFrame:
    split = model.stratified_split(ad.embedding_features(spark, d), "vec_id")
    scaler = model.fit_scaler(split.where("NOT is_test"), list(ad.FEATURES))
    return rounded(scaler.apply(split).select("vec_id", *ad.FEATURES))


def q_encode_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.embedding_features(spark, d)
    labels = model.fit_labels(rows)
    code = model.encode(F.col("label"), labels)
    return rows.groupBy("label", code.cast("long").alias("code"), model.decode(code, labels).alias("decoded")).agg(F.count("*").alias("n"))


def rule_linear(features_: tuple[str, ...]) -> model.Linear:
    scaler = model.Scaler(features_, (0.01,) * 8, (0.1,) * 8)
    return model.Linear(scaler, tuple(tuple(math.cos(5 * i + j) for j in range(8)) for i in range(3)), (0.1, -0.2, 0.05), CLASSES)


def scores(df: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(df.select(*keys, "prediction", "confidence", *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(3)]))


def q_score_logreg(spark: SparkSession, d: str) -> DataFrame:
    return scores(model.score_logreg(ad.embedding_features(spark, d), rule_linear(ad.FEATURES)), ["vec_id"])


def q_score_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return scores(model.score_logreg(ad.embedding_features(spark, d), rule_linear(ad.FEATURES), "sigmoid"), ["vec_id"])


def q_score_mlp(spark: SparkSession, d: str) -> DataFrame:
    dense = model.Dense.of_rule(model.Scaler(ad.FEATURES, (0.01,) * 8, (0.1,) * 8), (8, 16, 8, 3), CLASSES)
    return scores(model.score_mlp(ad.embedding_features(spark, d), dense), ["vec_id"])


def training_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    split = model.stratified_split(model.clean_features(ad.embedding_features(spark, d), list(ad.FEATURES)), "vec_id")
    return split.where("NOT is_test"), split.where("is_test")


def q_fit_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Trains on the training share and reports on the rest: no SQL gives an optimizer's weights."""
    train, test = training_rows(spark, d)
    fitted = training.fit_logreg(train, list(ad.FEATURES))
    return rounded(model.classification_report(model.score_logreg(test, fitted), list(CLASSES)), 4)


def q_logreg_gradient(spark: SparkSession, d: str) -> DataFrame:
    """The objective's gradient at the weights that Newton's steps come to, for all rows: zeros."""
    rows = model.clean_features(ad.embedding_features(spark, d), list(ad.FEATURES))
    return rounded(training.regression_gradient(rows, training.fit_logreg(rows, list(ad.FEATURES))), 8)


def q_model_table(spark: SparkSession, d: str) -> DataFrame:
    return model.model_table(spark, training.fit_logreg(training_rows(spark, d)[0], list(ad.FEATURES)))


def q_model_table_of_scaler(spark: SparkSession, d: str) -> DataFrame:
    """The parameter table of a scaler fitted to all rows, with weights by a rule."""
    rule = rule_linear(ad.FEATURES)
    return rounded(model.model_table(spark, model.Linear(model.fit_scaler(ad.embedding_features(spark, d), list(ad.FEATURES)), rule.weights, rule.bias, rule.labels)))


def q_fit_mlp(spark: SparkSession, d: str) -> DataFrame:
    """Trains the dense classifier and counts its predictions on the rest."""
    train, test = training_rows(spark, d)
    fitted, _ = training.fit_mlp(train, list(ad.FEATURES), "vec_id")
    return model.score_mlp(test, fitted).groupBy("label", F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))


def q_mlp_gradient(spark: SparkSession, d: str) -> DataFrame:
    """A network's summed gradient against differences of scored losses, layer by layer over all rows: they agree to four digits, so the gap is zero."""
    rows = ad.embedding_features(spark, d)
    network = model.Dense.of_rule(model.fit_scaler(rows, list(ad.FEATURES)), (8, 16, 8, 3), CLASSES)
    told = []
    for layer in range(3):
        slope, differences = training.network_slope(rows, network, layer)
        told.append(differences.select(F.lit(layer).cast("long").alias("layer"), (F.round(F.col("slope") - slope, 4) + 0.0).alias("gap"), "n"))
    return told[0].unionByName(told[1]).unionByName(told[2])


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    return model.confusion(model.score_logreg(ad.embedding_features(spark, d), rule_linear(ad.FEATURES)), list(CLASSES))


def q_classification_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(model.classification_report(model.score_logreg(ad.embedding_features(spark, d), rule_linear(ad.FEATURES)), list(CLASSES)))


# Sources, telemetry and streams


def q_parse_serial_lines(spark: SparkSession, d: str) -> DataFrame:
    samples, rejects = io.parse_serial_lines(ad.log_lines(spark, d), "healthy")
    good = samples.groupBy("device").agg(F.count("*").alias("n"), F.sum("accZ_raw").alias("total"))
    bad = rejects.groupBy("device").agg(F.count_if(F.col("kind") == "malformed").alias("malformed"), F.count_if(F.col("kind") == "system").alias("system"))
    return rounded(good.join(bad, "device", "full_outer").select("device", "n", "total", "malformed", "system"))


def q_telemetry_log(spark: SparkSession, d: str) -> DataFrame:
    return rounded(io.telemetry_to_log(io.parse_telemetry(ad.telemetry_lines(spark, d)), ["device", "event_id"]))


def q_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    latest = io.latest_of_payloads(ad.telemetry_lines(spark, d), "device", "event_id")
    return latest.select("device", "event_id", F.col("message.inference.prediction").alias("prediction"), F.col("message.status.fan_state").alias("fan_state"))


def q_explode_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(io.explode_scores(io.parse_telemetry(ad.telemetry_lines(spark, d)), ["event_id"]))


def q_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(io.history(io.telemetry_to_log(io.parse_telemetry(ad.telemetry_lines(spark, d)), ["event_id"]), "event_id"))


def q_to_telemetry_json(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of scored windows, parsed again: what the message holds."""
    w = spectrum.spectra(line_windows(spark, d))
    rows = features.features(line_windows(spark, d), KEYS, ad.LINES, SIZE).drop("label")
    scored = model.score_logreg(rows, rule_linear(features.FEATURES)).select(*KEYS, *features.FEATURES, "prediction", "confidence", "probabilities")
    payloads = io.to_telemetry_json(w.join(scored, KEYS), KEYS, F.col("start_idx"), F.col("probabilities"))
    m = io.parse_telemetry(payloads)
    return rounded(m.select(*KEYS, F.size("message.raw.ax").alias("n_raw"), F.size("message.fft.magnitudes").alias("n_mag"), F.size("message.inference.scores").alias("n_scores"), F.get("message.raw.az", F.lit(19)).alias("last_z"), F.col("message.features.rms.x").alias("rms_x")))


def q_export_log(spark: SparkSession, d: str) -> DataFrame:
    """The log written as CSV and read back."""
    path = new_path(spark, "log")
    io.export_log_csv(io.telemetry_to_log(io.parse_telemetry(ad.telemetry_lines(spark, d)), ["event_id"]), path, "event_id")
    return rounded(spark.read.option("header", True).schema("event_id long, timestamp string, prediction string, confidence double, fan_state string, rms_x double, rms_y double, rms_z double, bp_low double, bp_mid double, bp_high double").csv(path).drop("timestamp"))


def q_write_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Windows written by class twice, cleaned first and then added to, and read back."""
    path, w = new_path(spark, "windows"), line_windows(spark, d).select(*KEYS, "label")
    io.write_by_label(w, path)
    io.write_by_label(w, path, clean=False)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct(*KEYS).alias("windows"))


def write_streams(rows: DataFrame, path: str) -> None:
    """Samples as a CSV recording for each stream, in order of seq."""
    held = [c for c in rows.columns if c not in ("stream_id", "seq")]
    lines = rows.select(F.concat(F.lit("stream="), F.col("stream_id").cast("string")).alias("folder"), F.col("seq").alias("place"), F.to_csv(F.struct(*held)).alias("line"))
    write_recordings(lines, path, header=",".join(held))


def q_read_samples(spark: SparkSession, d: str) -> DataFrame:
    """Events written as CSV recordings and read back with their row order."""
    path = new_path(spark, "recordings")
    write_streams(ad.event_samples(spark, d), path)
    back = io.as_samples(io.read_samples(spark, path)).withColumn("stream_id", F.regexp_extract("stream_id", "stream=([0-9]+)", 1).cast("long"))
    return rounded(back.select("stream_id", "seq", "timestamp_ms", "accX_raw", "accZ_filt", "label"), 3)


def q_list_incoming(spark: SparkSession, d: str) -> DataFrame:
    """The files of recordings written from events, by class."""
    path = new_path(spark, "incoming")
    write_streams(ad.event_samples(spark, d), path)
    listed = io.list_incoming(spark, path).where(F.col("file").contains("part-"))
    return listed.groupBy("status", "reason").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


#: What validation says of a file as such.
FILE_REASONS = "^(not_csv_file|cannot_read_file|empty_file|missing_|label_column_empty|mixed_labels|invalid_or_missing_label)"


def q_validate_files(spark: SparkSession, d: str) -> DataFrame:
    """Events written as eight kinds of recordings, read back and judged in both modes: whole, without a label column, without labels, with two labels, without a required column, with a header alone, as text, and blank."""
    path, rows = new_path(spark, "odd-recordings"), stored(ad.event_samples(spark, d), "samples")
    of = lambda kind: rows.where(F.col("stream_id") % 8 == kind)
    labels = {0: F.col("label"), 2: F.lit(None).cast("string"), 3: F.when(F.col("seq") % 2 == 0, "healthy").otherwise("obstruction"), 4: F.col("label")}
    kinds = {k: of(k).withColumn("label", label) for k, label in labels.items()} | {1: of(1).drop("label")}
    for k, df in kinds.items():
        write_streams(df.drop(*["accY_raw"] * (k == 4)), f"{path}/kind={k}")
    for k, text, name in ((5, ",".join([*VALUES, "label"]), "part-0.csv"), (6, "no recording", "part-0.txt"), (7, "", "part-0.csv")):
        folder = F.concat(F.lit("stream="), F.col("stream_id").cast("string")).alias("folder")
        write_recordings(of(k).where("seq = 0").select(folder, F.col("seq").alias("place"), F.lit(text).alias("line")), f"{path}/kind={k}", name)
    listed = stored(recording_files(spark, path), "files")
    lines = io.csv_lines(spark, path, listed)
    files = stored(io.file_facts(spark, path, lines, listed), "file-facts")
    samples = stored(io.as_samples(io.read_samples(spark, path, lines)), "samples")  # several aggregations read them
    kind = F.regexp_extract("stream_id", "kind=([0-9])", 1).cast("long").alias("kind")
    checked = segment.segment_precheck(samples, files.where("coalesce(early_reason, '') <> 'not_csv_file'")).select("stream_id", F.col("reason").alias("precheck"))
    facts = stored(validate.stream_facts(samples, ad.EVENTS, files).join(checked, "stream_id", "left"), "stream-facts")
    told = []
    for mode in ("mock", "real"):
        reasons = F.array_join(F.filter("reasons", lambda r: r.rlike(FILE_REASONS)), ";")
        report = validate.judged(facts, mode, ad.EVENTS)
        told.append(report.groupBy(kind, F.lit(mode).alias("mode"), reasons.alias("reasons"), "precheck").agg(F.count("*").alias("files"), F.sum("total_samples").alias("samples")))
    return told[0].unionByName(told[1])


def q_write_features(spark: SparkSession, d: str) -> DataFrame:
    path, w = new_path(spark, "features"), line_windows(spark, d)
    io.write_features(features.features(w, KEYS, ad.LINES, SIZE), features.feature_report(w, KEYS, SIZE, ad.LINES), path)
    report = spark.read.option("header", True).csv(f"{path}/report").groupBy().agg(F.count_if(F.col("status") == "OK").alias("ok"))
    return rounded(spark.read.parquet(f"{path}/features").agg(F.count("*").alias("n"), F.avg("RMS_X").alias("rms_x")).join(report))


def q_stream_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Payloads written as files and streamed into the log."""
    from tremor.streaming.live import stream_telemetry

    source, log, state = (new_path(spark, n) for n in ("payloads", "live-log", "live-state"))
    ad.telemetry_lines(spark, d).repartition(4, "device").write.parquet(source)
    stream_telemetry(spark.readStream.schema("device long, event_id long, payload string").option("maxFilesPerTrigger", 2).parquet(source), log, state, ["device", "event_id"]).awaitTermination()
    return rounded(spark.read.parquet(log))


def q_stream_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Payloads written as files, and the latest of each device kept batch by batch."""
    from tremor.streaming.live import snapshot, stream_snapshot

    source, path, state = (new_path(spark, n) for n in ("payloads", "live-snapshot", "live-state"))
    ad.telemetry_lines(spark, d).repartition(4, "event_id").write.parquet(source)
    stream_snapshot(spark.readStream.schema("device long, event_id long, payload string").option("maxFilesPerTrigger", 2).parquet(source), path, state, "device", "event_id").awaitTermination()
    m = io.parse_telemetry(snapshot(spark, path))
    return m.select("device", "event_id", F.col("message.inference.prediction").alias("prediction"), F.col("message.status.fan_state").alias("fan_state"))


def streamed_quarters(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """A stream of samples in four batches: the quarters of each recording's real length."""
    source, files = new_path(spark, "live-samples"), spark.sparkContext.defaultParallelism
    n = F.max("seq").over(Window.partitionBy("stream_id")) + 1
    quarters = stored(samples.withColumn("quarter", F.floor(F.col("seq") * 4 / n)), "quarters")
    for i in range(4):  # files for each quarter of each recording, in order; a recording's rows of a quarter are in one file
        own = quarters.where(F.col("quarter") == i).select(samples.columns).repartition(files, "stream_id")
        own.sortWithinPartitions("stream_id", "seq").write.mode("append").parquet(source)
    return spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", files).parquet(source)


def written(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream has given when all of its source is read."""
    out, state = new_path(spark, "live-rows"), new_path(spark, "live-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Samples streamed in four batches through live windows with filter and transient state."""
    from tremor.streaming.live import stream_windows

    samples = ad.line_samples(spark, d).select("stream_id", "seq", "accZ_raw")
    rows = written(spark, stream_windows(streamed_quarters(spark, samples), SIZE, ad.LINES.hop, 0.9936, 0.05))
    return rounded(rows.select("stream_id", "local_id", "start_seq", "rms", "is_transient", F.get("z", F.lit(0)).alias("first"), F.size("z").alias("n")))


def q_stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Samples of three axes streamed in four batches through live windows, features, scores and payloads."""
    from tremor.streaming.live import stream_scores

    samples = ad.line_samples(spark, d).select("stream_id", "seq", "accX_raw", "accY_raw", "accZ_raw")
    rows = written(spark, stream_scores(streamed_quarters(spark, samples), rule_linear(features.FEATURES), SIZE, ad.LINES.hop, 0.9936, 0.05, ad.LINES))
    message = F.from_json("payload", io.TELEMETRY)
    return rounded(rows.select("stream_id", "local_id", "is_transient", *features.FEATURES, "prediction", "confidence", F.size(message["raw"]["ax"]).alias("n_raw"), message["inference"]["prediction"].alias("told")))
