"""Validation, segments, windows and spectra on small seeded recordings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremor.config import DEFAULT, VALUES
from tremor.functions import arrays as A
from tremor.functions import labels as L
from tremor.operators import checks, features, scan, segment, spectrum, validate, windows
from tremor.sources import io

SCHEMA = "stream_id long, seq long, timestamp_ms double, accX_raw double, accY_raw double, accZ_raw double, accZ_filt double, label string"
P = DEFAULT


def recording(stream: int, n: int, label: str = "healthy") -> pd.DataFrame:
    rng = np.random.default_rng(stream)
    t = np.arange(n) * 2.0
    z = np.sin(2 * np.pi * 60 * t / 1000) + 0.1 * rng.normal(size=n)
    return pd.DataFrame({"stream_id": stream, "seq": np.arange(n), "timestamp_ms": t, "accX_raw": rng.normal(size=n), "accY_raw": rng.normal(size=n), "accZ_raw": z, "accZ_filt": z - z.mean(), "label": label})


def frame(spark, *parts: pd.DataFrame):
    whole = pd.concat(parts)[[c.split()[0] for c in SCHEMA.split(", ")]]
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in whole.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def fault(kind: str, stream: int) -> pd.DataFrame:
    df = recording(stream, 3000)
    if kind == "missing_chunk":
        df = df.drop(index=range(1000, 1200)).reset_index(drop=True)
    elif kind == "jump":
        df.loc[1500:, "timestamp_ms"] += 200
    elif kind == "repeated":
        df = pd.concat([df.iloc[:1050], df.iloc[1000:]], ignore_index=True)
    elif kind == "reversed":
        df.loc[1000:1030, "timestamp_ms"] = df.loc[1000:1030, "timestamp_ms"].to_numpy()[::-1]
    elif kind == "jitter":
        df["timestamp_ms"] += np.random.default_rng(1).normal(0, 8, len(df))
    df["seq"] = np.arange(len(df))
    return df


def test_clean_recordings_pass_and_faults_fail(spark):
    kinds = ["missing_chunk", "jump", "repeated", "reversed", "jitter"]
    samples = frame(spark, recording(0, 3000), recording(1, 3000, "imbalanced"), *[fault(k, i + 2) for i, k in enumerate(kinds)])
    report = {r.stream_id: r for r in validate.validate(samples, "mock").collect()}
    assert [report[i].status for i in (0, 1)] == ["PASS", "PASS"] and report[0].reasons == ["ok"]
    want = {"missing_chunk": "large_timestamp_gap", "jump": "large_timestamp_gap", "repeated": "duplicate_timestamps", "reversed": "non_increasing_timestamp", "jitter": "high_sampling_jitter_fail"}
    for i, k in enumerate(kinds):
        assert report[i + 2].status == "FAIL" and want[k] in report[i + 2].reasons, k
    assert report[2].estimated_missing_samples == 200
    real = {r.stream_id: r.status for r in validate.validate(samples, "real").collect()}
    assert real[2] == "WARNING" and real[4] == "FAIL"


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_intervals_do_not_depend_on_chunks(spark, chunk):
    """Chunks are met at their ends, also where a time is missing there or where seq has holes."""
    odd = fault("jump", 1).iloc[:200].copy()
    odd.loc[[6, 7, 21], "timestamp_ms"] = math.nan
    holes = fault("jitter", 2).iloc[:300].copy()
    holes["seq"] = holes["seq"] * 5
    samples = frame(spark, odd, holes)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    t = {k: df["timestamp_ms"].tolist() for k, df in (("odd", odd), ("holes", holes))}
    got = {r.stream_id: r for r in validate.dt_profile(samples, P, chunk).collect()}
    for i, k in ((1, "odd"), (2, "holes")):
        dt = np.diff(np.array(t[k]))
        dt = dt[~np.isnan(dt)]
        assert abs(got[i].mean_dt_ms - dt.mean()) < 1e-9 and abs(got[i].std_dt_ms - dt.std(ddof=1)) < 1e-9 and (got[i].min_dt_ms, got[i].max_dt_ms) == (dt.min(), dt.max())
    assert rows(validate.timing_faults(samples, P, chunk)) == rows(validate.timing_faults(samples, P))


def test_odd_recordings(spark):
    one = recording(0, 1)
    bad = recording(1, 10)
    bad.loc[3, "accX_raw"] = float("nan")
    bad.loc[4, "accY_raw"] = float("inf")
    none = recording(2, 10, None)
    odd = recording(3, 10, "Normal ")
    report = {r.stream_id: r for r in validate.validate(frame(spark, one, bad, none, odd), "real").collect()}
    assert report[0].reasons == ["not_enough_samples"]
    assert report[1].reasons[:2] == ["nan_or_non_numeric_values_detected", "inf_values_detected"]
    assert report[2].reasons[:2] == ["missing_label_column_and_cannot_infer_from_filename", "invalid_or_missing_label: None"]
    assert report[3].label == "healthy" and report[3].reasons == ["label_normalized_to_healthy"] and report[3].status == "WARNING"
    assert validate.validate(frame(spark, one).limit(0), "mock").count() == 0


def test_labels_and_numbers(spark):
    rows = [("recordings/healthy/x.csv", "healthy"), ("a/fan_imbalanced_1.csv", "imbalanced"), ("a/healthy_obstruction.csv", None), ("a/none.csv", None), ("a/unhealthy.csv", "healthy")]
    df = spark.createDataFrame(rows, "path string, want string")
    assert all(r.got == r.want for r in df.select("want", L.label_from_path(F.col("path")).alias("got")).collect())
    texts = ["1.5", " 2 ", "abc", "", "nan", "1.5d", "inf", None, "1e3"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.to_number(F.col("t")).alias("n")).collect()]
    assert got == [1.5, 2.0, None, None, None, None, float("inf"), None, 1000.0]


def test_texts_of_numbers_are_cast_once(spark):
    """No text is cast anew to ask whether its number is NaN; whatever a cast would read as NaN is null."""
    texts = ["NaN", " nan\t", "+NaN", "-NaN\r\n", "\x00nan\x1f", "-nan", "nano", *io.MISSING]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.n for r in df.select(L.to_number(F.col("t")).alias("n")).collect()} == {None}
    text = spark.range(1).select(F.lit("f").alias("stream_id"), F.col("id").alias("seq"), *[F.col("id").cast("string").alias(c) for c in (*VALUES, "label")])
    plan = io.as_samples(text)._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert plan.count("try_cast(") == len(VALUES)


@pytest.mark.parametrize("chunk", [7, 100, 10_000])
def test_long_streams_are_segmented_alike(spark, chunk):
    df = recording(0, 400)
    df.loc[100:, "timestamp_ms"] += 50
    df.loc[210:, "timestamp_ms"] -= 500
    samples = frame(spark, df, recording(1, 30))
    plain = segment.split_segments(samples).select("stream_id", "seq", "segment_id", "idx")
    long = segment.split_long_streams(samples, chunk=chunk).select("stream_id", "seq", "segment_id", "idx")
    assert plain.exceptAll(long).count() == 0 and plain.count() == long.count()


@pytest.mark.parametrize("size,hop", [(16, 8), (16, 16), (12, 4)])
def test_windows_are_whole(spark, size, hop):
    samples = segment.split_segments(frame(spark, recording(0, 101), recording(1, size), recording(2, size - 1)))
    w = windows.sliding_windows(samples, size, hop).collect()
    assert sum(r.stream_id == 0 for r in w) == (101 - size) // hop + 1
    assert sum(r.stream_id == 1 for r in w) == 1 and not any(r.stream_id == 2 for r in w)
    assert all(r.timestamp_ms == [2.0 * (r.start_idx + i) for i in range(size)] for r in w)


@pytest.mark.parametrize("chunk", [1, 2, 5, 1000])
def test_windows_of_a_long_segment_do_not_depend_on_chunks(spark, chunk):
    samples = segment.split_segments(frame(spark, recording(0, 403), recording(1, 17)))
    plain = [windows.sliding_windows(samples, 16, 4).collect(), windows.validate_segments(samples).collect()]
    dealt = [windows.sliding_windows(samples, 16, 4, chunk).collect(), windows.validate_segments(samples, chunk=chunk).collect()]
    for a, b in zip(plain, dealt):
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_segment_checks_see_the_edges_of_chunks(spark):
    n = DEFAULT.window
    still, gap, mixed = (recording(i, n) for i in range(3))
    still.loc[10, "timestamp_ms"] = still.loc[9, "timestamp_ms"]
    gap.loc[20:, "timestamp_ms"] += 500
    mixed.loc[30:, "label"] = "imbalanced"
    rows = frame(spark, still, gap, mixed).withColumns({"segment_id": F.lit(0).cast("long"), "idx": F.col("seq")})
    got = {r.stream_id: r.reason for r in windows.validate_segments(rows, chunk=10).collect()}
    assert got == {0: "non_increasing_timestamps", 1: "large_timestamp_gaps", 2: "mixed_labels"}


def test_segment_precheck(spark):
    named, late, blank = recording(0, 5, " NORMAL "), recording(1, 5), recording(2, 5, None)
    late.loc[1:, "label"] = "broken"
    late.loc[0, "label"] = "imbalanced"
    missing = spark.createDataFrame([(0, None), (1, None), (2, "accX_raw"), (3, None), (4, "label")], "stream_id long, missing_columns string")
    samples = frame(spark, named, late, blank)
    assert {r.stream_id: r.reason for r in segment.segment_precheck(samples).collect()} == {0: "ok", 1: "ok", 2: "no_label"}
    want = {0: "ok", 1: "ok", 2: "missing_columns: accX_raw", 3: "empty_input", 4: "empty_input"}
    assert {r.stream_id: r.reason for r in segment.segment_precheck(samples, missing).collect()} == want


@pytest.mark.parametrize("chunk", [3, 50, 1000])
def test_high_pass_does_not_depend_on_chunks(spark, chunk):
    df = recording(0, 333)
    x, y, want = df["accZ_raw"].to_numpy(), 0.0, []
    for i, v in enumerate(x):
        y = 0.9936 * (y + v - (x[i - 1] if i else 0.0))
        want.append(y)
    got = scan.high_pass(frame(spark, df), {"accZ_raw": "hp"}, 0.9936, chunk).orderBy("seq").toPandas()["hp"]
    assert np.allclose(got, want, atol=1e-9)


def test_spectrum_of_a_pure_tone_and_guards(spark):
    n = 512
    tone = [math.sin(2 * math.pi * 60 * i / n) for i in range(n)]
    df = spark.createDataFrame([(0, tone), (1, [0.0] * n), (2, None)], "id long, x array<double>").select("id", A.rfft_magnitude(F.col("x")).alias("mag"))
    rows = {r.id: r for r in spectrum.spectral_table(df.where("id < 2"), ["id"], 500.0, n).collect()}
    assert abs(rows[0].dominant_frequency - 60 * 500 / n) < 1e-9 and abs(rows[0].max_magnitude - 0.5) < 1e-9
    assert rows[1].spectral_centroid == 0.0 and rows[1].spectral_bandwidth == 0.0
    assert df.where("id = 2").first().mag is None
    power = df.where("id = 0").select(A.array_sum(F.col("mag"), lambda m: m * m).alias("p")).first().p
    assert abs(2 * power - sum(v * v for v in tone) / n) < 1e-9  # Parseval


def test_flat_windows(spark):
    df = spark.createDataFrame([([1.5] * 16,), ([0.0] * 16,)], "x array<double>").select(A.centered(F.col("x")).alias("c"))
    rows = df.select(A.crest_factor(F.col("c")).alias("crest"), A.kurtosis(F.col("c")).alias("k"), A.kurtosis(F.col("c"), 1e-10).alias("edge")).collect()
    assert all(r.crest == 0.0 and r.k is None and r.edge == 0.0 for r in rows)


def test_features_of_one_window(spark):
    df = recording(0, 512)
    w = windows.sliding_windows(segment.split_segments(frame(spark, df)), 512, 256)
    got = features.features(w, ["stream_id", "local_id"]).first()
    z = df["accZ_raw"].to_numpy()
    c = z - z.mean()
    mag = np.abs(np.fft.rfft(df["accZ_filt"].to_numpy() * np.hanning(512))) / 512
    f = np.arange(257) * 500 / 512
    assert abs(got.RMS_Z - np.sqrt(np.mean(z**2))) < 1e-12
    assert abs(got.Kurtosis_Z - (np.mean(c**4) / np.mean(c**2) ** 2 - 3)) < 1e-9
    assert abs(got.Band_Power_Z_Low - (mag[(f >= 50) & (f < 80)] ** 2).sum()) < 1e-12
    assert abs(got.Band_Power_Z_High - (mag[(f >= 170) & (f <= 210)] ** 2).sum()) < 1e-12


def test_long_gap_free_stream_and_text_ids(spark):
    """One stream of 30 chunks without a gap beside one with gaps, under text ids: two-level segments, window numbers and class numbers."""
    whole, gaps = recording(1, 3000), recording(2, 1200, "imbalanced")
    gaps.loc[500:, "timestamp_ms"] += 50
    gaps.loc[900:, "timestamp_ms"] += 50
    samples = frame(spark, whole, gaps).withColumn("stream_id", F.concat(F.lit("rec/"), F.col("stream_id").cast("string"), F.lit(".csv")))
    plain = segment.split_segments(samples).select("stream_id", "seq", "segment_id", "idx")
    long = segment.split_long_streams(samples, chunk=100).select("stream_id", "seq", "segment_id", "idx")
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, plain.collect()))
    w = windows.sliding_windows(segment.split_segments(samples), 128, 64)
    got = [(r.window_id, r.label, r.stream_id, r.segment_id, r.local_id) for r in windows.global_window_id(w, chunk=5).collect()]
    order = {"healthy": 0, "imbalanced": 1}
    assert [i for i, *_ in sorted(got)] == list(range(len(got))) and [x[1:] for x in sorted(got)] == sorted((x[1:] for x in got), key=lambda x: (order[x[0]], *x[1:]))
    index = checks.window_index(w.select("label", "stream_id", "segment_id", "local_id"), ["stream_id", "segment_id", "local_id"]).collect()
    for label in order:
        own = sorted((r.window_index, r.stream_id, r.segment_id, r.local_id) for r in index if r.label == label)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    z = whole["accZ_raw"].to_numpy()
    want, y, before = [], 0.0, 0.0
    for v in z:
        y = 0.99 * (y + v - before)
        before = v
        want.append(y)
    rows = scan.high_pass(samples, {"accZ_raw": "hp"}, 0.99, chunk=100).where("stream_id = 'rec/1.csv'").orderBy("seq").collect()
    assert np.allclose([r.hp for r in rows], want)


def test_spectra_are_checked_as_measured(spark):
    """Two labels, no label, and spectra of other bins or another rate than the window's."""
    samples = frame(spark, recording(1, 3000)).withColumn("label", F.when(F.col("seq").between(600, 900), F.lit("imbalanced")).when(F.col("seq") >= 2000, F.lit(None).cast("string")).otherwise(F.col("label")))
    w = spectrum.spectra(windows.sliding_windows(segment.split_segments(samples), 512, 256))
    got = {r.start_idx: r for r in spectrum.fft_report(w, ["start_idx"], 512, 500.0).collect()}
    assert got[0].reason == "valid" and (got[0].n_bins, got[0].max_frequency_hz, got[0].resolution_hz) == (257, 250.0, 500 / 512)
    assert got[256].reason == got[512].reason == got[768].reason == "mixed_labels" and got[1024].reason == "valid" and got[256].n_bins is None
    assert got[2048].reason == "mixed_labels"  # no label at all
    short = {r.start_idx: r for r in spectrum.fft_report(w.withColumn("mag", F.slice("mag", 1, 200)), ["start_idx"], 512, 500.0).collect()}
    assert short[0].reason == "invalid_bins" and short[0].n_bins == 200


def test_ingest_repeats_nothing(spark, tmp_path):
    samples = frame(spark, recording(1, 3000))
    more = samples.unionByName(samples.withColumn("stream_id", F.col("stream_id") + 100))
    report = lambda s: validate.validate(s, "real")
    ids = [validate.ingest(s, report(s), str(tmp_path)) for s in (samples, samples.repartition(3), more, more)]
    assert ids[0] == ids[1] != ids[2] == ids[3]
    stored = spark.read.parquet(f"{tmp_path}/samples")
    assert stored.count() == more.count() and spark.read.parquet(f"{tmp_path}/streams").count() == stored.select("stream_id").distinct().count()
    changed = samples.withColumn("accX_raw", F.col("accX_raw") + 1)
    validate.ingest(changed, report(changed), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/samples").count() == more.count() + samples.count()


def test_labels_from_paths_take_no_lambda(spark):
    rows = [("imbalanced/x.csv", None, "imbalanced", "imbalanced"), ("a//Healthy.obstruction", "healthy", "healthy", "healthy"), ("blocked_obstruction", "obstruction", "obstruction", "obstruction"), ("healthy/good_clogged.v2.csv", None, "healthy", "healthy"), ("a/good_clogged.csv", None, None, None), ("a/obstruction_healthy.csv", None, None, "healthy"), (".healthy", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, stem string, every string, first string")
    p = F.col("path")
    got = df.select("stem", "every", "first", L.label_from_stem(p).alias("a"), L.label_from_path(p).alias("b"), L.label_from_path_first(p).alias("c"))
    assert [tuple(r)[3:] for r in got.collect()] == [r[1:] for r in rows]
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
