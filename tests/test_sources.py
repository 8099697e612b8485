"""Files, log lines, telemetry and streams."""

from __future__ import annotations

import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremor.jobs import queries
from tremor.operators import features, segment, validate
from tremor.sources import adapters as ad
from tremor.sources import io, recordings
from tremor.streaming import live


def test_odd_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "timestamp_ms,accX_raw,accY_raw,accZ_raw,accZ_filt,label\n"
    files = {"good.csv": head + "".join(f"{2 * i},{i},0,1,0,healthy\n" for i in range(50)), "swapped.csv": "label,timestamp_ms,accX_raw\nhealthy,0,7\n", "empty.csv": "", "head.csv": head, "note.txt": "x", "again.csv": head + "0,1,NA,abc,1.5d,good\n" + head}
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    text = io.read_samples(spark, str(tmp_path / "in"))
    by_file = lambda df: {os.path.basename(r[0]): r for r in df.collect()}
    rows = io.as_samples(text)
    good = rows.where(F.col("stream_id").endswith("good.csv")).orderBy("seq").collect()
    assert [r.accX_raw for r in good] == list(range(50)) and [r.seq for r in good] == list(range(50))
    swapped = rows.where(F.col("stream_id").endswith("swapped.csv")).first()
    assert swapped.accX_raw == 7.0 and swapped.label == "healthy" and swapped.accZ_raw is None
    again = rows.where(F.col("stream_id").endswith("again.csv")).orderBy("seq").first()
    assert (again.accX_raw, again.accY_raw, again.accZ_raw, again.accZ_filt) == (1.0, None, None, None)
    assert by_file(io.header_rows(text))["again.csv"].repeated_header and not by_file(io.header_rows(text))["good.csv"].repeated_header
    listed = {os.path.basename(r.file): (r.status, r.reason, r.rows) for r in io.list_incoming(spark, str(tmp_path / "in")).collect()}
    assert listed["note.txt"] == ("FAIL", "not_csv_file", 0) and listed["empty.csv"] == ("FAIL", "empty_file", 0) and listed["good.csv"] == ("PASS", "ok", 50)


def test_log_lines(spark):
    lines = ["timestamp_ms,accX_raw,...", "", "1,2,3", "boot,a,b,c,d", "-1,0.5,1e-3,-2,.5,dev", "3,1,2,3,4"]
    samples, rejects = io.parse_serial_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "healthy")
    assert sorted(r.timestamp_ms for r in samples.collect()) == [-1.0, 3.0]
    assert sorted(r.kind for r in rejects.collect()) == ["malformed", "system"]


def test_telemetry(spark):
    whole = {"timestamp": 5, "inference": {"prediction": "healthy", "confidence": 0.9, "scores": {"healthy": 0.9}}, "status": {"fan_state": "on"}}
    lines = [json.dumps(whole), "{broken", json.dumps({"status": {}}), json.dumps(whole | {"status": None}), None]
    df = spark.createDataFrame(list(enumerate(lines)), "event_id long, payload string").withColumn("device", F.lit(1))
    parsed = io.parse_telemetry(df)
    log = io.telemetry_to_log(parsed, ["event_id"]).collect()
    assert [r.event_id for r in log] == [0] and log[0].timestamp == "5" and log[0].rms_x is None
    assert io.latest_snapshot(parsed, "device", "event_id").first().event_id == 3


@pytest.mark.parametrize("files", [1, 3])
def test_live_windows_do_not_depend_on_batches(spark, tmp_path, files):
    rows = [(s, i, float((i * 37 + s) % 11)) for s in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, accZ_raw double")
    for k in range(files):
        df.where((F.col("seq") * files / 100).cast("int") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.stream_windows(stream, 16, 8, 0.9936).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.stream_id, r.local_id, round(r.rms, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    from tremor.operators.scan import filtered
    import numpy as np

    want = []
    for s in range(3):
        y = filtered(np.array([r[2] for r in rows if r[0] == s]), 0.9936)
        want += [(s, k, round(float(np.sqrt(np.mean(y[8 * k : 8 * k + 16] ** 2))), 9)) for k in range((100 - 16) // 8 + 1)]
    assert got == sorted(want)


def streamed(spark, rows, base, name, checkpoint, **more):
    """What live_windows gives for rows (stream_id, seq, accZ_raw) that are added to the source, from a checkpoint on."""
    df = spark.createDataFrame(rows, "stream_id long, seq long, accZ_raw double")
    df.coalesce(1).write.mode("append").parquet(f"{base}/{name}-in")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/{name}-in")
    found = live.live_windows(stream, 16, 8, ("accZ_raw",), 0.9936, **more)
    found.writeStream.format("parquet").option("path", f"{base}/{name}-out").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.stream_id, r.local_id, round(r.rms, 9), r.is_transient) for r in spark.read.parquet(f"{base}/{name}-out").collect())


def test_live_state_outlives_queries(spark, tmp_path):
    """One query; one that is stopped and started; and a new one that begins with the state of another: the same windows."""
    base, rows = str(tmp_path), [(s, i, float((i * 37 + s) % 11)) for s in range(3) for i in range(100)]
    first, rest = [r for r in rows if r[1] < 45], [r for r in rows if r[1] >= 45]
    whole = streamed(spark, rows, base, "a", f"{base}/a-state")
    begun = streamed(spark, first, base, "b", f"{base}/b-state")
    state = live.live_state(spark, f"{base}/b-state")
    assert {(r.stream_id, r.n, r.emitted) for r in state.collect()} == {(s, 45, 4) for s in range(3)}
    state.write.parquet(f"{base}/kept")
    assert streamed(spark, rest, base, "b", f"{base}/b-state") == whole
    assert sorted(begun + streamed(spark, rest, base, "c", f"{base}/c-state", initial=spark.read.parquet(f"{base}/kept"))) == whole


def test_silent_streams_are_dropped(spark, tmp_path):
    base = str(tmp_path)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        streamed(spark, [(s, i, 1.0) for s in (1, 2) for i in range(10)], base, "a", f"{base}/state", silent_ms=1500)
        assert {r.stream_id for r in live.live_state(spark, f"{base}/state").collect()} == {1, 2}
        time.sleep(2)
        streamed(spark, [(2, i, 1.0) for i in range(10, 12)], base, "a", f"{base}/state", silent_ms=600_000)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert 1 not in {r.stream_id for r in live.live_state(spark, f"{base}/state").collect()}


def test_snapshots_rewrite_touched_buckets_alone(spark, tmp_path):
    base = str(tmp_path)
    message = lambda k: json.dumps({"inference": {"prediction": f"p{k}", "confidence": 0.5}})

    def feed(rows):
        df = spark.createDataFrame(rows, "device long, event_id long, payload string")
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        live.stream_snapshot(stream, f"{base}/out", f"{base}/state", "device", "event_id", buckets=16, kept=2).awaitTermination()
        return {r.device: (r.event_id, json.loads(r.payload)["inference"]["prediction"]) for r in live.snapshot(spark, f"{base}/out").collect()}

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(f"{base}/out/data") for f in names if f.startswith("part-")}

    assert feed([(1, 1, "{broken")]) == {}
    assert feed([(d, d, message(d)) for d in range(200)]) == {d: (d, f"p{d}") for d in range(200)}
    before = files()
    assert len(before) == 16
    got = feed([(7, 1000, message(1000)), (7, 3, message(3)), (8, 2000, "{broken")])
    assert got == {d: (d, f"p{d}") for d in range(200)} | {7: (1000, "p1000")}
    assert len(files() - before) == 1 and len(before - files()) == 0  # one bucket written; the version before stands whole
    assert live.snapshot(spark, f"{base}/out", 1).where("device = 7").first().event_id == 7
    feed([(9, 1001, message(1))])
    assert len(live.manifests(spark, f"{base}/out")) == 2 and len(before - files()) == 1 and live.snapshot(spark, f"{base}/out", 2).count() == 200


def test_long_recordings_are_streamed_whole(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_suppkey <= 4")
    hot = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1500).withColumn("l_suppkey", F.lit(99).cast(rows.schema["l_suppkey"].dataType))
    rows.unionByName(hot).write.parquet(str(tmp_path / "lineitem.parquet"))
    sizes = {r.l_suppkey: r["count"] for r in spark.read.parquet(str(tmp_path / "lineitem.parquet")).groupBy("l_suppkey").count().collect()}
    got = {r.stream_id: r["count"] for r in queries.q_stream_windows(spark, str(tmp_path)).groupBy("stream_id").count().collect()}
    assert sizes[99] == 1500
    assert got == {k: (n - queries.SIZE) // ad.LINES.hop + 1 for k, n in sizes.items() if n >= queries.SIZE}


def test_raw_files_to_report(spark, tmp_path):
    """Files of other column orders, without a column or a label column, with a repeated header, and with the class in their name alone."""
    names = "timestamp_ms,accX_raw,accY_raw,accZ_raw,accZ_filt,label".split(",")
    row = lambda i, label: dict(zip(names, [str(2.0 * i), "0.1", "0.2", "1.0", "0.05", label]))

    def write(name, columns, label, n=1200, again=None):
        lines = [",".join(columns)] + [",".join(row(i, label)[c] for c in columns) for i in range(n)]
        if again:
            lines.insert(again, lines[0])
        (tmp_path / name).write_text("\n".join(lines) + "\n")

    write("a.csv", names, "Normal")
    write("b.csv", names[::-1], "healthy")
    write("c.csv", [c for c in names if c != "accY_raw"], "healthy")
    write("d.csv", names, "healthy", again=5)
    write("obstruction_1.csv", names[:-1], "")
    write("e.csv", names[:-1], "")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "note.txt").write_text("no recording")
    text = io.read_samples(spark, str(tmp_path))
    facts = io.file_facts(spark, str(tmp_path))
    report = validate.validate(io.as_samples(text), "real", files=facts)
    got = {r.stream_id.rsplit("/", 1)[1]: r for r in report.collect()}
    assert set(got) == {"a.csv", "b.csv", "c.csv", "d.csv", "e.csv", "obstruction_1.csv", "empty.csv", "note.txt"}
    assert got["empty.csv"].reasons == ["cannot_read_file"] and got["note.txt"].reasons == ["not_csv_file"] and got["empty.csv"].label is None
    assert got["e.csv"].reasons == ["missing_label_column", "invalid_or_missing_label: None"] + got["e.csv"].reasons[2:] and got["obstruction_1.csv"].reasons[0] == "missing_label_column"
    mock = {r.stream_id.rsplit("/", 1)[1]: r for r in validate.validate(io.as_samples(text), "mock", files=facts).collect()}
    assert mock["obstruction_1.csv"].status == "FAIL" and mock["obstruction_1.csv"].reasons[0] == "missing_label_column"
    checked = {r.stream_id.rsplit("/", 1)[1]: r.reason for r in segment.segment_precheck(io.as_samples(text), facts).collect()}
    assert checked["e.csv"] == "missing_columns: label" and checked["c.csv"] == "missing_columns: accY_raw" and checked["empty.csv"] == "empty_input" and checked["a.csv"] == "ok"
    assert got["a.csv"].status == "WARNING" and got["a.csv"].reasons == ["label_normalized_to_healthy"] and got["b.csv"].status == "PASS"
    assert got["c.csv"].reasons == ["missing_required_columns: accY_raw"] and got["d.csv"].reasons[0] == "duplicated_header_rows_detected"
    assert got["obstruction_1.csv"].label == "obstruction" and got["e.csv"].status == "FAIL"
    listed = {r.file.rsplit("/", 1)[1]: r.reason for r in io.list_incoming(spark, str(tmp_path)).collect()}
    assert listed["empty.csv"] == "empty_file" and listed["note.txt"] == "not_csv_file" and listed["a.csv"] == "ok"


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    texts = {"a.csv": "\n\nx,y\r\n1,2\r\n\r\n3,4", "deep/b.csv": "x\n" + "".join(f"{i}\n" for i in range(40)), "deep/er/c.CSV": "x\n5", "deep/er/d.csv": "\n", "e.csv": "", "_no.csv": "x\n1", "f.txt": "x"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = recordings.recording_files(spark, str(tmp_path))
    assert {r.file.removeprefix(f"file://{tmp_path}/"): r.bytes for r in files.collect()} == {n: len(t) for n, t in texts.items() if n != "_no.csv"}
    lines = recordings.recording_lines(files.where("is_csv"), split)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(file" in plan and "split" in plan.split("windowspecdefinition(file")[1].split("specifiedwindowframe")[0]  # over splits alone
    got = {}
    for r in lines.orderBy("file", "seq").collect():
        got.setdefault(r.file.removeprefix(f"file://{tmp_path}/"), []).append((r.seq, r.header, r.value))
    want = {n: [x.rstrip("\r") for x in t.split("\n") if x.strip()] for n, t in texts.items() if n.lower().endswith(".csv") and n != "_no.csv"}
    assert got == {n: [(k - 1, v[0], x) for k, x in enumerate(v)] for n, v in want.items() if v}


def test_bucketed_tables_join_where_they_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spectra, windows = queries.bucketed_windows(spark, "/root/testdata/sf0.001")
        both, lost = features.join_spectra_windows(spectra, windows, queries.KEYS)
        plan = both._jdf.queryExecution().executedPlan().toString() + lost._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert both.count() + lost.count() == spectra.count() and lost.count() == spectra.where("local_id = 2").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_do_not_grow_with_folders(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}" / "deep" / "er").mkdir(parents=True)
        (tmp_path / f"f{i}" / "deep" / "er" / "a.csv").write_text("x\n1\n")
    files = recordings.recording_files(spark, str(tmp_path))
    assert files.count() == 40 and files.rdd.getNumPartitions() <= 4
    assert {(r.status, r.rows) for r in io.list_incoming(spark, str(tmp_path)).collect()} == {("PASS", 1)}


def test_recordings_are_written_by_folder_in_order(spark, tmp_path):
    rows = [(f"s={i}", j, f"{i},{j}") for i in range(9) for j in range(20)]
    lines = spark.createDataFrame(rows[::-1], "folder string, place long, line string").repartition(3)
    for _ in range(2):  # the same files again
        assert recordings.write_recordings(lines, f"file://{tmp_path}", header="a,b") == 9
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {f"s={i}/part-0.csv": "a,b\n" + "".join(f"{i},{j}\n" for j in range(20)) for i in range(9)}


def test_small_files_share_a_batch(tmp_path):
    for i in range(50):
        (tmp_path / f"{i:02}.csv").write_text(f"x\n{i}\n")
    files = [f"file://{tmp_path}/{i:02}.csv" for i in range(50)]
    splits = pa.RecordBatch.from_pydict({"file": files, "bytes": [len(f"x\n{i}\n") for i in range(50)], "split": [0] * 50, "length": [1 << 20] * 50})
    read = list(recordings.read_splits(iter([splits])))
    assert len(read) == 1 and read[0].column("value").to_pylist() == [v for i in range(50) for v in ("x", str(i))] and all(read[0].column("whole").to_pylist())


def test_samples_of_a_stream_are_packed_for_the_live_step():
    ids, seqs, x = ["b", "a", None, "b", "a", None], [5, 1, 0, 2, None, 3], [0.5, 0.1, 0.0, None, 9.0, 0.3]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(seqs, pa.int64()), pa.array(x)], names=["stream_id", "seq", "accZ_raw"])
    (packed,) = live.pack(iter([batch]))
    got = {r["stream_id"]: (r["seq"], [None if v != v else v for v in r["accZ_raw"]]) for r in packed.to_pylist()}
    assert packed.num_rows == 3 and got == {"b": ([2, 5], [None, 0.5]), "a": ([1, 2**63 - 1], [0.1, 9.0]), None: ([0, 3], [0.0, 0.3])}


def test_ingests_read_samples_put_in_order_once(spark, monkeypatch):
    seen, ingest = [], validate.ingest
    monkeypatch.setattr(validate, "ingest", lambda s, r, p: (seen.append(s._jdf.queryExecution().optimizedPlan().toString()), ingest(s, r, p))[1])
    assert sum(r.samples for r in queries.q_ingest(spark, "/root/testdata/sf0.001").collect()) > 0
    assert len(seen) == 3 and not any("Window" in plan for plan in seen)


def test_files_are_parsed_and_counted_once_for_both_modes(spark, monkeypatch):
    seen, with_dt = [], validate.with_dt
    monkeypatch.setattr(validate, "with_dt", lambda s, *more: (seen.append(s._jdf.queryExecution().optimizedPlan().toString()), with_dt(s, *more))[1])
    assert {r["mode"] for r in queries.q_validate_files(spark, "/root/testdata/sf0.001").collect()} == {"mock", "real"}
    assert len(seen) == 1 and "try_cast" not in seen[0]
