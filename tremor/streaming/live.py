"""Structured Streaming: telemetry to the log, latest messages, and live windows with filter and transient state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tremor.config import DEFAULT, Sampling
from tremor.operators.features import FEATURES, usable, with_features
from tremor.operators.model import Linear, score_logreg
from tremor.operators.scan import filtered
from tremor.sources.io import latest_of_payloads, parse_telemetry, telemetry_to_log, to_telemetry_json
from tremor.sources.shared import exists, folders, remove, written


def stream_telemetry(source: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends the log rows of a stream of payloads; bad payloads are left out and the stream goes on."""
    rows = telemetry_to_log(parse_telemetry(source), keys)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What is kept of a stream: samples seen, the last ones of each axis and of the filtered axis (one run after the other), the filter's last input and output, the last RMS, and windows given.
STATE = "n long, held array<double>, x double, y double, rms double, emitted long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
State = tuple[int, list[float], float, float, float, int]
START: State = (0, [], 0.0, 0.0, -1.0, 0)


def advance(state: State, fresh: np.ndarray, size: int, hop: int, alpha: float | None, threshold: float) -> tuple[State, list[tuple]]:
    """The state after more samples (a row an axis), and the windows that they fill: (number, start, an array for each axis and the filtered one, rms, is_transient)."""
    n, held, x0, y0, rms, emitted = state
    z = fresh[-1]
    if alpha is not None and len(z):
        # from zero state, and then what the last input and output add
        x = z
        z = filtered(x, alpha) + alpha ** np.arange(1, len(x) + 1) * (y0 - x0)
        x0, y0 = float(x[-1]), float(z[-1])
    run = np.concatenate([np.asarray(held, float).reshape(len(fresh) + 1, -1), np.vstack([fresh, z])], axis=1)
    start, out = n - (run.shape[1] - len(z)), []
    n += len(z)
    at = emitted * hop
    while at + size <= n:
        window = run[:, at - start : at - start + size]
        now = float(np.sqrt(np.mean(window[-1] ** 2)))
        out.append((emitted, at, *window.tolist(), now, bool(rms > 0 and abs(now - rms) / rms > threshold)))
        rms, emitted, at = now, emitted + 1, at + hop
    return (n, run[:, max(0, min(at, n) - start) :].ravel().tolist(), x0, y0, rms, emitted), out


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples (stream_id, seq, axes) with those of one stream_id in a batch as one row of lists, in order of seq: a row costs the stateful step far more than a number in a list."""
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0)
        # keys that are structs or lists have no codes, and their rows stay apart
        codes = np.arange(len(key)) if pa.types.is_nested(key.type) else key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        seq = b.column(1).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        order = np.lexsort((seq, codes))
        starts = np.flatnonzero(np.diff(codes[order], prepend=codes[order[0]] - 1))
        ends = pa.array(np.append(starts, len(order)), pa.int32())
        values = [pa.array(seq[order]), *(pa.array(c.fill_null(np.nan).to_numpy(zero_copy_only=False)[order]) for c in b.columns[2:])]
        yield pa.RecordBatch.from_arrays([key.take(pa.array(order[starts])), *(pa.ListArray.from_arrays(ends, v) for v in values)], names=b.schema.names)


class LiveWindows(StatefulProcessor):
    """Keeps each stream's state in the state store. A stream that is silent for so many milliseconds is dropped, and starts anew when it comes again."""

    def __init__(self, size: int, hop: int, axes: tuple[str, ...], alpha: float | None, threshold: float, silent_ms: int | None):
        self.size, self.hop, self.axes, self.alpha, self.threshold, self.silent_ms = size, hop, axes, alpha, threshold, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.live = handle, handle.getValueState("live", STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        last = initialState.iloc[0]
        self.live.update((int(last["n"]), [float(v) for v in last["held"]], float(last["x"]), float(last["y"]), float(last["rms"]), int(last["emitted"])))
        self.wake(timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        order = np.argsort(np.concatenate(own["seq"].to_list()), kind="stable")
        fresh = np.stack([np.concatenate(own[c].to_list()).astype(float)[order] for c in self.axes])
        state, out = advance(self.live.get() or START, fresh, self.size, self.hop, self.alpha, self.threshold)
        self.live.update(state)
        self.wake(timerValues)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["stream_id", "local_id", "start_seq", *self.axes, "accZ_filt", "rms", "is_transient"])

    def wake(self, timers: TimerValues) -> None:
        """Sets the stream's only timer anew."""
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.clear()
        return iter([])

    def close(self) -> None:
        pass


def live_windows(
    samples: DataFrame, size: int, hop: int, axes: tuple[str, ...] = ("accX_raw", "accY_raw", "accZ_raw"), alpha: float | None = None, threshold: float = 0.5, silent_ms: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Windows of size samples of each stream_id, every hop once full, from a stream of (stream_id, seq, axes): local_id, start_seq, an array for each axis, accZ_filt, rms and is_transient.

    accZ_filt is the last axis, high-passed if alpha is given; rms is its. is_transient compares it with the window before. The state of a stream is its last size - hop
    samples, the filter's last input and output and the last RMS, so results don't depend on how the stream is cut into batches. Rows of a batch are put in order
    of seq. stream_id may have any type. silent_ms: streams that are silent for so long are dropped from the state (batches without data look for them too, so a query that is to end needs
    spark.sql.streaming.noDataMicroBatches.enabled off). initial (stream_id and the fields of STATE, as live_state reads
    them) is what streams begin with when the query is new. State is typed and kept in RocksDB, which this sets for the session.
    """
    kind = dict(samples.dtypes)["stream_id"]
    rows_schema = f"stream_id {kind}, local_id long, start_seq long, {', '.join(f'`{c}` array<double>' for c in (*axes, 'accZ_filt'))}, rms double, is_transient boolean"
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    begun = initial.groupBy("stream_id") if initial is not None else None
    processor = LiveWindows(size, hop, tuple(axes), alpha, threshold, silent_ms)
    numbers = samples.select("stream_id", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in axes])
    packed = numbers.mapInArrow(pack, f"stream_id {kind}, seq array<long>, {', '.join(f'`{c}` array<double>' for c in axes)}")
    return packed.groupBy("stream_id").transformWithStateInPandas(processor, rows_schema, "append", "ProcessingTime" if silent_ms is not None else "None", begun)


def live_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """stream_id and the fields of STATE as a query of live_windows has left them in its checkpoint: a batch table, to look at or to begin another query with."""
    kept = spark.read.format("statestore").option("stateVarName", "live").load(checkpoint)
    return kept.select("key.*", "value.*")


def stream_windows(samples: DataFrame, size: int, hop: int, alpha: float | None = None, threshold: float = 0.5) -> DataFrame:
    """live_windows of accZ_raw alone: stream_id, local_id, start_seq, z (filtered), rms and is_transient."""
    return live_windows(samples, size, hop, ("accZ_raw",), alpha, threshold).select("stream_id", "local_id", "start_seq", F.col("accZ_filt").alias("z"), "rms", "is_transient")


def stream_scores(samples: DataFrame, model: Linear, size: int, hop: int, alpha: float | None = None, threshold: float = 0.5, p: Sampling = DEFAULT) -> DataFrame:
    """stream_id, local_id, start_seq, is_transient, the eight features, prediction, confidence and payload (the telemetry message) of each live window.

    The operators of the batch jobs, on the windows as they fill; windows with values that aren't finite are left out.
    """
    rows = with_features(usable(live_windows(samples, size, hop, alpha=alpha, threshold=threshold), size), p, size)
    keys = ["stream_id", "local_id", "start_seq", "is_transient", *FEATURES, "prediction", "confidence"]
    return to_telemetry_json(score_logreg(rows, model), keys, F.col("start_seq"), F.col("probabilities"))


def stream_snapshot(source: DataFrame, path: str, checkpoint: str, device: str, order: str, buckets: int = 64, kept: int = 5) -> StreamingQuery:
    """Keeps the latest payload with an inference of each device of a stream (device, order, payload).

    Devices are dealt into buckets by a hash. A batch merges and writes the buckets it touches alone, as path/data/version=<batch>/bucket=<k>, and then a manifest (path/manifest/version=<batch>) that
    names the version of every bucket; until the manifest stands, readers see the version before. A batch that is done again writes the same folders. The last kept manifests and all they name stay
    readable; what only older ones name is deleted.
    """
    if buckets < 1 or kept < 1:
        raise ValueError("one bucket and one manifest at least")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = latest_of_payloads(batch, device, order).select(device, order, F.to_json("message").alias("payload"), F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int").alias("bucket"))
        latest = written(latest, "latest")
        old = {v: m for v, m in manifests(spark, path).items() if v < number}
        now = dict(old[max(old)]) if old else {}
        touched = [r.bucket for r in latest.select("bucket").distinct().collect()]  # as many as buckets, at most
        before = [f"{path}/data/version={now[k]}/bucket={k}" for k in touched if k in now]
        if touched:
            if before:
                rows = spark.read.schema(latest.drop("bucket").schema).parquet(*before)
                latest = latest.unionByName(rows.withColumn("bucket", F.pmod(F.xxhash64(device), F.lit(buckets)).cast("int")))
            last = F.max_by(F.struct(order, "payload"), order)
            merged = latest.groupBy("bucket", device).agg(last.alias("last")).select(device, f"last.{order}", "last.payload", "bucket")
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
            now |= dict.fromkeys(touched, number)
        rows = spark.createDataFrame([(k, v) for k, v in now.items()], "bucket int, written long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
        if not old:
            latest.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{path}/empty")
        stand = sorted([*old, number])[-kept:]
        named = {(k, v) for m in (now, *(old[v] for v in stand if v != number)) for k, v in m.items()}
        for v in [v for v in old if v not in stand]:
            for k, w in old[v].items():
                if (k, w) not in named:
                    remove(spark, f"{path}/data/version={w}/bucket={k}")
            remove(spark, f"{path}/manifest/version={v}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifests(spark: SparkSession, path: str) -> dict[int, dict[int, int]]:
    """The manifests below path: version to bucket to the version that holds it. A few of them, each as long as there are buckets."""
    if not exists(spark, f"{path}/manifest"):
        return {}
    out: dict[int, dict[int, int]] = {v: {} for v in folders(spark, f"{path}/manifest", "version=")}
    if out:
        for r in spark.read.schema("bucket int, written long, version long").option("basePath", f"{path}/manifest").parquet(*[f"{path}/manifest/version={v}" for v in out]).collect():
            out[r.version][r.bucket] = r.written
    return out


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest version that stream_snapshot has written, or an older one that still stands."""
    every = manifests(spark, path)
    held = every[max(every) if version is None else version]
    none = spark.read.parquet(f"{path}/empty")
    files = [f"{path}/data/version={v}/bucket={k}" for k, v in held.items()]
    return spark.read.schema(none.schema).parquet(*files) if files else none
