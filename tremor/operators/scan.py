"""Scans over streams longer than a sorted partition: chunks first, then the small table of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.sources.shared import new_path


def running_sum(chunked: DataFrame, value: Column, name: str, keys: list[str]) -> DataFrame:
    """The running sum of value over keys in order of (chunk, seq): within chunks, plus the sums of the chunks before."""
    rows = chunked.withColumn("_value", value)
    totals = rows.groupBy(*keys, "chunk").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    within = Window.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, [*keys, "chunk"]).withColumn(name, F.sum("_value").over(within) + F.col("_offset")).drop("_value", "_offset")


def with_before(samples: DataFrame, value: Column, name: str, chunk: int) -> DataFrame:
    """samples with chunk (rows of seq) and name: value in the row before of the stream in order of seq, null for its first row.

    The last value of each chunk is handed to the next one over the table of chunks, so a long stream is not one task's. seq may have holes.
    """
    chunked = samples.withColumn("chunk", F.floor(F.col("seq") / chunk).cast("long"))
    ends = chunked.groupBy("stream_id", "chunk").agg(F.max_by(value, "seq").alias("_last"))
    handed = ends.select("stream_id", "chunk", F.lag("_last").over(Window.partitionBy("stream_id").orderBy("chunk")).alias("_handed"))
    within = Window.partitionBy("stream_id", "chunk").orderBy("seq")
    own = F.when(F.row_number().over(within) == 1, F.col("_handed")).otherwise(F.lag(value).over(within))
    return chunked.join(handed, ["stream_id", "chunk"], "left").withColumn(name, own).drop("_handed")


def filtered(x: np.ndarray, alpha: float) -> np.ndarray:
    """y[i] = alpha (y[i-1] + x[i] - x[i-1]) from y = x = 0 before the first, in blocks short enough that no power of alpha vanishes."""
    step = np.diff(x, prepend=0.0)
    out, y, size = np.empty(len(x)), 0.0, 256
    powers = alpha ** np.arange(1, size + 1)
    for i in range(0, len(x), size):
        s = step[i : i + size]
        p = powers[: len(s)]
        out[i : i + len(s)] = p * (y + np.cumsum(s * alpha / p))
        y = out[min(i + size, len(x)) - 1]
    return out


def running_number(keys: DataFrame, order: list[str], count: str, name: str) -> DataFrame:
    """keys with name: the sum of count over all rows before in order, which may have keys of any type.

    Rows are sorted in ranges, stored with the number of their range, and summed within it; the sums of the ranges before come from a table of one row a range.
    """
    spark = keys.sparkSession
    path = new_path(spark, "ranges")
    keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum(count).alias("_n"))
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before(Window.orderBy("_range"))), F.lit(0)).alias("_offset"))
    inner = F.coalesce(F.sum(count).over(before(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    return ranged.withColumn("_inner", inner).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_inner") + F.col("_offset")).drop("_range", "_inner", "_offset")


def new_groups(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row counts as a change."""
    out = np.zeros(len(rows), bool)
    for k in keys:
        own, before = rows[k], rows[k].shift()
        out |= ~((own == before) | (own.isna() & before.isna())).to_numpy(bool)
    out[:1] = True
    return out


def high_pass(samples: DataFrame, columns: dict[str, str], alpha: float = 0.9936, chunk: int = 100_000, warmup: int = 0) -> DataFrame:
    """Each column of columns, high-passed under its new name, for each stream in order of seq from zero state; the first warmup rows only prime.

    A stream is filtered in chunks from zero state, many chunks one after the other in a task, and stored. Row i of a chunk then lacks alpha**(i + 1) (y - x), y and x being
    the last output and input before the chunk; these carries come from a fold over the table of chunk ends. seq must be dense; stream_id may have any type.
    """
    spark = samples.sparkSession
    chunked = samples.withColumn("chunk", F.floor(F.col("seq") / chunk).cast("long"))
    schema = f"{', '.join(f'`{n}` {t}' for n, t in chunked.dtypes)}, {', '.join(f'`{y}` double' for y in columns.values())}"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, dict.fromkeys(columns, (0.0, 0.0))  # the row before, and the last input and output of its chunk
        for rows in batches:
            if rows.empty:
                continue
            goes_on = last is not None and not new_groups(pd.concat([last, rows.iloc[:1]]), ["stream_id", "chunk"])[1]
            edges = np.append(np.flatnonzero(new_groups(rows, ["stream_id", "chunk"])), len(rows))
            for x, y in columns.items():
                own, out = rows[x].to_numpy(float), np.empty(len(rows))
                for i, j in zip(edges, edges[1:]):
                    out[i:j] = filtered(own[i:j], alpha)
                    if i == 0 and goes_on:
                        x0, y0 = state[x]
                        out[i:j] += alpha ** np.arange(1, j + 1) * (y0 - x0)
                rows[y], state[x] = out, (own[-1], out[-1])
            last = rows.iloc[-1:]
            yield rows

    def carries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, carry = None, dict.fromkeys(columns, 0.0)
        for rows in batches:
            if rows.empty:
                continue
            fresh = new_groups(rows, ["stream_id"])
            fresh[0] = last is None or new_groups(pd.concat([last, rows.iloc[:1]]), ["stream_id"])[1]
            last = rows.iloc[-1:]
            decay = alpha ** rows["n"].to_numpy(float)
            for x, y in columns.items():
                held, now, ends = [], carry[x], (rows[f"{y}_end"] - rows[f"{x}_end"]).tolist()
                for first, d, end in zip(fresh, decay, ends):
                    now = 0.0 if first else now
                    held.append(now)
                    now = end + d * now
                carry[x] = now
                rows[f"{y}_carry"] = held
            yield rows[["stream_id", "chunk", *[f"{y}_carry" for y in columns.values()]]]

    path = new_path(spark, "filtered")
    chunked.repartition("stream_id", "chunk").sortWithinPartitions("stream_id", "chunk", "seq").mapInPandas(local, schema).write.parquet(path)
    each = spark.read.parquet(path)
    ends = each.groupBy("stream_id", "chunk").agg(F.count("*").alias("n"), *[F.max_by(c, "seq").alias(f"{c}_end") for both in columns.items() for c in both])
    # a row for each chunk of a stream
    carry_schema = f"stream_id {dict(samples.dtypes)['stream_id']}, chunk long, {', '.join(f'`{y}_carry` double' for y in columns.values())}"
    carried = ends.repartition("stream_id").sortWithinPartitions("stream_id", "chunk").mapInPandas(carries, carry_schema)
    place = F.col("seq") - F.col("chunk") * chunk
    whole = each.join(carried, ["stream_id", "chunk"])
    for y in columns.values():
        whole = whole.withColumn(y, F.col(y) + F.pow(F.lit(alpha), place + 1) * F.col(f"{y}_carry"))
    return whole.where(F.col("seq") >= warmup).drop("chunk", *[f"{y}_carry" for y in columns.values()])
