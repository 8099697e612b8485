"""What the operators of this subpackage share: input columns, the shared folder, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.shared import new_path, remove

#: Bytes of text that a Python task handles at once, whatever the size of Arrow's batches.
BLOCK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of the input can't clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(col: Column | str = "doc_id") -> Column:
    """crc32 of a key written as text; a null key counts as the empty text."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("")).cast("binary"))


def fold_is(modulus: int, remainder: int) -> Column:
    return id_crc() % modulus == remainder


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that stored has written, once nothing reads them any more."""
    for t in tables:
        if t is not None:
            remove(t.sparkSession, t.stored_at)


def free_name(base: str, *tables: DataFrame) -> str:
    """A column name like base that none of the tables has, whatever the case of its letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while base.lower() in taken:
        base += "_"
    return base


def blocks(batch: pa.RecordBatch, by: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes in column by each; a row is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes, dtype=np.int64) // limit
    starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Runs of texts, in order, of about limit characters; a text is never split."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizing mix of 64-bit values, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
