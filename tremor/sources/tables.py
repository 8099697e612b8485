"""Tables that are dealt into buckets when they are written, so that joins on the buckets' keys need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int | None = None, partition: str | None = None) -> DataFrame:
    """df as table `name` in files below path, bucketed and sorted by keys (within folders of partition, if one is given); gives the table.

    Rows are dealt by the keys once, here: a task writes one file a bucket. Tables of the same keys and number of buckets (as many as shuffle partitions unless given) join, and group, where they are.
    Take keys of which none holds a large share of the rows: segment and window beside the stream.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return spark.table(name)
