"""Incremental ingest: files that arrive are saved once, however often the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Keyed


def ledger(spark: SparkSession, path: str, keys: tuple[str, ...], schema: T.StructType) -> Keyed:
    """A ledger for ``ingest``: rows in buckets of their keys, and in these by batch."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return Keyed(spark, path, keys, whole, ("batch",))


def ingest(stream: DataFrame, table: Keyed, checkpoint: str, order: str) -> StreamingQuery:
    """Append rows whose keys the ledger does not have, the first of a batch for each key; the finished run.

    A run takes all that has arrived. A batch reads only the ledger's buckets of its own keys. The checkpoint
    remembers what was taken, and a batch that is run again after a failure is held against the batches before
    it and overwrites its own folders, so it stays the same."""
    keys = list(table.keys)

    def save(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").persist()  # its keys are looked at first
        try:
            table.put(table.missing(first, F.col("batch") < batch_id).withColumn("batch", F.lit(batch_id)))
        finally:
            first.unpersist()

    return _ended(stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _ended(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def suppressed(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """The first row of each key, as far as ``delay`` reaches: state holds a key from its arrival until the watermark
    has passed it by ``delay``, so it follows the rate of arrival and not the number of keys ever seen. Rows
    older than the watermark are dropped. What comes again later than that is for the ledger to know."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the rows of a table's files, ``files`` of them in a batch at most. As a pattern, the path may be a
    single file as well as a folder."""
    schema, reader = spark.read.parquet(path).schema, spark.readStream
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
