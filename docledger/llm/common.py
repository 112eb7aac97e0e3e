"""Small helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docledger-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``. Only where that
    is unset and all runs on one machine (tests), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The folders of written intermediates, by the frame that reads them.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Short rows (ids, edges) for one task.
ROWS = 100_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of actions in here go as soon as these are done; none of their frames is used again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def collected(df: DataFrame) -> list[Row]:
    """``df``, of bounded size and not used again, on the driver."""
    with _shuffles_go(df.sparkSession):
        return df.collect()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage
    ends there, and a lost executor costs nothing that was written. The shuffle files that
    led to it go at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders of frames that ``materialise`` returned and that nothing reads any
    more: neither a frame that is still to be computed nor the caller's result."""
    for df in frames:
        if path := _written.pop(df, None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fitted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, short rows that are written, in no more partitions than these fill: a task gets at most about ROWS.
    A plan over few rows then takes few tasks, however many partitions a shuffle has."""
    return df.coalesce(tasks(df.count() if rows is None else rows))


def tasks(rows: int) -> int:
    """How many tasks short rows fill, at least one."""
    return max(1, -(-rows // ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_group(df: DataFrame, keys: list[str], aggs: dict[str, Column], total: int) -> DataFrame:
    """Add aggregates over the rows of equal ``keys`` to every row.

    Keys with more than 1 / (4 * partitions) of the ``total`` rows are hot; there are
    at most 4 * partitions of them, so their aggregates, made with map-side partial
    sums, are broadcast. All other keys go through one window, whose largest group is
    thereby bounded by a quarter of a mean partition (or 64 rows)."""
    spark = df.sparkSession
    most = max(64, total // (4 * partitions(spark)))
    digest = F.xxhash64(*keys)
    # a hot key's bucket is hot; counts of buckets take one short row from each task
    bucket = F.pmod(digest, F.lit(1 << 16))
    heavy = [r[0] for r in collected(df.groupBy(bucket.alias("_b")).count().where(F.col("count") > most))]
    hot = []
    if heavy:
        some = df if len(heavy) > 1 << 12 else df.where(bucket.isin(heavy))
        hot = [r[0] for r in collected(some.groupBy(digest.alias("_h")).count().where(F.col("count") > most))]
    over = Window.partitionBy(*keys)
    if not hot:
        return df.withColumns({k: v.over(over) for k, v in aggs.items()})
    cold = df.where(~digest.isin(hot)).withColumns({k: v.over(over) for k, v in aggs.items()})
    some = df.where(digest.isin(hot))
    stats = some.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    return cold.unionByName(some.join(F.broadcast(stats), keys).select(*cold.columns))


def sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """All of a small table, else about ``rows`` rows, chosen by a hash of ``key``, whose values
    are all but unique. No task hands on more than its own share."""
    n = df.count()
    below = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < F.lit(int(rows / n * (1 << 30)) if n else 0)
    return df if n <= rows else df.where(below)


def rowed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique row id, and that column's name, which no column of ``docs`` has in any case. The id
    is doc_id itself, or where that is null or repeats or there is none, a number that is written
    with the rows once."""
    row, taken = "_row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    if "doc_id" in docs.columns and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        found = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null")
        if not found.limit(1).count():
            return docs.withColumn(row, F.col("doc_id").cast("long")), row
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rowed"), row


def only(docs: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """The rows of ``docs`` whose ``row`` is in ``rows``, without that column."""
    return docs.join(rows.select(row), row, "left_semi").drop(row)


def dense_slots(df: DataFrame, classes: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each class, in the given order, without a
    window over a whole class: a range sort, then offsets from the counts of each
    (partition, class), of which there are at most partitions + classes."""
    spark = df.sparkSession
    keys = [*classes, *order]
    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    laid = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    laid = materialise(laid, "slots")
    runs = laid.groupBy("_pid", *classes).agg(F.min("_i").alias("_lo"), F.count("*").alias("_n"))
    seen: dict[tuple, int] = {}
    rows = []
    for r in sorted(runs.collect(), key=lambda r: r["_lo"]):
        key = tuple(r[c] for c in classes)
        rows.append((r["_pid"], *key, seen.get(key, 0) - r["_lo"]))
        seen[key] = seen.get(key, 0) + r["_n"]
    kinds = ", ".join(f"_c{k} {laid.schema[c].dataType.simpleString()}" for k, c in enumerate(classes))
    shift = spark.createDataFrame(rows, f"_p int, {kinds}, _shift long")
    same = F.col("_pid") == F.col("_p")
    for k, c in enumerate(classes):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{k}"))
    return laid.join(F.broadcast(shift), same).withColumn(out, F.col("_i") + F.col("_shift")).select(*df.columns, out)
