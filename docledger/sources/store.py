"""Ledger tables as folders of Parquet: plain ones, and keyed ones whose rows lie in buckets, so that a lookup
reads the buckets of its keys only and a change rewrites no others."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import exists

#: Folders of a keyed table; a parameter of the table, in step with its size.
BUCKETS = 32
#: Rows for one pass of a large job, and how many passes it takes at most: each reads the input again.
PASS_ROWS, PASSES = 5_000_000, 16
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder. Only where it is unset and all runs on one machine, a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="docledger-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def passes(rows: int) -> int:
    """In how many passes a job over so many rows goes, a power of two: the disk that its shuffles take at once is that of
    PASS_ROWS rows, or a share of one in PASSES."""
    return min(PASSES, 1 << (max(1, -(-rows // PASS_ROWS)) - 1).bit_length())


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of actions in here go as soon as these are done; none of their frames is used again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def staged(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """``rows``, written, as they are read several times in here; their files go at the end."""
    path = shared(rows.sparkSession, name)
    try:
        yield append(rows, path)
    finally:
        delete(rows.sparkSession, path)


def append(rows: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with ``rows`` added."""
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def snapshot(table: DataFrame, name: str) -> DataFrame:
    """A table written at a new path."""
    return append(table, shared(table.sparkSession, name))


@dataclass(frozen=True)
class Keyed:
    """A table at ``path`` whose rows lie in folders by a hash of ``keys``, and within these by ``parts``, if there are any.

    Changes overwrite the folders that they touch, as whole folders: files of others stay as they are. Two
    writers at once are not held apart. A frame that was read before a change must not be read after it."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    parts: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def dealt(self, rows: DataFrame) -> DataFrame:
        """The table's columns of ``rows``, in its types, and their bucket."""
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        return typed.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], whole)

    def rows(self) -> DataFrame:
        return self.read().drop("bucket")

    def within(self, buckets: Iterable[int]) -> DataFrame:
        """The rows in these buckets; others are not read."""
        return self.read().where(F.col("bucket").isin(list(buckets)))

    def of(self, rows: DataFrame) -> DataFrame:
        """All rows in the buckets of the keys of ``rows``; other buckets are not read."""
        return self.within(self._buckets(rows))

    def _buckets(self, rows: DataFrame) -> list[int]:
        keyed = rows.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys])
        return [r[0] for r in keyed.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).distinct().collect()]  # at most ``buckets``

    def _write(self, dealt: DataFrame, mode: str) -> None:
        out = dealt.hint("rebalance", "bucket")  # one file or few for a bucket; a large bucket is split among tasks
        out.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", *self.parts).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._write(self.dealt(rows), "append")

    def fill(self, rows: DataFrame, passes: int = 1, by: tuple[str, ...] = ()) -> None:
        """Append ``rows`` in so many passes, dealt by a hash of ``by``, or else of the table's keys. Each pass computes only
        its own share of ``rows``, as far as a condition on these columns can be pushed down to what is read, and its
        shuffle files go before the next begins. A run that breaks off has added the passes that ended."""
        number = F.pmod(F.xxhash64(*(by or self.keys)), F.lit(passes))
        with shuffles_go(self.spark):
            for i in range(passes):
                self.append(rows.where(number == i) if passes > 1 else rows)

    def put(self, rows: DataFrame) -> None:
        """Write ``rows`` in place of all that is in their folders."""
        self._write(self.dealt(rows), "overwrite")

    def missing(self, rows: DataFrame, where: Column | None = None) -> DataFrame:
        """The rows whose keys the table (of it, what is ``where``) does not have."""
        known = self.of(rows)
        return rows.join((known if where is None else known.where(where)).select(*self.keys), list(self.keys), "left_anti")

    def change(self, touched: DataFrame, new: DataFrame) -> None:
        """Put ``new`` (made from ``of(touched)``) in place of the buckets of the keys of ``touched``."""
        buckets = self._buckets(touched)
        left = {r[0] for r in new.select("bucket").distinct().collect()}
        if left:
            self._write(new, "overwrite")
        self.drop(set(buckets) - left)  # an overwrite leaves a folder alone for which it has no rows

    def drop(self, buckets: Iterable[int]) -> None:
        """All rows in these buckets go."""
        for b in buckets:
            delete(self.spark, f"{self.path}/bucket={b}")

    def replace(self, rows: DataFrame, passes: int = 1) -> None:
        """All rows of the keys of ``rows`` go, and ``rows`` take their place, in so many passes over groups of buckets, as in
        ``fill``: only one group is there twice at a time. With several, ``rows`` must not come from the table. A run
        that breaks off has changed the groups that ended, and can be run again."""
        dealt = self.dealt(rows)
        with shuffles_go(self.spark):
            for i in range(passes):
                with staged(dealt.where(F.col("bucket") % passes == i) if passes > 1 else dealt, "new") as new:
                    rest = self.of(new).join(new.select(*self.keys).distinct(), list(self.keys), "left_anti")
                    self.change(new, rest.select(*new.columns).unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        """Rows of these keys go."""
        rest = self.of(keys).join(keys.select(*self.keys).distinct(), list(self.keys), "left_anti")
        self.change(keys, rest.select(*self.schema.names, "bucket"))
