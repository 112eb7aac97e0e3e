"""Idempotent ingest: two-level duplicate lookup, in-batch precedence, write metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Keyed, append, delete, shared, shuffles_go, staged


def first_per_key(ledger: DataFrame, key: str) -> DataFrame:
    """user_id, key, id of the ledger's first row of each (user, key); null keys have none."""
    return ledger.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.min("id").alias("found"))


def lookup(batch: DataFrame, ledger: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``: the ledger id with the same user and ``key``, or null."""
    return batch.join(first_per_key(ledger, key).withColumnRenamed("found", out), ["user_id", key], "left")


def two_level(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """existing_id by image hash first, then by content hash."""
    both = lookup(lookup(batch, ledger, "image_hash", "by_image"), ledger, "data_hash", "by_data")
    return both.withColumn("existing_id", F.coalesce("by_image", "by_data"))


def first_write_wins(batch: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """first_id: the id of the earliest row of the batch with equal keys.

    An aggregate and a join instead of a window, so that a hot key is summed up map-side."""
    firsts = batch.groupBy(*keys).agg(F.min(order).alias("first_id"))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return batch.alias("b").join(firsts.alias("f"), cond).select("b.*", "f.first_id")


def save(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """id, result_id, tag: 'duplicate' of a ledger row (image, then content), of an earlier row
    of the batch (image, then content), or 'created'.

    A row of the batch counts as earlier only if it is itself created, which the first
    row of a content group among the image groups' first rows is."""
    return resolved(two_level(batch, ledger))


def resolved(seen: DataFrame) -> DataFrame:
    """``save`` from what ``two_level`` has found."""
    fresh = seen.where("existing_id is null").select("id", "user_id", "image_hash", "data_hash")
    by_image = first_write_wins(fresh, ["user_id", "image_hash"]).withColumnRenamed("first_id", "image_first")
    heads = by_image.where("id = image_first").drop("image_first")
    by_data = first_write_wins(heads, ["user_id", "data_hash"]).select(F.col("id").alias("head"), F.col("first_id").alias("data_first"))
    resolved = by_image.join(by_data, F.col("image_first") == F.col("head")).select("id", F.col("data_first").alias("result_id"))
    created = resolved.withColumn("tag", F.when(F.col("id") == F.col("result_id"), "created").otherwise("duplicate"))
    known = seen.where("existing_id is not null").select("id", F.col("existing_id").alias("result_id"), F.lit("duplicate").alias("tag"))
    return created.unionByName(known)


def insert(batch: DataFrame, ledger: Keyed, passes: int = 1) -> DataFrame:
    """``save`` against a ledger by user, of which only the users' buckets are read; the created rows are added. The tags,
    written.

    The batch is computed once, into buckets of users (in ``passes``, as in ``Keyed.fill``). Groups of these are saved one
    after the other, and what is staged of a group goes with it, as do its shuffle files: the batch is not there
    twice. A run that breaks off has added the groups that ended, whose rows a second run finds as duplicates."""
    spark, groups = ledger.spark, min(ledger.buckets, 2 * passes) if passes > 1 else 1
    arrived = Keyed(spark, shared(spark, "batch"), ledger.keys, batch.schema, buckets=ledger.buckets)
    arrived.fill(batch, passes, ("id",))
    path, paths = shared(spark, "saved"), []
    with shuffles_go(spark):
        for i in range(groups):
            group = range(i, ledger.buckets, groups)
            rows = arrived.within(group).drop("bucket")
            known = two_level(rows, ledger.of(rows)).select("id", "user_id", "image_hash", "data_hash", "existing_id")
            with staged(known, "seen") as seen:
                saved = append(resolved(seen), f"{path}/{i}")
            ledger.append(rows.join(saved.where("tag = 'created'").select("id"), "id", "left_semi"))
            arrived.drop(group)
            paths.append(f"{path}/{i}")
    delete(spark, arrived.path)
    return spark.read.schema(saved.schema).parquet(*paths)


def constraint_violations(created: DataFrame, ledger: DataFrame) -> DataFrame:
    """violations: created rows whose image is already there under another user, in the ledger or by an
    earlier row; one per user is allowed, one in all is not."""
    known = ledger.where("image_hash is not null").select("image_hash").distinct().withColumn("_known", F.lit(1))
    images = created.where("image_hash is not null").groupBy("image_hash").agg(F.count(F.lit(1)).alias("_n")).join(known, "image_hash", "left")
    return images.agg(F.coalesce(F.sum(F.col("_n") - F.when(F.col("_known").isNull(), 1).otherwise(0)), F.lit(0)).alias("violations"))


def write_metrics(saved: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: attempts, writes (attempts without duplicates), duplicates, constraint violations."""
    n, none = F.count(F.lit(1)), F.lit(0).cast("long")
    dup = F.count_if(F.col("tag") == "duplicate")
    counts = saved.agg(n.alias("attempts"), (n - dup).alias("writes"), dup.alias("duplicates")).withColumn("violations", none)
    names = counts.columns
    both = counts.unionByName(violations.select(*[none.alias(c) for c in names[:-1]], "violations"))
    return both.agg(*[F.sum(c).alias(c) for c in names])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: a rebuild that skips rows which collide. Sums up map-side, so a hot key is no
    hot task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
