"""Filters, top-k lists, joins and profiles over the ledger's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_user(purchases: DataFrame, user_id: int, status: str | None = None) -> DataFrame:
    out = purchases.where(F.col("user_id") == user_id)
    return out if status is None else out.where(F.col("status") == status)


def page(df: DataFrame, column: str, default: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a listing; an unknown column means ``default``; ties go by id."""
    c = F.col(column if column in df.columns else default)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), "id").offset(offset).limit(limit)


def first_by(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def keyed_update(table: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """A snapshot of ``table`` in which rows with an update take its ``columns``, nulls included."""
    u = updates.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_u_{c}") for c in columns], F.lit(True).alias("_hit"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in key])
    joined = table.join(u, same, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def partial_update(table: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The same, but a null in an update leaves the row's value as it is."""
    u = updates.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_u_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in key])
    joined = table.join(u, same, "left")
    return joined.select(*[F.coalesce(f"_u_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def unmatched(updates: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Updates whose key is not in ``table``: what a caller has to report as missing."""
    return updates.join(table.select(*key).distinct(), key, "left_anti")


def violations(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """kind, key, n for keys that occur more than once; rows with a null key part do not count."""
    some = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    grouped = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return grouped.select(F.lit(kind).alias("kind"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")


def profile(df: DataFrame, name: str, key: str, required: list[str], advice_rows: int = 10_000) -> DataFrame:
    """One row about a table: row count, null keys, missing required columns, advice."""
    missing = [c for c in required if c not in df.columns]
    n = F.count(F.lit(1))
    return df.agg(
        F.lit(name).alias("table_name"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        n.alias("n_rows"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
        F.lit(",".join(missing)).alias("missing_columns"),
        (n > advice_rows).alias("large"),
    )


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def as_double(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]
