"""Keyed updates of written tables: only the buckets that an update touches are read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Keyed
from .relational import keyed_update, partial_update


def update(table: Keyed, updates: DataFrame, columns: list[str], key: tuple[str, ...] = (), partial: bool = False) -> None:
    """Rows with an update of the same ``key`` (the table's own keys and perhaps more) take its ``columns``; with
    ``partial``, where these are not null. ``updates`` has a key once."""
    change = partial_update if partial else keyed_update
    table.change(updates, change(table.of(updates), updates, list(key or table.keys), columns))


def fail(table: Keyed, failures: DataFrame) -> None:
    """Rows of ``failures`` (id, error, completed_at) are marked as failed, whoever's they are."""
    update(table, failures.withColumn("status", F.lit("failed")), ["status", "error", "completed_at"])


# ---- users
def by_email(users: Keyed, emails: DataFrame) -> DataFrame:
    return users.rows().join(emails.select("email").distinct(), "email", "left_semi")


def by_id(users: Keyed, ids: DataFrame) -> DataFrame:
    """Users by id: a read of their buckets only."""
    return users.of(ids).drop("bucket").join(ids.select("id").distinct(), "id", "left_semi")


def get_or_create(users: Keyed, emails: DataFrame) -> None:
    """Users of these emails who are not there yet are added, active, with an id that follows from the email, so that a
    second run adds nobody."""
    new = emails.select("email").distinct().join(users.rows().select("email"), "email", "left_anti")
    number = F.conv(F.substring(F.sha2("email", 256), 1, 15), 16, 10).cast("long")
    users.append(new.select(number.alias("id"), "email", F.lit(True).alias("is_active")))


def delete(users: Keyed, purchases: Keyed, items: Keyed, gone: DataFrame) -> None:
    """Users (by id) go with their purchases, and these with their items, from the last to the first, so that a run
    that breaks off can be run again."""
    users_gone = gone.select(F.col("id").alias("user_id"))
    theirs = purchases.of(users_gone).join(users_gone, "user_id", "left_semi")
    items.delete(theirs.select(F.col("id").alias("receipt_id")))
    purchases.delete(users_gone)
    users.delete(gone)
