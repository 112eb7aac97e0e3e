"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of 1000 tokens, in and out, of the model that others are priced as.
DEFAULT = {"rate_in": 0.15, "rate_out": 0.60}


def priced(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Add ``cost``. Models are looked up by upper case with dashes as underscores; what
    is not found (a name with a dot, for one) is priced as the default. ``pricing`` is a fixed
    table of a few rows, so it is broadcast."""
    p = F.broadcast(pricing.select("key", "rate_in", "rate_out"))
    key = F.replace(F.upper("model"), F.lit("-"), F.lit("_"))
    joined = usage.withColumn("_key", key).join(p, F.col("_key") == F.col("key"), "left")
    rate = lambda c: F.coalesce(c, F.lit(DEFAULT[c]))
    cost = F.col("input_tokens") / F.lit(1000.0) * rate("rate_in") + F.col("output_tokens") / F.lit(1000.0) * rate("rate_out")
    return joined.withColumn("cost", cost).drop("_key", "key", "rate_in", "rate_out")


def operations(usage: DataFrame, pricing: DataFrame, name: Column, at: Column, metadata: dict[str, Column]) -> DataFrame:
    """The log of operations: name, model, tokens in, out and in all, cost, timestamp, and a map of what else is known
    about each; entries without a value are left out of it."""
    entries = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k), v.cast("string"))) for k, v in sorted(metadata.items())])))
    total = F.col("input_tokens") + F.col("output_tokens")
    return priced(usage, pricing).select(name.alias("op_name"), "model", "input_tokens", "output_tokens", total.alias("total_tokens"), "cost", at.alias("timestamp"), entries.alias("metadata"))


def totals() -> list:
    """Aggregates: tokens in, out and in all; missing ones count as 0."""
    i, o = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    return [i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens")]


def from_payload(payloads: DataFrame) -> DataFrame:
    """doc_id, input_tokens, output_tokens, total_tokens of a payload's usage entry; the total defaults to the
    sum; null without an entry."""
    get = lambda k: F.get_json_object("payload", f"$._token_usage.{k}").try_cast("int")
    i, o = get("input_tokens"), get("output_tokens")
    return payloads.select("doc_id", i.alias("input_tokens"), o.alias("output_tokens"), F.coalesce(get("total_tokens"), i + o).alias("total_tokens"))
