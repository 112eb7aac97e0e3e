"""The retry ladder as set operations over a table of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import FALLBACK
from .ordered import running_sum, scan

#: Names of the rungs.
SELF, FOCUSED, SECOND = "LLM_SELF_CORRECTION", "RAG_FOCUSED_CONTEXT", "OCR_FALLBACK"


def ladder(severity: Column, quality: Column, has_second: Column) -> Column:
    """Rungs that a failed document climbs, in order, at most two."""
    one = F.when(severity.isin("small", "medium"), F.lit(SELF))
    two = F.when(severity.isin("medium", "large"), F.lit(FOCUSED))
    three = F.when(has_second & ((quality < FALLBACK) | severity.isin("medium", "large")), F.lit(SECOND))
    return F.slice(F.array_compact(F.array(one, two, three)), 1, 2)


def best(attempts: DataFrame, key: str = "item_id") -> DataFrame:
    """Per item: the first success, else the last attempt that parsed, else the last error."""
    chosen = F.coalesce(F.min(F.when(F.col("success"), F.col("attempt"))), F.max(F.when(F.col("parsed"), F.col("attempt"))))
    last = F.max_by("error", F.col("attempt"))
    out = attempts.groupBy(key).agg(chosen.alias("attempt"), F.bool_or("success").alias("success"), last.alias("last_error"))
    return out.withColumn("error", F.when(F.col("attempt").isNull(), F.col("last_error"))).drop("last_error")


def history(attempts: DataFrame, budget: int = 3) -> DataFrame:
    """Per item: attempts, retries, what failed attempts would try next, whether the budget is spent."""
    n, ok = F.count(F.lit(1)), F.bool_or("success")
    tried = F.when(~F.col("success"), F.when(F.col("error_type") == "ValueError", F.lit(SELF)).otherwise(F.coalesce("strategy", F.lit("none"))))
    listed = F.sort_array(F.collect_list(F.when(tried.isNotNull(), F.struct("attempt", tried.alias("s")))))
    return attempts.groupBy("item_id").agg(n.alias("attempts"), F.greatest(F.lit(0), n - 1).alias("retries"), F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("strategies"), ((n >= budget) & ~ok).alias("exhausted"))


def strategies(attempts: DataFrame) -> DataFrame:
    used = F.sort_array(F.collect_list(F.when(F.col("strategy").isNotNull(), F.struct("attempt", "strategy"))))
    return attempts.groupBy("item_id").agg(F.array_join(F.transform(used, lambda x: x["strategy"]), ",").alias("strategies"))


def gate(attempts: DataFrame, least: float = 0.5, budget: int = 3) -> DataFrame:
    """Per item the first attempt within the budget whose quality is at least ``least``, or null."""
    fits = (F.col("attempt") <= budget) & (F.col("quality") >= least)
    return attempts.groupBy("item_id").agg(F.min(F.when(fits, F.col("attempt"))).alias("attempt"))


def cumulative(attempts: DataFrame) -> DataFrame:
    """Add ``tokens``: what an item has used up to and with each attempt."""
    return scan(attempts, "item_id", ["attempt"], {"tokens": running_sum(F.col("input_tokens") + F.col("output_tokens"))})
