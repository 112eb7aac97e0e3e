"""Processing traces: counts, durations and invariants, as scans and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import following, previous, scan

#: How many times a stage may run again.
MOST = {"OCR": 3, "PARSE": 2, "PERSIST": 3}


def stage_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("success")).alias("failed"))


def durations(trace: DataFrame) -> DataFrame:
    """Microseconds until the run's next event."""
    after = scan(trace, "run_id", ["seq"], {"_after": following(F.col("ts"), ["seq"])})
    return after.withColumn("duration_us", F.unix_micros("_after") - F.unix_micros("ts")).drop("_after")


def over_budget(trace: DataFrame) -> DataFrame:
    """Runs and stages with more retries than allowed."""
    most = F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv])
    return stage_counts(trace).withColumn("retries", F.col("attempts") - 1).where(F.col("retries") > F.try_element_at(most, F.col("stage")))


def broken_writes(runs: DataFrame) -> DataFrame:
    """Runs (attempts, writes, duplicates) that break the write invariant."""
    return runs.where("writes > attempts or duplicates < attempts - writes")


def after_terminal(trace: DataFrame) -> DataFrame:
    """Events after a run's first terminal one: an aggregate and a join, so that a hot run is summed up
    map-side."""
    ends = trace.where("terminal").groupBy(F.col("run_id").alias("_run")).agg(F.min("seq").alias("_end"))
    return trace.join(ends, (F.col("run_id") == F.col("_run")) & (F.col("seq") > F.col("_end"))).drop("_run", "_end")


def persist_without_validate(trace: DataFrame) -> DataFrame:
    """PERSIST events before the run's first VALIDATE that passed, or in a run without one."""
    passed = trace.where("stage = 'VALIDATE' and success").groupBy(F.col("run_id").alias("_run")).agg(F.min("seq").alias("_seen"))
    late = trace.where("stage = 'PERSIST'").join(passed, F.col("run_id") == F.col("_run"), "left")
    return late.where("_seen is null or _seen > seq").drop("_run", "_seen")


def retry_pattern(trace: DataFrame) -> DataFrame:
    """Per run and stage: whether all attempts but the last failed and the last succeeded."""
    last = F.max_by("success", "seq") & (F.count_if("success") == 1)
    return trace.groupBy("run_id", "stage").agg(last.alias("retried_to_success"))


def collapsed(trace: DataFrame) -> DataFrame:
    """Without events that repeat the stage before."""
    before = scan(trace, "run_id", ["seq"], {"_before": previous(F.col("stage"), ["seq"])})
    return before.where("_before is null or _before <> stage").drop("_before")
