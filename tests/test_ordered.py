"""Scans by key against plain windows, with keys that hold a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.operators import attempts, ordered, trace

ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def events(spark):
    """A third of the rows in one key, as many without one, many in a second; equal times, nulls."""
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        key = 7 if i % 3 == 0 else None if i % 6 == 1 else 8 if i % 6 == 2 else rng.randint(10, 600)
        rows.append((i, key, rng.choice([None, *range(400)]) if key != 8 else rng.randint(0, 3), rng.choice(["A", "B", None]), rng.choice([None, 1, 5, -2])))
    return spark.createDataFrame(rows, "id long, key long, ts int, stage string, n int").repartition(6).cache()


def scans():
    return {"number": ordered.numbered(), "sum": ordered.running_sum(F.col("n")), "before": ordered.previous(F.col("stage"), ORDER), "after": ordered.following(F.col("stage"), ORDER)}


def plain(df):
    over = Window.partitionBy("key").orderBy(*ORDER)
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"number": F.row_number().over(over), "sum": F.sum("n").over(so_far), "before": F.lag("stage").over(over), "after": F.lead("stage").over(over)})


@pytest.mark.parametrize("least", [50, 300, 100_000])
def test_scans(events, least):
    found, expected = ordered.scan(events, "key", ORDER, scans(), least), plain(events)
    assert found.schema.simpleString() == expected.schema.simpleString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_a_hot_key_is_spread(spark, events):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all of a small table meets in one task
    hot = ordered.cuts(events, "key", ORDER, 300)
    assert sorted(str(k) for k, _ in hot) == ["7", "8", "None"]
    out = ordered.scan(events, "key", ORDER, {"number": ordered.numbered()}, 300)
    tasks = out.where("key = 7 and number > 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 1200
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_nothing_is_hot(events):
    assert ordered.cuts(events, "key", ORDER) == [] == ordered.cuts(events.limit(0), "key", ORDER, 0) == ordered.cuts(events, "key", ["stage"], 1)
    assert ordered.scan(events.limit(0), "key", ORDER, scans(), 0).collect() == []


def test_operators_on_a_hot_run(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LEAST", 40)
    rng = random.Random(4)
    rows = [(1 if i % 3 == 0 else rng.randint(2, 90), i, rng.choice("AB")) for i in range(900)]
    t = spark.createDataFrame(rows, "run_id long, seq int, stage string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 2))
    by_run = {}
    for run, seq, stage in sorted(rows):
        by_run.setdefault(run, []).append((seq, stage))
    kept = sorted((run, seq) for run, own in by_run.items() for k, (seq, stage) in enumerate(own) if not k or own[k - 1][1] != stage)
    assert sorted((r["run_id"], r["seq"]) for r in trace.collapsed(t).collect()) == kept
    waits = {(run, seq): (own[k + 1][0] - seq) * 2_000_000 if k + 1 < len(own) else None for run, own in by_run.items() for k, (seq, _) in enumerate(own)}
    assert {(r["run_id"], r["seq"]): r["duration_us"] for r in trace.durations(t).collect()} == waits
    tokens = t.select(F.col("run_id").alias("item_id"), F.col("seq").alias("attempt"), F.lit(2).alias("input_tokens"), F.lit(3).alias("output_tokens"))
    assert {(r["item_id"], r["attempt"]): r["tokens"] for r in attempts.cumulative(tokens).collect()} == {(run, seq): 5 * (k + 1) for run, own in by_run.items() for k, (seq, _) in enumerate(own)}
