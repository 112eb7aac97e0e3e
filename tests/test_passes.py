"""Large jobs in passes: the same results, and what a pass takes on disk goes before the next."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docledger.operators import dedupe
from docledger.plans import ORACLES, QUERIES
from docledger.sources import store
from docledger.sources.ledger import Ledger
from docledger.sources.store import Keyed

from .test_store import files

DATA = "/root/testdata/sf0.001"


def shuffles(spark):
    """Bytes of shuffle files."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(f) for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data"))


def shown(rows):
    return sorted(map(repr, rows))


def written(spark, name, monkeypatch):
    """A query in 4 passes against its SQL: shuffle bytes that are there when a part is written and at the end, and folders that
    are left."""
    begun, base, append, left = shuffles(spark), spark.conf.get("spark.checkpoint.dir"), Keyed.append, []

    def seen(self, rows):
        left.append(shuffles(spark) - begun)
        append(self, rows)

    monkeypatch.setattr(store, "PASS_ROWS", 2000, raising=False)
    monkeypatch.setattr(Keyed, "append", seen)
    before = set(os.listdir(base))
    found = QUERIES[name](spark, DATA)
    left.append(shuffles(spark) - begun)
    duck = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = duck.sql(ORACLES[name])
    assert shown(tuple(r) for r in found.select(*expected.columns).collect()) == shown(expected.fetchall())
    return left, {n.split("-")[0] for n in set(os.listdir(base)) - before}


def test_insert_in_passes_leaves_no_shuffle_files(spark, monkeypatch):
    left, folders = written(spark, "SNK1", monkeypatch)
    assert len(left) == 1 + 4 + 8 + 1 and max(left) < 5000 and folders == {"ledger", "saved"}


def test_replace_in_passes_leaves_no_shuffle_files(spark, monkeypatch):
    left, folders = written(spark, "SNK5", monkeypatch)
    assert len(left) == 4 + 1 and max(left) < 5000 and folders == {"items"}


def test_a_pass_reads_its_share_of_the_items(spark):
    some = Ledger(spark, DATA).items.where(F.pmod(F.xxhash64("receipt_id"), F.lit(8)) == 3)
    window, below = some._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)
    assert "pmod" in below and "pmod" not in window


def ledger_of(spark, path, old):
    table = Keyed(spark, path, ("user_id",), old.schema)
    table.append(old)
    return table


def test_insert_in_passes_is_the_same(spark, tmp_path):
    schema = "id long, user_id long, image_hash string, data_hash string"
    rows = [(i, None if i % 11 == 0 else i % 5, None if i % 13 == 0 else f"i{i % 37}", None if i % 7 == 0 else f"d{i % 29}") for i in range(400)]
    old, batch = spark.createDataFrame(rows[:60], schema), spark.createDataFrame(rows[60:], schema)
    expected = dedupe.save(batch, old).collect()
    for n in (1, 2):
        table = ledger_of(spark, str(tmp_path / f"t{n}"), old)
        saved = dedupe.insert(batch, table, n)
        assert shown(saved.collect()) == shown(expected) and len(expected) == 340
        created = {r["id"] for r in expected if r["tag"] == "created"}
        assert shown(tuple(r) for r in table.rows().collect()) == shown(r for r in rows if r[0] < 60 or r[0] in created)
    again = dedupe.insert(batch.where("user_id is not null and image_hash is not null").where(F.col("id").isin(list(created))), table)
    assert {r["tag"] for r in again.collect()} == {"duplicate"}
    assert dedupe.insert(batch.limit(0), table, 2).collect() == []


def test_passes():
    assert [store.passes(n) for n in (0, 1, store.PASS_ROWS, store.PASS_ROWS + 1, 3 * store.PASS_ROWS, 10**12)] == [1, 1, 1, 2, 4, store.PASSES]
    assert store.BUCKETS % store.PASSES == 0


def test_fill_in_passes(spark, tmp_path):
    rows = spark.range(300).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 9).alias("n"))
    for by in ((), ("n",)):
        table = Keyed(spark, str(tmp_path / f"t{len(by)}"), ("id",), rows.schema)
        table.fill(rows, 4, by)
        assert shown(table.rows().collect()) == shown(rows.collect())


def test_replace_in_passes(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("old").alias("t"))
    new = spark.createDataFrame([(5, "a"), (5, "b"), (77, "c"), (1000, "d")], "id int, t string")
    for n in (1, 4):
        table = Keyed(spark, str(tmp_path / f"t{n}"), ("id",), rows.schema)
        table.fill(rows, n)
        before = files(table.path)
        for _ in range(2):
            table.replace(new, n)
            assert shown(tuple(r) for r in table.rows().collect()) == shown([*[(i, "old") for i in range(300) if i not in (5, 77)], (5, "a"), (5, "b"), (77, "c"), (1000, "d")])
        assert len(set(before.items()) & set(files(table.path).items())) >= len(before) - 3
