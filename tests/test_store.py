"""Keyed tables, updates that leave other folders alone, streams into a ledger, answers that land once."""

import os

import pytest
from pyspark.sql import functions as F

from docledger.operators import stage, updates
from docledger.sources.store import Keyed
from docledger.streaming import ingest


def files(path):
    """Data files and when they were written."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def folder(table, keys):
    return {f"bucket={b}" for b in table._buckets(keys)}


def touched(before, after):
    return {p.split("/")[-2] for p, _ in set(before.items()) ^ set(after.items())}


def read(df, above):
    """The folders that rows of ``df`` are read from."""
    return {r[0].split("/")[-above] for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("n"), F.lit("a").alias("t"))
    out = Keyed(spark, str(tmp_path / "t"), ("id",), rows.schema)
    assert out.rows().collect() == [] == out.missing(rows.limit(0)).collect() and out.missing(rows).count() == 200
    out.append(rows)
    return out


def test_a_lookup_reads_its_buckets(spark, table):
    some = spark.createDataFrame([(5,), (77,), (1000,)], "id int")
    found = table.of(some)
    assert read(found, 2) == folder(table, spark.range(200).where("id in (5, 77)")) | (read(found, 2) & folder(table, some)) and len(files(table.path)) > 20
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in table.missing(some).collect()] == [1000]


def test_updates_leave_other_folders_alone(spark, table):
    before = files(table.path)
    change = spark.createDataFrame([(5, 9, None), (77, None, "b"), (1000, 1, "x")], "id long, n long, t string")
    updates.update(table, change, ["n", "t"], partial=True)
    after = files(table.path)
    assert touched(before, after) == folder(table, change.where("id < 1000")) | (folder(table, change) & touched(before, after))
    assert len(set(before.items()) & set(after.items())) >= len(before) - 3
    rows = {r["id"]: (r["n"], r["t"]) for r in table.rows().collect()}
    assert len(rows) == 200 and rows[5] == (9, "a") and rows[77] == (2, "b") and rows[6] == (0, "a")
    updates.update(table, change.where("id = 5"), ["n", "t"])
    assert [tuple(r) for r in table.rows().where("id = 5").collect()] == [(5, 9, None)]


def test_replace_and_delete(spark, table):
    new = spark.createDataFrame([(5, 0, "x"), (5, 1, "y"), (300, 2, "z")], "id long, n long, t string")
    before = files(table.path)
    table.replace(new)
    assert len(set(before.items()) & set(files(table.path).items())) >= len(before) - 2
    assert sorted(map(tuple, table.rows().where("id in (5, 300)").collect())) == [(5, 0, "x"), (5, 1, "y"), (300, 2, "z")] and table.rows().count() == 202
    table.delete(spark.range(400))
    assert table.rows().collect() == [] and files(table.path) == {}


def test_users(spark, tmp_path):
    keyed = lambda name, keys, rows, schema: Keyed(spark, str(tmp_path / name), keys, spark.createDataFrame([], schema).schema) if not rows else _filled(Keyed(spark, str(tmp_path / name), keys, spark.createDataFrame(rows, schema).schema), spark.createDataFrame(rows, schema))
    people = keyed("u", ("id",), [(1, "a", True), (2, "b", True)], "id long, email string, is_active boolean")
    purchases = keyed("p", ("user_id",), [(10, 1), (11, 1), (20, 2)], "id long, user_id long")
    items = keyed("i", ("receipt_id",), [(10, 1), (10, 2), (20, 1)], "receipt_id long, n int")
    for _ in range(2):
        updates.get_or_create(people, spark.createDataFrame([("b",), ("c",), ("c",)], "email string"))
    assert sorted(r["email"] for r in people.rows().collect()) == ["a", "b", "c"]
    updates.delete(people, purchases, items, spark.createDataFrame([(1,), (9,)], "id long"))
    assert sorted(r["email"] for r in people.rows().collect()) == ["b", "c"]
    assert [tuple(r) for r in purchases.rows().collect()] == [(20, 2)] and [tuple(r) for r in items.rows().collect()] == [(20, 1)]
    assert [r["id"] for r in updates.by_email(people, spark.createDataFrame([("b",)], "email string")).collect()] == [2] == [r["id"] for r in updates.by_id(people, spark.createDataFrame([(2,)], "id long")).collect()]


def _filled(table, rows):
    table.append(rows)
    return table


# ---- streams
def landing(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_over_several_runs(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "hash string, id long"
    landing(spark, source, [(f"h{i % 40}", i) for i in range(80)], schema)
    table, checkpoint = ingest.ledger(spark, str(tmp_path / "ledger"), ("hash",), spark.createDataFrame([], schema).schema), str(tmp_path / "check")
    run = lambda: ingest.ingest(ingest.read_stream(spark, source, 1), table, checkpoint, "id")
    run()
    assert sorted((r["hash"], r["id"]) for r in table.rows().collect()) == sorted((f"h{i}", i) for i in range(40))
    before = files(table.path)
    landing(spark, source, [("h7", 100), ("new", 101), ("new", 102)], schema)
    run(), run()
    assert table.rows().count() == 41 and [r["id"] for r in table.rows().where("hash = 'new'").collect()] == [101]
    assert before.items() <= files(table.path).items() and len(files(table.path)) == len(before) + 1
    second = spark.createDataFrame([("h7",), ("new",)], "hash string")
    assert read(table.of(second), 3) == folder(table, second)


def test_state_shrinks_behind_the_watermark(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "ts timestamp, key long, n int"
    at = lambda hour, rows: landing_at(spark, source, hour, rows)
    at(0, [(k, 0) for k in range(50)] + [(1, 1)])
    at(3, [(k, 2) for k in range(50, 60)])
    at(4, [(k, 3) for k in range(58, 70)])
    at(0, [(2, 4)])  # late and a repeat: behind the watermark
    at(5, [(3, 5), (200, 5)])  # a repeat that the state has forgotten: the ledger knows it
    rows = ingest.suppressed(ingest.read_stream(spark, source, 1), "ts", "1 hour", ["key"])
    table = ingest.ledger(spark, str(tmp_path / "ledger"), ("key",), spark.createDataFrame([], schema).schema)
    query = ingest.ingest(rows, table, str(tmp_path / "check"), "n")
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert max(s["numRowsTotal"] for s in states) >= 50 and states[-1]["numRowsTotal"] < 20
    assert sum(s["numRowsDroppedByWatermark"] for s in states) >= 1
    found = {r["key"]: r["n"] for r in table.rows().collect()}
    assert sorted(found) == [*range(70), 200] and found[3] == 0 and found[2] == 0 and found[58] == 2


def landing_at(spark, path, hour, rows):
    spark.createDataFrame(rows, "key long, n int").select(F.timestamp_seconds(F.lit((1000 + hour) * 3600)).alias("ts"), "key", "n").coalesce(1).write.mode("append").parquet(path)


# ---- answers
def test_texts_are_sent_once(spark, tmp_path):
    log = str(tmp_path / "sent")

    def counting():
        def f(text):
            with open(log, "a") as out:
                out.write(f"{text}\n")
            if text == "bad":
                raise ValueError("no")
            return '{"total":1}', 1, 2

        return f

    table = stage.results(spark, str(tmp_path / "answers"))
    texts = spark.createDataFrame([(1, "one"), (2, "bad"), (1, "one"), (None, "none")], "doc_id long, text string")
    more = texts.unionByName(spark.createDataFrame([(3, "three")], texts.schema))
    for given in (texts, texts, more, more):
        found = {r["doc_id"]: (r["payload"], r["error"]) for r in stage.landed(given, counting, table).collect()}
    assert found == {1: ('{"total":1}', None), 2: (None, "no"), 3: ('{"total":1}', None)}
    with open(log) as lines:
        assert sorted(x.strip() for x in lines) == ["bad", "one", "three"]


def test_patterns():
    extract = stage.patterns()
    assert extract("TEA 2.50\n MILK  $3.00 \n1,234.56 TOTAL")[0] == '{"total": 1234.56, "items": [{"description": "TEA", "price": 2.5}, {"description": "MILK", "price": 3.0}]}'
    assert extract("") == ('{"total": null, "items": []}', 0, 4)
