"""Golden rows for scores, extraction, validation, severity, costs and line reconstruction."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docledger.functions import fields, quality, text, validate
from docledger.operators import attempts, layout, prompts, stage, trace, usage
from docledger.sources import files


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


@pytest.fixture(autouse=True)
def column(spark):
    globals()["T"] = F.col("t")  # columns need a running session


SLIP = "GROCERY\nAPPLES 3.99\nBREAD 2.50\nMILK 4.49\nEGGS 3.00\nJAM 2.00\nTEA 1.00\nSUBTOTAL 16.00\nTAX 0.98\nTOTAL 16.98"


@pytest.mark.parametrize(
    ("t", "low", "high"),
    [(SLIP, 0.6, 1.0), ("", 0.0, 0.0), ("%% ~~ 77 {{ 0 0 }} ;; ^^ 31", 0.0, 0.3), ("TOTAL $5.99", 0.2, 0.7), ("CORNER SHOP\nPLUMS $4.99\nTOTAL $4.99", 0.4, 0.9)],
)
def test_quality(spark, t, low, high):
    assert low <= value(spark, quality.score(T), t=t) <= high


def test_quality_never_reaches_one(spark):
    assert value(spark, quality.falls_back(T, 1.0), t=SLIP)
    assert not value(spark, quality.falls_back(T, 0.0), t=SLIP)
    assert value(spark, quality.falls_back(T, 0.5), t="~~ ^^ 77")


@pytest.mark.parametrize(
    ("t", "total"),
    [("Corner shop\nPlums $5.00\nTotal: $15.99", 15.99), ("", None), ("SUBTOTAL 15.72\nTOTAL 16.98", 15.72), ("TOTAL 37,83", 3783.0), ("1,234.56 TOTAL", 1234.56), ("12,50 TOTAL", 12.5), ("BALANCE: 7,10", 7.1)],
)
def test_total(spark, t, total):
    assert value(spark, fields.total_amount(T), t=t) == total


@pytest.mark.parametrize(
    ("t", "item"),
    [("Apples 2 3.99", ("Apples 2", 3.99, 1.0, 3.99)), ("Milk $4.50", ("Milk", 4.5, 1.0, 4.5)), ("Milk 6 . 49", ("Milk", 49.0, 6.0, 49 / 6)), ("Tea 2.50 S", ("Tea", 2.5, 1.0, 2.5)), ("no price", None)],
)
def test_item(spark, t, item):
    found = value(spark, fields.item(T), t=t)
    assert (found and tuple(found)) == item


@pytest.mark.parametrize(("t", "d"), [("2024-03-15", "2024-03-15"), ("2/3/2024", "2024-02-03"), ("25/12/2024", "2024-12-25"), ("soon", None), ("2024-03-15T10:00:00Z", "2024-03-15")])
def test_date(spark, t, d):
    assert value(spark, fields.date(T).cast("string"), t=t) == d


def test_date_string_loses_the_century(spark):
    assert value(spark, fields.date_string(T), t="on 2024-03-15") == "24-03-15"
    assert value(spark, fields.date_string(T, strict=True), t="on 2024-03-15") == "2024-03-15"


@pytest.mark.parametrize(
    ("t", "severity"),
    [
        ("Total 7.50 does not match sum of items 7.00", "small"), ("Total 12.00 does not match sum of items 8.00", "medium"), ("Total 30.00 does not match sum of items 8.00", "large"),
        ("Total 8.00 does not match sum of items 7.01", "small"), ("Total 8.00 does not match sum of items 7.00", "medium"), ("Total 13.00 does not match sum of items 8.00", "medium"),
        ("Total 13.01 does not match sum of items 8.00", "large"), ("Total 1,234.56 does not match sum of items 8.00", "unknown"), ("Missing date", "medium"), ("Invalid price", "small"), ("Could not parse", "unknown"),
    ],
)
def test_severity(spark, t, severity):
    assert value(spark, validate.severity(T), t=t) == severity


@pytest.mark.parametrize(
    ("t", "errors"),
    [
        ('{"items":[{"description":"Milk","price":4.5},{"description":"Bread","price":3}],"total":7.5}', []),
        ('{"items":[{"description":"Milk","price":4.5},{"description":"Bread","price":3}],"total":10}', ["Total 10.00 does not match sum of items 7.50"]),
        ('{"items":[],"total":0}', []), ('{"items":[{"description":"Milk","price":4.5}]}', []), ('{"items":[{"description":"Milk","price":-1.5}]}', ["Invalid price"]),
        ('{"items":[],"total":-10}', ["Total -10.00 does not match sum of items 0.00"]), ('{"date":"whenever"}', []), (' \n{"total":0} \n', []), ('{"items":[],"total":0.01}', []),
        ("", ["Failed to parse JSON"]), ("not valid json", ["Failed to parse JSON"]), ('{"incomplete": json', ["Failed to parse JSON"]), ('["not","a","dict"]', ["Failed to parse JSON"]),
    ],
)
def test_payload(spark, t, errors):
    assert value(spark, validate.problems(validate.typed(T)), t=t) == errors


FAULTS = {
    '{"items":[],"total":"abc"}': ["total:decimal_parsing"], '{"items":[{"price":1}],"total":1}': ["items[0].description:missing"], '{"items":[{"description":5,"price":1}],"total":1}': ["items[0].description:string_type"],
    '{"items":5}': ["items:list_type"], '{"items":null,"total":true,"date":3}': ["date:string_type", "items:list_type", "total:decimal_type"], '{"items":{"description":"a","price":1}}': ["items:list_type"],
    '{"items":[{"description":"a","price":" 1_0.5 "},7,null,{"description":null,"price":null},{"description":"x","price":"NaN"},[]],"total":[1]}':
        ["items[1]:model_type", "items[2]:model_type", "items[3].description:string_type", "items[3].price:decimal_type", "items[4].price:finite_number", "items[5]:model_type", "total:decimal_type"],
    '{"items":[{"description":"a","price":-1},{"price":"-0.5"}],"total":null}': ["items[0].price:value_error", "items[1].description:missing", "items[1].price:value_error"],
    '{"total":"1e2","items":[{"description":"","price":100.00000001}],"date":null,"more":{}}': [], "{}": [], '{"total":1e40}': ["total:decimal_parsing"], "[1]": None, "x": None, "": None,
}


def test_faults_by_path(spark):
    df = spark.createDataFrame([(t,) for t in FAULTS], "t string").withColumn("p", validate.typed(T))
    rows = df.select("t", validate.fault_list(F.col("p")).alias("f"), validate.problems(F.col("p")).alias("m"), "p").collect()
    assert {r["t"]: r["f"] for r in rows} == FAULTS
    said = {r["t"]: r["m"] for r in rows}
    assert said['{"items":[{"description":"a","price":-1},{"price":"-0.5"}],"total":null}'] == ["Invalid price", "items[1].description: missing"]
    assert said['{"items":[{"price":1}],"total":1}'] == ["items[0].description: missing"] and said["[1]"] == ["Failed to parse JSON"]
    kept = {r["t"]: r["p"] for r in rows}['{"items":[{"price":1}],"total":1}']
    assert kept["total"] == 1 and kept["items"][0]["price"] == 1 and kept["items"][0]["description"] is None


def test_word_correction(spark):
    assert value(spark, text.corrected(T), t="a  ($1O.50S),\n 3,99 1,234,56 SIO") == "a ($1O.50S), 3.99 1.234.56 SIO"
    assert value(spark, text.corrected(T), t="$12.50SO") == "$12.5050"


FRAGMENT = "doc_id long, x double, y double, y_bottom double, text string, n int"


def test_lines(spark):
    rows = [(60.0, 101.0, 117.0, "9.99"), (10.0, 130.0, 146.0, "end"), (5.0, 100.0, 116.0, "Milk")]
    frags = spark.createDataFrame([(1, *r, k) for k, r in enumerate(rows)] + [(2, 1.0, 1.0, 2.0, "", 0), (2, 1.0, 1.0, 2.0, None, 1), (None, None, None, None, "b", 0), (None, -1.0, 9.0, None, "a", 0), (None, 0.0, 30.0, None, "c", 0)], FRAGMENT)
    assert {r["doc_id"]: r["text"] for r in layout.reconstructed(frags, ["n"]).collect()} == {1: "Milk 9.99\nend", 2: "", None: "a b\nc"}
    assert layout.reconstructed(frags.limit(0), ["n"]).collect() == []


def folded(fragments):
    """The lines of a page by a plain fold; fragments: x, y, height, text."""
    fragments = [f for f in fragments if f[3]]
    near = sum(f[2] for f in fragments) / max(1, len(fragments)) / 2
    lines = []
    for f in sorted(fragments, key=lambda f: f[1]):
        if lines and abs(f[1] - sum(g[1] for g in lines[-1]) / len(lines[-1])) <= near:
            lines[-1].append(f)
        else:
            lines.append([f])
    return "\n".join(" ".join(f[3] for f in sorted(line, key=lambda f: f[0])) for line in lines)


def test_lines_against_a_plain_fold(spark):
    """Pages of many shapes, one of them with most fragments, over several batches."""
    rng = random.Random(6)
    pages = {d: [(float(rng.randint(0, 9)), float(rng.randint(0, 3 * d % 71 + 1)), float(rng.randint(1, 6)), rng.choice(["", *"abcdef"])) for _ in range(4000 if d == 3 else rng.randint(1, 60))] for d in range(120)}
    rows = [(d, x, y, y + rng.choice([-1, 1]) * h, t, k) for d, page in pages.items() for k, (x, y, h, t) in enumerate(page)]
    found = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        found = {r["doc_id"]: r["text"] for r in layout.reconstructed(spark.createDataFrame(rows, FRAGMENT), ["n"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {d: folded(page) for d, page in pages.items()}


@pytest.mark.parametrize(("model", "cost"), [("gpt-4o-mini", 0.45), ("gpt-4o", 7.5), ("gpt-3.5-turbo", 0.45), ("nothing", 0.45)])
def test_cost(spark, model, cost):
    pricing = spark.createDataFrame([("GPT_4O_MINI", 0.15, 0.60), ("GPT_4O", 2.50, 10.00), ("GPT_3_5_TURBO", 0.50, 1.50)], "key string, rate_in double, rate_out double")
    u = spark.createDataFrame([(model, 1000, 500)], "model string, input_tokens int, output_tokens int")
    assert usage.priced(u, pricing).first()["cost"] == pytest.approx(cost)


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "input_tokens int, output_tokens int")
    assert tuple(empty.agg(*usage.totals()).first()) == (0, 0, 0)


@pytest.mark.parametrize(
    ("s", "q", "second", "rungs"),
    [("small", 0.5, 1.0, [attempts.SELF]), ("small", 0.1, 1.0, [attempts.SELF, attempts.SECOND]), ("medium", 0.5, 1.0, [attempts.SELF, attempts.FOCUSED]), ("large", 0.5, 1.0, [attempts.FOCUSED, attempts.SECOND]), ("large", 0.5, 0.0, [attempts.FOCUSED]), ("unknown", 0.5, 1.0, []), ("unknown", 0.1, 1.0, [attempts.SECOND])],
)
def test_ladder(spark, s, q, second, rungs):
    assert value(spark, attempts.ladder(F.col("s"), F.col("q"), F.col("second") > 0), s=s, q=q, second=second) == rungs


def test_best_attempt(spark):
    rows = [(1, 1, False, True, "e1"), (1, 2, True, True, None), (1, 3, True, True, None), (2, 1, False, True, "e1"), (2, 2, False, True, "e2"), (2, 3, False, False, "e3"), (3, 1, False, False, "e1"), (3, 2, False, False, "e2")]
    df = spark.createDataFrame(rows, "item_id long, attempt int, success boolean, parsed boolean, error string")
    found = {r["item_id"]: (r["attempt"], r["success"], r["error"]) for r in attempts.best(df).collect()}
    assert found == {1: (2, True, None), 2: (2, False, None), 3: (None, False, "e2")}


def test_best_attempt_after_a_million(spark):
    rows = [(1, 1_500_000, True, True, None), (1, 1_600_000, False, True, "e"), (1, 1_700_000, True, True, None)]
    df = spark.createDataFrame(rows, "item_id long, attempt int, success boolean, parsed boolean, error string")
    assert [tuple(r) for r in attempts.best(df).select("item_id", "attempt", "success", "error").collect()] == [(1, 1_500_000, True, None)]


def test_invariants(spark):
    rows = [(1, 1, "OCR", True, False), (1, 2, "PERSIST", True, True), (1, 3, "PARSE", False, False), (2, 1, "VALIDATE", True, False), (2, 2, "PERSIST", True, True)]
    t = spark.createDataFrame(rows, "run_id long, seq int, stage string, success boolean, terminal boolean")
    assert [(r["run_id"], r["seq"]) for r in trace.after_terminal(t).collect()] == [(1, 3)]
    assert [(r["run_id"], r["seq"]) for r in trace.persist_without_validate(t).collect()] == [(1, 2)]


def test_stage_keeps_failures_as_rows(spark):
    def broken():
        def f(text):
            raise ValueError("no")

        return f

    texts = spark.createDataFrame([(1, "TOTAL 5.00"), (2, None)], "doc_id long, text string")
    assert {r["error"] for r in stage.run(texts, broken).collect()} == {"no"}
    assert {r["doc_id"]: r["error"] for r in stage.by_rules(texts).collect()} == {1: None, 2: None}


def test_write_invariant(spark):
    runs = spark.createDataFrame([(1, 5, 5, 0), (2, 5, 6, 0), (3, 5, 3, 1), (4, 20, 18, 2)], "run_id long, attempts long, writes long, duplicates long")
    assert sorted(r["run_id"] for r in trace.broken_writes(runs).collect()) == [2, 3]


def test_scan_of_missing_paths(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert files.scan(spark, str(tmp_path / "none")).count() == 0
    found = files.scan(spark, [str(tmp_path), str(tmp_path / "none")])
    assert [(r["name"], r["extension"], r["length"]) for r in found.collect()] == [("a.PNG", "png", 1)]
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    assert [r["digest"] for r in files.digests(found).collect()] == [digest]


def test_digests_of_given_paths(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x" * 100_000)
    there, lost = str(tmp_path / "a.png"), str(tmp_path / "b.png")
    expected = {"a.png": hashlib.sha256(b"x" * 100_000).hexdigest(), "b.png": hashlib.sha256(lost.encode()).hexdigest()}
    assert {r["name"]: r["digest"] for r in files.digests_of(spark, [there, lost]).collect()} == expected
    assert [r["name"] for r in files.digests_of(spark, [lost]).collect()] == ["b.png"] and files.digests_of(spark, []).collect() == []


def test_digests_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE", 1000)
    some = {"a b.png": b"x" * 999, "c%20d.png": b"y" * 1000, "e.png": bytes(range(256)) * 80_000}
    for name, data in some.items():
        (tmp_path / name).write_bytes(data)
    expected = {name: hashlib.sha256(data).hexdigest() for name, data in some.items()}
    assert {r["name"]: r["digest"] for r in files.digests(files.scan(spark, str(tmp_path))).collect()} == expected


def test_prompts(spark):
    rows = [(None, "TEA 2.50\nhello", None, None), (attempts.SELF, "t", "off by 1", "{}"), (attempts.FOCUSED, "TEA 2.50\nhello", "e", "o"), (attempts.SECOND, None, None, None)]
    df = spark.createDataFrame(rows, "rung string, slip string, error string, output string")
    found = [r["p"] for r in df.select(prompts.prompt(*map(F.col, df.columns)).alias("p")).collect()]
    assert found[0].endswith("Text:\nTEA 2.50\nhello") and "off by 1" in found[1] and "It was: {}" in found[1]
    assert found[2].index("TEA 2.50\n\nWhole text:\nTEA 2.50\nhello") > 0 and "before:\n\nAnswer" in found[3]


def test_operations(spark):
    pricing = spark.createDataFrame([("GPT_4O", 2.50, 10.00)], "key string, rate_in double, rate_out double")
    u = spark.createDataFrame([("gpt-4o", 1000, 500, "x", None)], "model string, input_tokens int, output_tokens int, a string, b string")
    r = usage.operations(u, pricing, F.lit("op"), F.lit("2024-01-01").cast("timestamp"), {"b": F.col("b"), "a": F.col("a")}).first()
    assert (r["op_name"], r["total_tokens"], r["cost"], r["metadata"]) == ("op", 1500, 7.5, {"a": "x"})


def test_ordered_events(spark):
    rows = [(1, 1, "VALIDATE", False, False), (1, 2, "PERSIST", True, False), (1, 3, "VALIDATE", True, False), (1, 4, "PERSIST", True, True), (1, 5, "OCR", True, False), (2, 1, "PERSIST", True, False)]
    t = spark.createDataFrame(rows, "run_id long, seq long, stage string, success boolean, terminal boolean")
    assert sorted((r["run_id"], r["seq"]) for r in trace.persist_without_validate(t).collect()) == [(1, 2), (2, 1)]
    assert [(r["run_id"], r["seq"]) for r in trace.after_terminal(t).collect()] == [(1, 5)]
