"""Canonical texts by their classes of equal records, structural differences against a plain walk."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docledger.functions.hashing import canonical, generic_digest
from docledger.operators.differences import against, diff

#: Each line: values that count as equal, as Spark SQL; no two lines do.
CLASSES = (
    ("struct(1 as a, 'x' as b)", "struct('x' as b, 1 as a)", "struct(1L as a, 'x' as b)"),
    ("struct('1' as a, 'x' as b)", "struct(cast(1 as decimal(3,0)) as a, 'x' as b)"),
    ("struct(cast(null as int) as a)", "struct('None' as a)", "struct(cast(null as array<int>) as a)", "struct(cast(null as struct<x:int>) as a)", "map('a', cast(null as int))"),
    ("struct(array(2, 1, 10) as a)", "struct(array('10', '1', '2') as a)", "struct(array('1', '10', '2') as a)", "map('a', array(1, 2, 10))"),
    ("struct(array(2, 1) as a)",),
    ("struct(array(true, null) as a)", "struct(array('None', 'True') as a)"),
    ("struct(true as a)",), ("struct('True' as a)",), ("struct('true' as a)",),
    ("struct(array(struct(1 as x), struct(2 as x)) as a)", "struct(array(map('x', 1), map('x', 2)) as a)"),
    ("struct(array(struct(2 as x), struct(1 as x)) as a)",),
    ("struct(array(array(1, 2), array(0)) as a)", "struct(array(array(0), array(1, 2)) as a)", "struct(array('[0]', '[1,2]') as a)"),
    ("struct(array(array(2, 1), array(0)) as a)",), ("struct(array(array('1', '2'), array('0')) as a)",),
    ("struct(struct(1 as y, array('b', 'a') as x) as a)",),
    ("struct('a\"' as a)",), ("struct('a\\\\\"' as a)",), ("struct(1.5D as a)",), ("struct('1.5' as a)", "struct(1.5 as a)"),
    ("struct(date'2024-01-02' as a)", "struct('2024-01-02' as a)"),
    ("5", "'5'", "struct('5' as value)", "5L"), ("struct(5 as value)",),
    ("map('b', 1, 'a', 2)", "map('a', 2, 'b', 1)", "struct(2 as a, 1 as b)"),
)


def test_classes_of_equal_records(spark):
    found = {}
    for n, values in enumerate(CLASSES):
        digests = set()
        for value in values:
            df = spark.range(1).selectExpr(f"{value} as v")
            digests.add(df.select(generic_digest(F.col("v"), df.schema["v"].dataType).alias("d")).first()["d"])
        assert len(digests) == 1, values
        assert found.setdefault(digests.pop(), n) == n, values


def test_canonical_text(spark):
    df = spark.range(1).selectExpr("struct('x' as b, struct(array('b', 'a') as z, map('k', 1.5D, 'c', null) as y) as a) as v")
    assert df.select(canonical(F.col("v"), df.schema["v"].dataType).alias("t")).first()["t"] == '{"a":{"y":{"c":"None","k":1.5},"z":["a","b"]},"b":"x"}'


# ---- differences
SCHEMA = "id int, name string, n int, inner struct<x: double, skip: int, tags: array<string>>, lines array<struct<d: string, q: array<int>>>, {} {}"


def plain(a, e, path="", name=""):
    """What differs between two values, by a plain walk; ``skip`` is passed over, ``tags`` in any order."""
    kind = lambda v: "null" if v is None else "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
    if kind(a) != kind(e):
        return [(path, "type", kind(a), kind(e))]
    if isinstance(a, dict):
        out = []
        for k in [*a, *(k for k in e if k not in a)]:
            at = f"{path}.{k}" if path else k
            if k == "skip":
                continue
            out += [(at, "unexpected", str(a[k]), None)] if k not in e else [(at, "missing", None, str(e[k]))] if k not in a else plain(a[k], e[k], at, k)
        return out
    if isinstance(a, list):
        if len(a) != len(e):
            return [(path, "length", str(len(a)), str(len(e)))]
        if name == "tags":
            a, e = (sorted(v, key=lambda x: f'"{x}"') for v in (a, e))
        return [d for i, (x, y) in enumerate(zip(a, e, strict=True)) for d in plain(x, y, f"{path}[{i}]")]
    return [] if a == e else [(path, "value", str(a), str(e))]


def record(rng, last):
    some = lambda v: None if rng.random() < 0.15 else v
    tags = some([some(rng.choice("ab")) for _ in range(rng.randint(0, 3))])
    lines = some([some({"d": some(rng.choice("xy")), "q": some([rng.randint(0, 1) for _ in range(rng.randint(0, 2))])}) for _ in range(rng.randint(0, 2))])
    return {"name": some(rng.choice("pq")), "n": some(rng.randint(0, 1)), "inner": some({"x": some(rng.choice([0.5, 1.5])), "skip": rng.randint(0, 9), "tags": tags}), "lines": lines, last: 4}


def test_differences_against_a_plain_walk(spark):
    rng = random.Random(8)
    a = {i: record(rng, "ours") for i in range(400) if i % 10}
    e = {i: record(rng, "theirs") for i in range(400) if i % 7}
    frame = lambda side, last: spark.createDataFrame([Row(id=i, **r) for i, r in side.items()], SCHEMA.format(last, "int"))
    expected = []
    for i in range(400):
        if i in a or i in e:
            expected += [(i, "", "missing", None, None)] if i not in a else [(i, "", "unexpected", None, None)] if i not in e else [(i, *d) for d in plain(a[i], e[i])]
    found = diff(frame(a, "ours"), frame(e, "theirs"), "id", ignored=("skip",), unordered=("tags",)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_a_snapshot_is_written_where_there_is_none(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    first, second = (spark.createDataFrame([(1, x)], "id int, x array<int>") for x in ([1, 2], [2, 1]))
    assert against(first, path, "id").collect() == []
    assert against(second, path, "id", unordered=("x",)).collect() == []
    assert sorted(map(tuple, against(second, path, "id").collect())) == [(1, "x[0]", "value", "2", "1"), (1, "x[1]", "value", "1", "2")]
    assert [tuple(r) for r in against(first.limit(0), path, "id").collect()] == [(1, "", "missing", None, None)]


@pytest.mark.parametrize(("ours", "theirs", "found"), [("x int", "x string", [("x", "type", "int", "text")]), ("x map<string,int>", "x map<string,int>", []), ("x struct<>", "x struct<>", [])])
def test_types(spark, ours, theirs, found):
    values = {"x int": 1, "x string": "1", "x map<string,int>": {"b": 1, "a": 2}, "x struct<>": Row()}
    a, e = (spark.createDataFrame([(1, values[k])], f"id int, {k}") for k in (ours, theirs))
    assert [tuple(r)[1:] for r in diff(a, e, "id").collect()] == found
