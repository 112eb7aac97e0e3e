"""Structural differences between nested records, by a walk over both schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import canonical
from ..sources.files import exists
from ..sources.store import append

FOUND = "array<struct<field:string,kind:string,actual:string,expected:string>>"


@dataclass(frozen=True)
class Rules:
    """Names of fields that are passed over, and of lists whose order does not count."""

    ignored: frozenset[str] = frozenset()
    unordered: frozenset[str] = frozenset()


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "int"
    return "float" if isinstance(kind, T.NumericType) else "text"


def _one(field: Column, kind: str, actual: Column, expected: Column) -> Column:
    return F.array(F.struct(field.alias("field"), F.lit(kind).alias("kind"), actual.cast("string").alias("actual"), expected.cast("string").alias("expected"))).cast(FOUND)


def _none() -> Column:
    return F.array().cast(FOUND)


def _type_name(c: Column, kind: T.DataType) -> Column:
    return F.when(c.isNull(), "null").otherwise(kind_of(kind))


def differences(a: Column, e: Column, a_kind: T.DataType, e_kind: T.DataType, rules: Rules, field: Column, name: str = "") -> Column:
    """array<struct<field, kind, actual, expected>>: how ``a`` differs from ``e``, in the order of the schema.

    kind: ``type`` if one is null or they are of different types (then their names are given), ``length`` of
    lists, ``missing`` and ``unexpected`` fields of records, ``value``. Lists are aligned by place, those named
    in ``rules.unordered`` after both were sorted by their canonical text. Maps are compared as wholes."""
    if kind_of(a_kind) != kind_of(e_kind):
        return F.when(a.isNull() & e.isNull(), _none()).otherwise(_one(field, "type", _type_name(a, a_kind), _type_name(e, e_kind)))
    if isinstance(a_kind, T.StructType) and isinstance(e_kind, T.StructType):
        inner = _record(a, e, a_kind, e_kind, rules, field)
    elif isinstance(a_kind, T.ArrayType):
        inner = _list(a, e, a_kind, e_kind, rules, field, name)
    else:
        x, y = (canonical(c, k) if isinstance(k, (T.StructType, T.MapType)) else c.cast("string") for c, k in ((a, a_kind), (e, e_kind)))
        inner = F.when(x == y, _none()).otherwise(_one(field, "value", x, y))
    apart = _one(field, "type", _type_name(a, a_kind), _type_name(e, e_kind))
    return F.when(a.isNull() & e.isNull(), _none()).when(a.isNull() | e.isNull(), apart).otherwise(inner)


def _record(a: Column, e: Column, a_kind: T.StructType, e_kind: T.StructType, rules: Rules, field: Column) -> Column:
    ours, theirs, parts = {f.name: f.dataType for f in a_kind}, {f.name: f.dataType for f in e_kind}, []
    for n in [*ours, *(n for n in theirs if n not in ours)]:
        at = F.when(field == "", F.lit(n)).otherwise(F.concat(field, F.lit(f".{n}")))
        nothing = F.lit(None).cast("string")
        if n in rules.ignored:
            continue
        if n not in theirs:
            parts.append(_one(at, "unexpected", _shown(a[n], ours[n]), nothing))
        elif n not in ours:
            parts.append(_one(at, "missing", nothing, _shown(e[n], theirs[n])))
        else:
            parts.append(differences(a[n], e[n], ours[n], theirs[n], rules, at, n))
    return F.concat(*parts) if parts else _none()


def _list(a: Column, e: Column, a_kind: T.ArrayType, e_kind: T.ArrayType, rules: Rules, field: Column, name: str) -> Column:
    if name in rules.unordered:
        a, e = (_by_text(c, k.elementType) for c, k in ((a, a_kind), (e, e_kind)))
    each = F.transform(a, lambda x, i: differences(x, F.get(e, i), a_kind.elementType, e_kind.elementType, rules, F.concat(field, F.lit("["), i.cast("string"), F.lit("]"))))
    return F.when(F.size(a) != F.size(e), _one(field, "length", F.size(a), F.size(e))).otherwise(F.flatten(each))


def _by_text(c: Column, kind: T.DataType) -> Column:
    """A list in the order of its entries' canonical texts."""
    keyed = F.transform(c, lambda x: F.struct(canonical(x, kind).alias("k"), x.alias("x")))
    ordered = F.array_sort(keyed, lambda p, q: F.when(p["k"] < q["k"], -1).when(p["k"] > q["k"], 1).otherwise(0))
    return F.transform(ordered, lambda p: p["x"])


def _shown(c: Column, kind: T.DataType) -> Column:
    return canonical(c, kind) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else c.cast("string")


def diff(actual: DataFrame, expected: DataFrame, key: str, ignored: tuple[str, ...] = (), unordered: tuple[str, ...] = ()) -> DataFrame:
    """``key``, field, kind, actual, expected: one row for each difference between the records of equal ``key``, and
    one with an empty field for a record that only one side has (``missing``, ``unexpected``). ``key`` tells the
    records of a side apart."""
    rules = Rules(frozenset(ignored), frozenset(unordered))
    packed = lambda df, name: df.select(F.col(key).alias(f"_{name}"), F.struct(*[c for c in df.columns if c != key]).alias(name))
    a, e = packed(actual, "a"), packed(expected, "e")
    whole = lambda kind: _one(F.lit(""), kind, F.lit(None), F.lit(None))
    inner = differences(F.col("a"), F.col("e"), a.schema["a"].dataType, e.schema["e"].dataType, rules, F.lit(""))
    found = F.when(F.col("_a").isNull(), whole("missing")).when(F.col("_e").isNull(), whole("unexpected")).otherwise(inner)
    both = a.join(e, F.col("_a") == F.col("_e"), "full_outer").select(F.coalesce("_a", "_e").alias(key), F.explode(found).alias("_d"))
    return both.select(key, "_d.*")


def against(actual: DataFrame, path: str, key: str, ignored: tuple[str, ...] = (), unordered: tuple[str, ...] = ()) -> DataFrame:
    """``diff`` of ``actual`` and the snapshot at ``path``. Where there is none, ``actual`` is written as
    the snapshot, and nothing differs."""
    spark = actual.sparkSession
    expected = spark.read.parquet(path) if exists(spark, path) else append(actual, path)
    return diff(actual, expected, key, ignored, unordered)
