"""Content digests whose equality ignores case, outer spaces and the order of items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that count as such; a decimal counts as a text. What a missing value counts as.
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
MISSING = "None"


def content_string(date: Column, merchant: Column, total: Column, lines: Column) -> Column:
    """date|merchant|total|description~price~quantity;... ``lines``: a sorted array of
    struct<d, p, q>. Missing parts count as empty."""
    text = F.array_join(F.transform(lines, lambda x: F.concat_ws("~", x["d"], x["p"].cast("string"), x["q"].cast("string"))), ";")
    empty = F.lit("")
    return F.concat_ws("|", F.coalesce(date.cast("string"), empty), F.lower(F.trim(F.coalesce(merchant, empty))), F.coalesce(total.cast("string"), empty), F.coalesce(text, empty))


def quoted(text: Column) -> Column:
    inner = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _joined(parts: Column, ends: str) -> Column:
    return F.concat(F.lit(ends[0]), F.array_join(parts, ","), F.lit(ends[1]))


def _plain(c: Column, kind: T.DataType) -> Column:
    """A value as text, as it counts in a list: numbers and booleans too; a list in a list keeps its order."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "True").otherwise("False")
    elif isinstance(kind, T.ArrayType):
        inner = kind.elementType
        exact = isinstance(inner, (T.ArrayType, *NUMBERS))
        text = _joined(F.transform(c, lambda x: _plain(x, inner) if exact else quoted(_plain(x, inner))), "[]")
    elif isinstance(kind, (T.StructType, T.MapType)):
        text = canonical(c, kind)
    else:
        text = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit(MISSING))


def canonical(c: Column, kind: T.DataType) -> Column:
    """The canonical text of ``c``, of type ``kind``, however deep.

    Records and maps with text keys are written by the order of their keys. Of a list of records the order counts; a list
    of anything else is written as texts, sorted. A number or boolean outside a list is itself; everything else counts as
    a text, a missing value as the text None."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        whole = _joined(F.array(*[F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical(c[f.name], f.dataType)) for f in fields]), "{}") if fields else F.lit("{}")
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.cast("string").alias("k"), F.element_at(c, k).alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        whole = _joined(F.transform(entries, lambda e: F.concat(quoted(e["k"]), F.lit(":"), canonical(e["v"], kind.valueType))), "{}")
    elif isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StructType, T.MapType)):
            whole = _joined(F.transform(c, lambda x: canonical(x, inner)), "[]")
        else:
            whole = _joined(F.array_sort(F.transform(c, lambda x: quoted(_plain(x, inner)))), "[]")
    elif isinstance(kind, (T.BooleanType, *NUMBERS)):
        whole = c.cast("string")
    else:
        whole = quoted(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), whole), F.lit(f'"{MISSING}"'))


def generic_digest(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of a value's canonical text; what is no record or map counts as one with a single text."""
    if not isinstance(kind, (T.StructType, T.MapType)):
        return F.sha2(F.concat(F.lit('{"value":'), quoted(_plain(c, kind)), F.lit("}")), 256)
    return F.sha2(canonical(c, kind), 256)
