"""Scans over the rows of each key in their order, without one task for a key that has very many.

A window by key sorts all rows of a key in one task. Here the keys that hold more than a fair share of a table (a
short list, by a count that sums up map-side) are cut into segments by quantiles of their first order
column. Every segment is scanned by itself, in the same window that serves all other keys; what a segment hands on to the
next is an aggregate, summed up map-side, of which there are at most SEGMENTS for a key, and joins back as a small table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

#: Rows that a key may always have in one task; segments of a key that has more.
LEAST, SEGMENTS = 200_000, 64


@dataclass(frozen=True)
class Scan:
    """A value for each row from the rows of its key up to it, or after it."""

    #: The value within a segment.
    local: Callable[[WindowSpec], Column]
    #: What a segment hands on.
    whole: Column
    #: What reaches a segment, from the others' ``whole`` in the order of segments.
    carried: Callable[[Column, WindowSpec], Column]
    #: The value from both; the flags say whether the row is its segment's first, its last.
    joined: Callable[[Column, Column, Column, Column], Column]


def _earlier(over: WindowSpec) -> WindowSpec:
    return over.rowsBetween(Window.unboundedPreceding, -1)


def numbered() -> Scan:
    """1, 2, 3, ..."""
    carried = lambda whole, over: F.coalesce(F.sum(whole).over(_earlier(over)), F.lit(0)).cast("int")
    return Scan(lambda over: F.row_number().over(over), F.count(F.lit(1)), carried, lambda here, before, first, last: here + before)


def running_sum(c: Column) -> Scan:
    """The sum of ``c`` up to and with the row."""
    to_here = lambda over: over.rowsBetween(Window.unboundedPreceding, 0)
    plus = lambda here, before, first, last: F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0)))
    return Scan(lambda over: F.sum(c).over(to_here(over)), F.sum(c), lambda whole, over: F.sum(whole).over(_earlier(over)), plus)


def previous(c: Column, order: list[str]) -> Scan:
    """``c`` of the row before; null for the first."""
    return Scan(lambda over: F.lag(c).over(over), F.max_by(F.struct(c.alias("c")), F.struct(*order)), lambda whole, over: F.lag(whole).over(over)["c"], lambda here, before, first, last: F.when(first, before).otherwise(here))


def following(c: Column, order: list[str]) -> Scan:
    """``c`` of the row after; null for the last."""
    return Scan(lambda over: F.lead(c).over(over), F.min_by(F.struct(c.alias("c")), F.struct(*order)), lambda whole, over: F.lead(whole).over(over)["c"], lambda here, after, first, last: F.when(last, after).otherwise(here))


def _position(df: DataFrame, column: str) -> Column | None:
    """A number that orders as ``column``; None if it is neither a number nor a time."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double") if isinstance(kind, T.NumericType) else None


def cuts(df: DataFrame, key: str, order: list[str], least: int | None = None) -> list[tuple]:
    """(key, quantiles of the first order column) for each key with more than ``least`` rows and than a quarter
    of a mean task: at most four keys for each task. A table with no more than ``least`` rows costs one count of rows."""
    least = LEAST if least is None else least
    place, total = _position(df, order[0]), df.count()
    most = max(least, total // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if place is None or total <= most:
        return []
    hot = [r[0] for r in df.groupBy(key).count().where(F.col("count") > most).select(key).collect()]
    if not hot:
        return []
    some = df.where(F.col(key).isin([k for k in hot if k is not None]) | F.col(key).isNull() if None in hot else F.col(key).isin(hot))
    at = F.percentile_approx(place, F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)]), F.lit(10_000))
    return [(r[0], sorted(set(r[1] or []))) for r in some.groupBy(key).agg(at).collect()]


def scan(df: DataFrame, key: str, order: list[str], scans: dict[str, Scan], least: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``scans`` over the rows of equal ``key`` by ``order``, which must tell
    the rows of a key apart. Rows of a null key are a key of their own. A null in the first order column comes first.
    Rows of one key that are equal in the first order column share a segment."""
    hot = cuts(df, key, order, least)
    if not hot:
        over = Window.partitionBy(key).orderBy(*order)
        return df.withColumns({name: s.local(over) for name, s in scans.items()})
    kind = df.schema[key].dataType
    known = df.sparkSession.createDataFrame(hot, T.StructType([T.StructField("_key", kind), T.StructField("_cuts", T.ArrayType(T.DoubleType()))]))
    place = _position(df, order[0])
    number = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: F.coalesce(c < place, F.lit(False)))) + 1).otherwise(0)
    parted = df.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("_segment", number).drop("_key", "_cuts")
    over = Window.partitionBy(key, "_segment").orderBy(*order)
    here = parted.withColumns({f"_here_{name}": s.local(over) for name, s in scans.items()} | {"_first": F.row_number().over(over) == 1, "_last": F.lead(F.lit(True)).over(over).isNull()})
    wholes = parted.where("_segment > 0").groupBy(F.col(key).alias("_key"), F.col("_segment").alias("_part")).agg(*[s.whole.alias(name) for name, s in scans.items()])
    by_segment = Window.partitionBy("_key").orderBy("_part")
    carries = wholes.select("_key", "_part", *[s.carried(F.col(name), by_segment).alias(f"_carry_{name}") for name, s in scans.items()])
    # at most SEGMENTS rows for each of at most four keys for each task
    both = here.join(F.broadcast(carries), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_segment") == F.col("_part")), "left")
    value = lambda name, s: F.when(F.col("_segment") == 0, F.col(f"_here_{name}")).otherwise(s.joined(F.col(f"_here_{name}"), F.col(f"_carry_{name}"), F.col("_first"), F.col("_last")))
    return both.select(*df.columns, *[value(name, s).alias(name) for name, s in scans.items()])
