"""Plain data from typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def floats(c: Column, kind: T.DataType) -> Column:
    """``c``, of type ``kind``, with all decimals in it, however deep, as doubles."""
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[floats(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: floats(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: floats(x, kind.valueType))
    return c
