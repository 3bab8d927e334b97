"""Order of typed values as sort keys: Columns whose Spark order is the order of the type.

false before true; texts without regard to case; numbers by value; sequences element by element, an absent element before
any other, the shorter one first; maps by sorted keys, key before value; tuples position by position; other nested values by
their JSON text. Null comes first everywhere. A key is a plain expression, so sorting, ranking and extremes use it in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType


def sort_key(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        return F.lower(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sort_key(x, kind.elementType))
    if isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(sort_key(e["key"], kind.keyType).alias("k"), sort_key(e["value"], kind.valueType).alias("v")))
        return F.array_sort(pairs)
    if isinstance(kind, StructType):
        keys = [sort_key(c[f.name], f.dataType).alias(f"_{i}") for i, f in enumerate(kind, 1)]
        return F.when(c.isNotNull(), F.struct(*keys))
    if isinstance(kind, VariantType):
        return F.lower(F.to_json(c))
    return c


def compare(a: Column, b: Column, kind: DataType) -> Column:
    """-1, 0 or 1; null is smaller than anything else."""
    x, y = sort_key(a, kind), sort_key(b, kind)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)


def less(a: Column, b: Column, kind: DataType) -> Column:
    return compare(a, b, kind) == -1


def sort_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """What to order df by: each column's key, nulls first."""
    return [sort_key(F.col(f"`{c}`"), df.schema[c].dataType).asc_nulls_first() for c in columns]


def same(a: Column, b: Column, kind: DataType) -> Column:
    """Deep equality, case included, nulls equal; maps by their entries."""
    if isinstance(kind, MapType):
        entries = lambda m: F.array_sort(F.map_entries(m))
        return entries(a).eqNullSafe(entries(b))
    if isinstance(kind, StructType):
        inner = reduce(lambda x, y: x & y, [same(a[f.name], b[f.name], f.dataType) for f in kind])
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(inner)
    return a.eqNullSafe(b)
