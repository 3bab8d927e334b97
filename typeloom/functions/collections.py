"""Array, map and codec functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- maps --


def keys(m: Column) -> Column:
    return F.sort_array(F.map_keys(m))


def values(m: Column) -> Column:
    """Values in the order of their keys."""
    return F.transform(F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: e["value"])


def entries(m: Column) -> Column:
    """Entries sorted by key: what maps are compared and grouped by."""
    return F.array_sort(F.map_entries(m), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def map_equal(a: Column, b: Column) -> Column:
    return entries(a).eqNullSafe(entries(b))


def merge(m: Column, new: Column) -> Column:
    """m with the entries of new, which win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def drop_keys(m: Column, gone: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(gone, k))


def inverse(m: Column) -> Column:
    """value -> key; a value that two keys have is an error when evaluated."""
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def set_members(m: Column) -> Column:
    """Keys that a set marks as true, sorted."""
    return F.sort_array(F.map_keys(F.map_filter(m, lambda _, v: F.coalesce(v, F.lit(False)))))


def ratio_total_ok(m: Column) -> Column:
    """Whether the values sum to 1 within 1e-4."""
    total = F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v)
    return F.abs(total - 1) <= 1e-4


# -- arrays --


def remove_first(a: Column, item: Column) -> Column:
    """a without the first occurrence of item."""
    at = F.array_position(a, item)
    return F.when(at > 0, F.filter(a, lambda _, i: i + 1 != at)).otherwise(a)


def remove_last(a: Column, item: Column) -> Column:
    return F.reverse(remove_first(F.reverse(a), item))


def replace_first(a: Column, old: Column, new: Column) -> Column:
    at = F.array_position(a, old)
    return F.transform(a, lambda x, i: F.when((at > 0) & (i + 1 == at), new).otherwise(x))


def replace_last(a: Column, old: Column, new: Column) -> Column:
    return F.reverse(replace_first(F.reverse(a), old, new))


def is_subset(whole: Column, part: Column, ordered: bool = False) -> Column:
    """Whether each item of part is in whole; ordered: in this order."""
    if not ordered:
        return F.size(F.array_except(part, whole)) == 0
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        found = F.array_position(F.slice(whole, acc["at"] + 1, F.greatest(F.size(whole) - acc["at"], F.lit(0))), x).cast("int")
        return F.struct((acc["at"] + F.when(found > 0, found).otherwise(0)).alias("at"), (acc["ok"] & (found > 0)).alias("ok"))

    return F.aggregate(part, start, step)["ok"]


def partition(a: Column, predicate) -> Column:
    """struct<yes, no>: the items for which predicate holds, and the rest."""
    return F.struct(F.filter(a, lambda x: F.coalesce(predicate(x), F.lit(False))).alias("yes"), F.filter(a, lambda x: ~F.coalesce(predicate(x), F.lit(False))).alias("no"))


def insert_nulls(a: Column, index: Column, count: int) -> Column:
    """count nulls put before the 1-based index; a negative count takes -count items away there."""
    head = F.slice(a, 1, index - 1)
    if count >= 0:
        return F.concat(head, F.array_repeat(F.lit(None), count), F.slice(a, index, F.size(a)))
    return F.concat(head, F.slice(a, index - count, F.size(a)))


def sparse_ok(a: Column, max_gap: int, max_ratio: float) -> Column:
    """Whether runs of nulls are at most max_gap long and nulls at most max_ratio of all items."""
    runs = F.aggregate(a, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), lambda s, x: F.struct(F.when(x.isNull(), s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["most"], F.when(x.isNull(), s["run"] + 1).otherwise(0)).alias("most")))["most"]
    nulls = F.size(F.filter(a, lambda x: x.isNull()))
    return (runs <= max_gap) & (nulls <= max_ratio * F.greatest(F.size(a), F.lit(1)))


# -- codecs --


def base64_encode(b: Column) -> Column:
    return F.regexp_replace(F.base64(b), "\r?\n", "")


def base64_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.lit(False))


def base64_decode(c: Column) -> Column:
    return F.when(base64_valid(c), F.unbase64(F.when(base64_valid(c), c)))


def hex_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^([0-9A-Fa-f]{2})*$"), F.lit(False))


def sql_literal(c: Column, kind: str) -> Column:
    """A value as SQL text: NULL, 1/0, digits, or quoted with quotes doubled; binary as X'HEX'."""
    if kind == "boolean":
        text = F.when(c, "1").otherwise("0")
    elif kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    elif kind == "string":
        text = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "NULL").otherwise(text)
