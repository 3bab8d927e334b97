"""Joins, aggregates, filters and lookups over tables whose first column is the key and whose rows have an order.

Row order is a column (by default `_line`), never the order of files. Rules that differ from SQL's: a join keeps the
last of several secondary rows with one key and drops null and empty keys; sums of nothing are 0, `all` of nothing is
true, `any` of nothing false; uniqueness and grouping pass nulls over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.predicates import truthy

from .stable import cut


def order_of(df: DataFrame, order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


# -- joins --


def last_rows(df: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """For each key the last row by order; null and empty keys left out. Partially aggregated, so no key's rows meet in one task."""
    rest = [c for c in df.columns if c != key]
    kept = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    best = kept.groupBy(key).agg(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_of(df, order))], F.struct(*rest).alias("row"))).alias("m"))
    return best.select(key, *[F.col(f"m.row.{c}").alias(c) for c in rest])


def column_conflicts(primary: DataFrame, secondary: DataFrame, key: str) -> list[str]:
    return sorted((set(primary.columns) & set(secondary.columns)) - {key})


def join_files(primary: DataFrame, secondaries: list[DataFrame], key: str | None = None, order: str | list[str] = "_line") -> DataFrame:
    """primary LEFT JOIN each secondary on the key (default: primary's first column); a column that primary has already is an error."""
    key = key or primary.columns[0]
    orders = order if isinstance(order, list) else [order]
    out = primary
    for s in secondaries:
        used = [o for o in orders if o in s.columns]
        one = last_rows(s, key, used or s.columns).drop(*[o for o in used if o in primary.columns])
        if conflicts := column_conflicts(primary, one, key):
            raise ValueError(f"columns in both tables: {', '.join(conflicts)}")
        out = out.join(one, key, "left")
    return out


def unmatched(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Secondary rows whose key no primary row has: errors of a file join."""
    kept = secondary.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.join(primary.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, column: str, value, order: str | list[str]) -> DataFrame:
    """The first row by order whose column equals value."""
    return df.where(F.col(column) == F.lit(value)).orderBy(*order_of(df, order)).limit(1)


def lookup_by_key(left: DataFrame, column: str, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """left with columns of the right row whose key, as text, equals left's column, as text."""
    found = right.select(F.col(key).cast("string").alias("_k"), *columns)
    return left.join(found, left[column].cast("string") == found["_k"], "left").drop("_k")


def exists_in(left: DataFrame, right: DataFrame, on, negate: bool = False) -> DataFrame:
    """Rows of left with (negate: without) a partner in right."""
    return left.join(right, on, "left_anti" if negate else "left_semi")


# -- filters --


def where_truthy(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(F.coalesce(predicate, F.lit(False)))


def find_first(df: DataFrame, predicate: Column, order: str | list[str]) -> DataFrame:
    return where_truthy(df, predicate).orderBy(*order_of(df, order)).limit(1)


# -- aggregates --


def sum_of(c: Column | str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def count_of(predicate: Column) -> Column:
    return F.count_if(F.coalesce(predicate, F.lit(False)))


def all_of(predicate: Column) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(predicate, F.lit(False))), F.lit(True))


def any_of(predicate: Column) -> Column:
    return F.coalesce(F.bool_or(F.coalesce(predicate, F.lit(False))), F.lit(False))


def none_of(predicate: Column) -> Column:
    return ~any_of(predicate)


def unique(c: Column | str) -> Column:
    """No value but null occurs twice."""
    return F.count(c) == F.count_distinct(c)


def group_rows(df: DataFrame, key: str, columns: list[str], order: str | list[str]) -> DataFrame:
    """key, rows: the rows of each key, in order, as an array of structs; null keys left out."""
    item = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_of(df, order))], F.struct(*columns).alias("_row"))
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    return groups.select(key, F.transform("rows", lambda r: r["_row"]).alias("rows"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """key, n of keys that several rows have."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with the order of their first row."""
    return df.groupBy(column).agg(F.min(order).alias("first_line"))


# -- order --


def ci_key(c: Column) -> Column:
    """Sort key of texts: case does not matter."""
    return F.lower(c.cast("string"))


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in ranges of the keys, with the range as _part. Ranges are drawn from a sample, so the dealt rows are kept: all that is counted by range must come from one draw."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(tasks, *keys).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: str | list[str], name: str = "row_index", partition: str | list[str] | None = None) -> DataFrame:
    """1-based row numbers by order. Without a partition all rows are counted in two levels: ranges of the order, then rows within."""
    keys = order_of(df, order)
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*order_of(df, partition)).orderBy(*keys)).cast("long"))
    ranged = _dealt(df, keys)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def beside(df: DataFrame, order: str | list[str], column: str, name: str, before: bool = False) -> DataFrame:
    """df with the column's value in the next row by order (or the one before) under a name, null at the end. Each range looks within itself; one row a range gives what stands beyond its border."""
    keys = order_of(df, order)
    ranged = _dealt(df, keys)
    edge, look = (F.max_by, F.lag) if before else (F.min_by, F.lead)
    within, along = Window.partitionBy("_part").orderBy(*keys), Window.orderBy("_part")
    borders = ranged.groupBy("_part").agg(edge(F.struct(F.col(column).alias("v")), F.struct(*keys)).alias("_edge")).select("_part", look("_edge").over(along).alias("_edge"))
    rows = ranged.withColumn("_own", look(F.struct(F.col(column).alias("v"))).over(within)).join(F.broadcast(borders), "_part")
    return rows.withColumn(name, F.coalesce("_own", "_edge")["v"]).drop("_part", "_own", "_edge")


def running(df: DataFrame, partition: list[str], order: str | list[str], column: str, kind: str, name: str) -> DataFrame:
    """A running sum, min, max or count over the rows so far."""
    w = Window.partitionBy(*partition).orderBy(*order_of(df, order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, getattr(F, kind)(column).over(w))


# -- long and wide --


def unpivot(df: DataFrame, key: str, columns: list[str] | None = None, skip_empty: bool = True) -> DataFrame:
    """(entity, attribute, value) triples of text cells; empty cells left out."""
    columns = columns or [c for c in df.columns if c != key]
    long = df.select(F.col(key).cast("string").alias("entity"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    long = long.unpivot("entity", columns, "attribute", "value")
    return long.where(F.col("value") != "") if skip_empty else long


def pivot(triples: DataFrame, order: str, attributes: list[str], on_conflict: str = "last") -> DataFrame:
    """One row an entity, one column an attribute; missing cells "". on_conflict: first or last by order (conflicts() lists them)."""
    pick = F.min_by if on_conflict == "first" else F.max_by
    wide = triples.groupBy("entity").pivot("attribute", attributes).agg(pick("value", order))
    return wide.select("entity", *[F.coalesce(F.col(f"`{a}`"), F.lit("")).alias(a) for a in attributes])


def conflicts(triples: DataFrame) -> DataFrame:
    """entity, attribute, n where several triples give one cell."""
    return triples.groupBy("entity", "attribute").agg(F.count("*").alias("n")).where("n > 1")


def attributes_in_order(triples: DataFrame, order: str, limit: int = 10_000) -> list[str]:
    """Attributes by first appearance: the header of the wide table, so at most `limit`."""
    rows = first_seen(triples, "attribute", order).orderBy("first_line", "attribute").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes do not make a table")
    return [r["attribute"] for r in rows]


def transpose(df: DataFrame, key: str) -> DataFrame:
    """Rows become columns; all values as text. For tables of few rows."""
    return df.select(F.col(key), *[F.col(c).cast("string").alias(c) for c in df.columns if c != key]).transpose(F.col(key))


# -- nested columns --


def implode(df: DataFrame, name: str, columns: dict[str, str], kind: str = "record") -> DataFrame:
    """Flat columns as one nested column: record (fields sorted by name), tuple (_1, _2, ...) or array (nulls kept)."""
    if kind == "array":
        made = F.array(*[F.col(c) for c in columns.values()])
    elif kind == "tuple":
        made = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns.values(), 1)])
    else:
        made = F.struct(*[F.col(c).alias(f) for f, c in sorted(columns.items())])
    return df.withColumn(name, made).drop(*columns.values())


def implode_map(df: DataFrame, name: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Key and value columns as a map; null keys are skipped, of equal keys the later pair wins."""
    items = F.filter(F.array(*[F.struct(F.col(k).alias("key"), F.col(v).alias("value")) for k, v in pairs]), lambda e: e["key"].isNotNull())
    names = F.transform(items, lambda e: e["key"])
    last = F.filter(items, lambda e, i: F.array_position(F.reverse(names), e["key"]) == F.size(names) - i)
    return df.withColumn(name, F.map_from_entries(last)).drop(*[c for p in pairs for c in p])


def explode_struct(df: DataFrame, name: str) -> DataFrame:
    """The fields of a struct column as columns `name.field`."""
    fields = df.schema[name].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != name], *[F.col(f"{name}.{f}").alias(f"{name}.{f}") for f in fields])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def with_truth(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    return df.withColumn(name, truthy(predicate))
