"""Table diffs: by key or by position, with trimming, case folding, numeric tolerance, column mapping and a cap."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered

SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Options:
    trim: bool = False
    ignore_case: bool = False
    epsilon: float | None = None
    mapping: dict[str, str] = field(default_factory=dict)  # column of the first table -> column of the second
    only: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    context: int = 0
    max_diffs: int | None = None


def columns_of(left: DataFrame, right: DataFrame, o: Options) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """Compared pairs, columns only of the first, columns only of the second."""
    wanted = [c for c in left.columns if (not o.only or c in o.only) and c not in o.exclude]
    pairs = [(c, o.mapping.get(c, c)) for c in wanted if o.mapping.get(c, c) in right.columns]
    ours, theirs = {a for a, _ in pairs}, {b for _, b in pairs}
    return pairs, [c for c in wanted if c not in ours], [c for c in right.columns if c not in theirs and c not in o.exclude and (not o.only or c in o.only)]


def normalised(c: Column, o: Options) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.btrim(c, F.lit(SPACES)) if o.trim else c
    return F.lower(c) if o.ignore_case else c


def equal(a: Column, b: Column, o: Options) -> Column:
    """Equal texts, or numbers no more than epsilon apart."""
    x, y = normalised(a, o), normalised(b, o)
    same = x == y
    if o.epsilon is None:
        return same
    return same | F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) <= o.epsilon, F.lit(False))


def _changes(pairs: list[tuple[str, str]], o: Options) -> Column:
    items = [F.when(~equal(F.col(f"l.{a}"), F.col(f"r.{b}"), o), F.struct(F.lit(a).alias("column"), F.col(f"l.{a}").cast("string").alias("old"), F.col(f"r.{b}").cast("string").alias("new"))) for a, b in pairs]
    return F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<struct<column:string,old:string,new:string>>")


def keyed(left: DataFrame, right: DataFrame, key: str | None = None, o: Options | None = None, order: str | None = None) -> DataFrame:
    """key, kind (changed, removed, added), changes. Each first row is compared with the last second row of its normalised key (null counts as empty);
    each second row whose key no first row has is added."""
    o = o or Options()
    key = key or left.columns[0]
    other = o.mapping.get(key, key)
    pairs = [(a, b) for a, b in columns_of(left, right, o)[0] if a != key and a != order]
    a = left.withColumn("_key", normalised(F.col(key), o))
    b = right.withColumn("_key", normalised(F.col(other), o))
    # the last row of a normalised key, by order or else by content; partially aggregated, so no key's rows meet in one task
    last = b.groupBy("_key").agg(F.max_by(F.struct(*right.columns), F.struct(order) if order else F.xxhash64(*right.columns)).alias("row")).select("_key", "row.*")
    both = a.alias("l").join(last.alias("r"), F.col("l._key") == F.col("r._key"), "left")
    changes = _changes(pairs, o)
    kind = F.when(F.col("r._key").isNull(), "removed").otherwise("changed")
    out = both.select(F.col("l._key").alias("key"), kind.alias("kind"), F.when(kind == "changed", changes).alias("changes")).where((F.col("kind") != "changed") | (F.size("changes") > 0))
    new = b.join(a.select("_key").distinct(), "_key", "left_anti")
    out = out.unionByName(new.select(F.col("_key").alias("key"), F.lit("added").alias("kind"), F.lit(None).cast(out.schema["changes"].dataType).alias("changes")))
    return out.orderBy((F.col("kind") == "added"), "key").limit(o.max_diffs) if o.max_diffs else out


def positional(left: DataFrame, right: DataFrame, order: str | list[str], o: Options | None = None) -> DataFrame:
    """row_index, kind (changed, removed, added, and same for context rows), changes: row i of one against row i of the other."""
    o = o or Options()
    keys = [order] if isinstance(order, str) else order
    pairs = [(a, b) for a, b in columns_of(left, right, o)[0] if a not in keys]
    a, b = numbered(left, order).alias("l"), numbered(right, order).alias("r")
    both = a.join(b, F.col("l.row_index") == F.col("r.row_index"), "full_outer")
    kind = F.when(F.col("r.row_index").isNull(), "removed").when(F.col("l.row_index").isNull(), "added").otherwise("changed")
    out = both.select(F.coalesce("l.row_index", "r.row_index").alias("row_index"), kind.alias("kind"), F.when(kind == "changed", _changes(pairs, o)).alias("changes"))
    out = out.withColumn("kind", F.when((F.col("kind") == "changed") & (F.size("changes") == 0), "same").otherwise(F.col("kind")))
    if o.context:
        near = out.where("kind <> 'same'").select(F.explode(F.sequence(F.col("row_index") - o.context, F.col("row_index") + o.context)).alias("row_index")).distinct()
        out = out.join(near, "row_index", "left_semi")
    else:
        out = out.where("kind <> 'same'")
    return out.orderBy("row_index").limit(o.max_diffs) if o.max_diffs else out


def cells(diff: DataFrame, key: str = "key") -> DataFrame:
    """One row a changed cell: key, column, old, new."""
    return diff.where("kind = 'changed'").select(key, F.explode("changes").alias("c")).select(key, "c.*")


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def tables(left: dict[str, DataFrame], right: dict[str, DataFrame], o: Options | None = None) -> DataFrame:
    """Sets of tables by name: name, state (compared, only_left, only_right), and the counts of each kind of difference."""
    parts = []
    for name in sorted({*left, *right}):
        if name in left and name in right:
            counts = summary(keyed(left[name], right[name], o=o)).groupBy().pivot("kind", ["changed", "removed", "added"]).agg(F.first("n"))
            row = counts.select(F.lit(name).alias("name"), F.lit("compared").alias("state"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("changed", "removed", "added")])
        else:
            spark = next(iter({**left, **right}.values())).sparkSession
            zero = F.lit(0).cast("long")
            row = spark.range(1).select(F.lit(name).alias("name"), F.lit("only_left" if name in left else "only_right").alias("state"), *[zero.alias(k) for k in ("changed", "removed", "added")])
        parts.append(row)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbours(changed: Column, order: Column, n: int) -> Column:
    """Whether a row is within n rows of a changed one, within a partition that the caller sets."""
    return F.max(changed.cast("int")).over(Window.orderBy(order).rowsBetween(-n, n)) == 1
