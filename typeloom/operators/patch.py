"""Patches: keyed row patches with list and map deltas, bulk rules, load-order folds, lineage and conflicts.

A null patch cell leaves the value unchanged; a cell "=nil" clears it. Deltas apply after direct sets, replacements last.
Bulk rules run in order, each seeing what earlier ones wrote; aggregates see the table as it was before the rule. Every
patched value is a plain expression of the joined rows, so a patch costs one join whatever its number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from typeloom.functions import collections as C

#: Column prefixes of deltas, longest first where one begins another. Fixed values.
VERBS = ("replace_last_oldvalue_", "replace_last_newvalue_", "replace_oldvalue_", "replace_newvalue_", "remove_last_", "prepend_", "append_", "replace_", "remove_")


def classify(columns: list[str], target: list[str]) -> dict[str, tuple[str, str]]:
    """Patch column -> (verb, target column). A literal target column beats a prefix, longer prefixes beat shorter ones."""
    out = {}
    for c in columns:
        if c in target:
            out[c] = ("set", c)
            continue
        for verb in sorted(VERBS, key=len, reverse=True):
            if c.startswith(verb) and c.removeprefix(verb) in target:
                out[c] = (verb.rstrip("_"), c.removeprefix(verb))
                break
        else:
            raise ValueError(f"patch column {c} names no column of the target")
    return out


def _delta(verb: str, value: Column, cell: Column, kind) -> Column:
    if isinstance(kind, MapType):
        done = {"append": lambda: C.merge(value, cell), "replace": lambda: cell, "remove": lambda: C.drop_keys(value, F.map_keys(cell))}[verb]()
    else:
        one = {
            "append": lambda: F.concat(value, cell),
            "prepend": lambda: F.concat(cell, value),
            "replace": lambda: cell,
            "remove": lambda: F.aggregate(cell, value, C.remove_first),
            "remove_last": lambda: F.aggregate(cell, value, C.remove_last),
        }
        done = one[verb]()
    return F.when(cell.isNull(), value).otherwise(done)


def row_patch(target: DataFrame, patch: DataFrame, key: str | None = None, op: str = "patchOp", default_op: str = "update", defaults: dict[str, Column] | None = None) -> DataFrame:
    """target after a patch with at most one row a key. Ops: add, remove, update, replace. patch_problems() lists what did not apply."""
    key = key or target.columns[0]
    kinds = {f.name: f.dataType for f in target.schema}
    verbs = classify([c for c in patch.columns if c not in (key, op)], target.columns)
    how = F.coalesce(F.col(op), F.lit(default_op)) if op in patch.columns else F.lit(default_op)
    p = patch.select(F.col(key).alias("_pk"), how.alias("_op"), *[F.col(c).alias(f"_p_{c}") for c in verbs])
    both = target.withColumn("_there", F.lit(True)).join(p, F.col(key) == F.col("_pk"), "full_outer")
    there, action = F.coalesce("_there", F.lit(False)), F.col("_op")
    both = both.where((there & ~F.coalesce(action == "remove", F.lit(False))) | (~there & (action == "add")))
    defaults = defaults or {}
    fresh = (~there) | F.coalesce(action == "replace", F.lit(False))
    touched = action.isNotNull() & ~(there & (action == "add"))  # adding a key that is there changes nothing
    out = {key: F.coalesce(F.col(key), F.col("_pk"))}
    for name in target.columns:
        if name == key:
            continue
        value = F.when(fresh, defaults.get(name, F.lit(None)).cast(kinds[name])).otherwise(F.col(name))
        own = [(v, F.col(f"_p_{c}")) for c, (v, t) in verbs.items() if t == name]
        for verb, cell in own:
            if verb == "set":
                clear = F.coalesce(cell.cast("string") == "=nil", F.lit(False)) if not isinstance(kinds[name], (ArrayType, MapType)) else F.lit(False)
                value = F.when(clear, F.lit(None).cast(kinds[name])).when(cell.isNull(), value).otherwise(cell.try_cast(kinds[name]) if not isinstance(kinds[name], (ArrayType, MapType)) else cell)
        for verb, cell in own:
            if verb in ("append", "prepend", "replace", "remove", "remove_last"):
                empty = F.array().cast(kinds[name]) if isinstance(kinds[name], ArrayType) else F.create_map().cast(kinds[name])
                value = F.when(cell.isNull(), value).otherwise(_delta(verb, F.coalesce(value, empty), cell, kinds[name]))
        olds = {v: c for v, c in own if v.endswith("oldvalue")}
        for verb, old in olds.items():
            new = dict(own)[verb.replace("old", "new")]
            swap = C.replace_last if "last" in verb else C.replace_first
            value = F.when(old.isNull(), value).otherwise(swap(value, old, new))
        out[name] = F.when(touched, value).otherwise(F.col(name))
    return both.select(*[out[c].alias(c) for c in target.columns])


def patch_problems(target: DataFrame, patch: DataFrame, key: str | None = None, op: str = "patchOp", default_op: str = "update") -> DataFrame:
    """key, op, level, message for patch rows that cannot apply."""
    key = key or target.columns[0]
    p = patch.select(F.col(key).alias("key"), (F.coalesce(F.col(op), F.lit(default_op)) if op in patch.columns else F.lit(default_op)).alias("op"))
    both = p.join(target.select(F.col(key).alias("_t")).distinct(), F.col("key") == F.col("_t"), "left")
    missing = F.col("_t").isNull()
    level = F.when((F.col("op") == "add") & ~missing, "error").when((F.col("op") == "remove") & missing, "warn").when(F.col("op").isin("update", "replace") & missing, "error")
    return both.select("key", "op", level.alias("level"), F.when(F.col("op") == "add", "key exists").otherwise("no such key").alias("message")).where("level is not null")


@dataclass(frozen=True)
class Rule:
    """A bulk rule: rows for which where holds (not null, not false) are removed, or get each column set in turn."""

    where: Column
    sets: dict[str, Column] = field(default_factory=dict)
    remove: bool = False


def bulk_patch(target: DataFrame, rules: list[Rule]) -> DataFrame:
    """target after the rules. Removed rows stay visible to later rules and go at the end; a set that gives null keeps the value."""
    out = target.withColumn("_removed", F.lit(False))
    for rule in rules:
        out = out.withColumn("_hit", F.coalesce(rule.where, F.lit(False)))
        if rule.remove:
            out = out.withColumn("_removed", F.col("_removed") | F.col("_hit"))
        for name, value in rule.sets.items():
            kind = out.schema[name].dataType
            out = out.withColumn(name, F.when(F.col("_hit"), F.coalesce(value.cast(kind), F.col(name))).otherwise(F.col(name)))
    return out.where(~F.col("_removed")).select(*target.columns)


def last_writer(writes: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Of several writes to a slot the last by order."""
    return writes.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(value).alias("v"))).alias("m")).select(*keys, F.col(f"m.v.{value}").alias(value))


def recompute(df: DataFrame, derived: dict[str, Column], dirty: Column | None = None, kept: dict[str, Column] | None = None) -> DataFrame:
    """Derived columns evaluated again, in the order given, in dirty rows; kept says in which rows a column was set directly."""
    for name, value in derived.items():
        again = (dirty if dirty is not None else F.lit(True)) & ~(kept or {}).get(name, F.lit(False))
        df = df.withColumn(name, F.when(F.coalesce(again, F.lit(False)), value).otherwise(F.col(name)))
    return df


# -- lineage: events (seq, kind cell|row|schema, target, pk, col, action, source) --


def events_of(before: DataFrame, after: DataFrame, key: str, target: str, source: str, seq: int) -> DataFrame:
    """The cell and row events by which a patch turned one table into the other."""
    names = [c for c in before.columns if c != key]
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    gone, new = F.col(f"b.{key}").isNull(), F.col(f"a.{key}").isNull()
    changed = F.filter(F.array(*[F.when(~F.to_json(F.struct(F.col(f"a.{c}").alias("v"))).eqNullSafe(F.to_json(F.struct(F.col(f"b.{c}").alias("v")))), F.struct(F.lit("cell").alias("kind"), F.lit(c).alias("col"), F.concat(F.lit("= "), F.coalesce(F.col(f"b.{c}").cast("string"), F.lit("nil"))).alias("action"))) for c in names]), lambda x: x.isNotNull())
    row = lambda verb: F.array(F.struct(F.lit("row").alias("kind"), F.lit(None).cast("string").alias("col"), F.lit(verb).alias("action")))
    items = F.when(gone, row("remove")).when(new, row("add")).otherwise(changed)
    out = both.select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).cast("string").alias("pk"), F.explode(items).alias("e"))
    return out.select(F.lit(seq).cast("long").alias("seq"), "e.kind", F.lit(target).alias("target"), "pk", "e.col", "e.action", F.lit(source).alias("source"))


def report(events: DataFrame, target: str | None = None, pk: str | None = None, col: str | None = None) -> DataFrame:
    for name, value in (("target", target), ("pk", pk)):
        events = events.where(F.col(name) == value) if value is not None else events
    return events.where((F.col("kind") == "row") | (F.col("col") == col)) if col is not None else events


def dirty_cells(events: DataFrame) -> DataFrame:
    return events.where("kind = 'cell'").select("target", "pk", "col").distinct()


def conflict_report(events: DataFrame) -> DataFrame:
    """target, pk, col, kind: rows removed or replaced that several sources touched; else cells of which a whole-value write came after
    another source's event; defaults that several sources set. All by aggregates: a slot's writes need no order but their extremes."""
    data = events.where("kind in ('cell', 'row')")
    rows = data.groupBy("target", "pk").agg(F.count_distinct("source").alias("n"), F.bool_or((F.col("kind") == "row") & F.col("action").isin("remove", "replace")).alias("tense"))
    rows = rows.where("tense and n >= 2").select("target", "pk")
    # a whole write conflicts if some earlier event of its slot has another source: compare it with each source's first event
    cells = data.where("kind = 'cell'")
    firsts = cells.groupBy("target", "pk", "col", "source").agg(F.min("seq").alias("first"))
    whole = cells.where(F.col("action").startswith("= ") | F.col("action").startswith("replace_whole "))
    lasts = whole.groupBy("target", "pk", "col", "source").agg(F.max("seq").alias("last"))
    hit = lasts.alias("w").join(firsts.alias("f"), ["target", "pk", "col"]).where((F.col("w.source") != F.col("f.source")) & (F.col("f.first") < F.col("w.last")))
    slots = hit.select("target", "pk", "col").distinct().join(rows, ["target", "pk"], "left_anti")
    schema = events.where("kind = 'schema' and action like 'newDefault%'").groupBy("target", "col").agg(F.count_distinct("source").alias("n")).where("n >= 2")
    null = F.lit(None).cast("string")
    return (
        rows.select("target", "pk", null.alias("col"), F.lit("row").alias("kind"))
        .unionByName(slots.select("target", "pk", "col", F.lit("cell").alias("kind")))
        .unionByName(schema.select("target", null.alias("pk"), "col", F.lit("default").alias("kind")))
    )


# -- schema overlays: rows (target, column, new_default, widen_to, validator, level, load_order) --

LEVELS = ("none", "warn", "error")


def collect_overlays(overlays: DataFrame) -> DataFrame:
    """target, column, new_default (the last), widen_to (distinct types, sorted), level (the least severe)."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return overlays.groupBy("target", "column").agg(
        F.max(F.when(F.col("new_default").isNotNull(), F.struct("load_order", "new_default")))["new_default"].alias("new_default"),
        F.sort_array(F.collect_set("widen_to")).alias("widen_to"),
        F.element_at(F.array(*map(F.lit, LEVELS)), F.min(F.when(rank > 0, rank)).cast("int")).alias("level"),
    )
