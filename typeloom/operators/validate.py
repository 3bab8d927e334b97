"""Validation as violation rows, and casts that never fail a job.

Every check yields rows (source, line, pk, column, value, type, level, message) instead of an error, so one pass over
the data reports all. A verdict column follows the rule: true or "" is fine, false or null the default message, a
text is the message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

VIOLATION = "source string, line long, pk string, column string, value string, type string, level string, message string"
#: Inclusive bounds of the sized integer types. Fixed values.
RANGES = {"ubyte": (0, 2**8 - 1), "ushort": (0, 2**16 - 1), "uint": (0, 2**32 - 1), "byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "integer": (-(2**53), 2**53), "long": (-(2**63), 2**63 - 1), "int64": (-(2**63), 2**63 - 1)}


# -- casts of text cells: null where the text does not fit --


def to_boolean(c: Column) -> Column:
    """true, yes, 1 and false, no, 0 in any case; t, y and the like are none."""
    low = F.lower(c)
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def to_number(c: Column) -> Column:
    """Decimal or hexadecimal, spaces around allowed."""
    t = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    hexa = F.regexp_extract(F.lower(t), "^[+-]?0x([0-9a-f]+)\\z", 1)
    value = F.when(hexa != "", F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("double") * F.when(t.startswith("-"), -1).otherwise(1))
    return F.coalesce(value, F.when(t.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z"), t.try_cast("double")))


def to_sized(c: Column, kind: str) -> Column:
    low, high = RANGES[kind]
    n = F.when(c.rlike("^[+-]?[0-9]+\\z"), c.try_cast("decimal(38,0)"))
    return F.when((n >= F.lit(low)) & (n <= F.lit(high)), n.try_cast("bigint"))


def to_enum(c: Column, labels: list[str]) -> Column:
    """The label as declared, whatever the case of the text."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for x in reversed(labels):
        out = F.when(low == x.lower(), F.lit(x)).otherwise(out)
    return out


def to_union(c: Column, members: list[str]) -> Column:
    """struct<type, value> of the first member type that takes the text."""
    out = F.lit(None).cast("struct<type:string,value:string>")
    for kind in reversed(members):
        value = cast_cell(c, kind)
        out = F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))).otherwise(out)
    return out


def cast_cell(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return to_boolean(c)
    if kind in RANGES:
        return to_sized(c, kind)
    if kind in ("number", "float"):
        return to_number(c)
    if kind == "percent":
        from typeloom.functions.numbers import percent

        return percent(c)
    if kind.startswith("{enum:"):
        return to_enum(c, kind[6:-1].split("|"))
    return c


# -- constraints --


def in_range(c: Column, low=None, high=None) -> Column:
    ok = F.lit(True)
    ok = ok & (c >= F.lit(low)) if low is not None else ok
    return ok & (c <= F.lit(high)) if high is not None else ok


def length_ok(c: Column, least: int | None = None, most: int | None = None) -> Column:
    """Length in bytes."""
    return in_range(F.octet_length(c), least, most)


# -- validators --


@dataclass(frozen=True)
class Validator:
    """A named check: verdict is a boolean or text column; level error or warn."""

    name: str
    verdict: Column
    level: str = "error"
    message: str = "validation failed"


def verdict_message(verdict: Column, kind, default: str) -> Column:
    """null where a verdict is fine, else its message."""
    if isinstance(kind, StringType):
        return F.when(verdict == "", F.lit(None)).otherwise(F.coalesce(verdict, F.lit(default)))
    if isinstance(kind, BooleanType):
        return F.when(F.coalesce(verdict, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(default))
    return F.lit("verdict is neither boolean nor text")


def _messages(df: DataFrame, validators: list[Validator]) -> list[Column]:
    kinds = df.select(*[v.verdict.alias(f"v{i}") for i, v in enumerate(validators)]).schema
    return [verdict_message(v.verdict, kinds[i].dataType, v.message) for i, v in enumerate(validators)]


def row_violations(df: DataFrame, validators: list[Validator], key: str, source: str = "", line: str | None = None) -> DataFrame:
    """Violations of row checks. After a row's first failing error-level check, its later checks are not reported."""
    items = []
    stopped = F.lit(False)
    for v, m in zip(validators, _messages(df, validators), strict=True):
        items.append(F.when(m.isNotNull() & ~stopped, F.struct(F.lit(v.name).alias("column"), F.lit(v.level).alias("level"), m.alias("message"))))
        if v.level == "error":
            stopped = stopped | m.isNotNull()
    found = df.select(
        F.lit(source).alias("source"), (F.col(line).cast("long") if line else F.lit(None).cast("long")).alias("line"), F.col(key).cast("string").alias("pk"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")
    )
    null = F.lit(None).cast("string")
    return found.select("source", "line", "pk", F.col("x.column").alias("column"), null.alias("value"), null.alias("type"), "x.level", "x.message")


def file_violations(df: DataFrame, validators: list[Validator], source: str = "") -> DataFrame:
    """Violations of whole-table checks, whose verdicts are aggregates; all in one pass. The first failing error-level check is the last reported."""
    one = df.agg(*[v.verdict.alias(f"v{i}") for i, v in enumerate(validators)])
    kinds = one.schema
    items, stopped = [], F.lit(False)
    for i, v in enumerate(validators):
        m = verdict_message(F.col(f"v{i}"), kinds[i].dataType, v.message)
        items.append(F.when(m.isNotNull() & ~stopped, F.struct(F.lit(v.name).alias("column"), F.lit(v.level).alias("level"), m.alias("message"))))
        stopped = stopped | m.isNotNull() if v.level == "error" else stopped
    null = F.lit(None).cast("string")
    out = one.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    return out.select(F.lit(source).alias("source"), null.cast("long").alias("line"), null.alias("pk"), F.col("x.column").alias("column"), null.alias("value"), null.alias("type"), "x.level", "x.message")


def cast_violations(df: DataFrame, types: dict[str, str], key: str, source: str = "", nullable: set[str] | None = None) -> DataFrame:
    """A row for each text cell that its declared type does not take, or that is empty without being nullable."""
    items = []
    for name, kind in types.items():
        empty = F.coalesce(F.col(name) == "", F.lit(True))
        bad = F.when(empty, F.lit(name not in (nullable or set()) and kind not in ("string",))).otherwise(cast_cell(F.col(name), kind).isNull())
        items.append(F.when(bad, F.struct(F.lit(name).alias("column"), F.col(name).alias("value"), F.lit(kind).alias("type"))))
    out = df.select(F.col(key).cast("string").alias("pk"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    null = F.lit(None).cast("long")
    return out.select(F.lit(source).alias("source"), null.alias("line"), "pk", F.col("x.column").alias("column"), F.col("x.value").alias("value"), F.col("x.type").alias("type"), F.lit("error").alias("level"), F.concat(F.lit("no "), F.col("x.type")).alias("message"))


def key_violations(df: DataFrame, key: str, source: str = "") -> DataFrame:
    """A row for each key that several rows have."""
    dup = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    null = F.lit(None).cast("string")
    return dup.select(F.lit(source).alias("source"), null.cast("long").alias("line"), F.col(key).cast("string").alias("pk"), F.lit(key).alias("column"), F.col(key).cast("string").alias("value"), null.alias("type"), F.lit("error").alias("level"), F.concat(F.lit("duplicate key, rows: "), F.col("n").cast("string")).alias("message"))


def override_levels(validators: list[Validator], levels: dict[str, str]) -> list[Validator]:
    """Validators with levels replaced by name; "none" drops one."""
    out = [Validator(v.name, v.verdict, levels.get(v.name, v.level), v.message) for v in validators]
    return [v for v in out if v.level != "none"]
