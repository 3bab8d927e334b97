"""Custom types: restrictions of a parent type, declared as rows and compiled to Columns.

A declaration names one family of constraints: a numeric range (inclusive; exact 64-bit integers take none), lengths in bytes and a
multi-pattern (unanchored), a subset of an enum's labels, a subset of a union's members, an expression over `value`, a shape
(text that must read as a table type, rewritten canonically), or the members of a tag. A type keeps its ancestors' checks.
value() is a cell as the type or null, problem() the reason why it is none, violations() the bad cells of a table as rows: all are
expressions of the row, so checking a table costs one scan.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.strings import matches_any
from typeloom.operators import validate as V
from typeloom.operators.expression import compile_expression

from . import typespec as S

FAMILIES = {"range": ("least", "most"), "text": ("min_bytes", "max_bytes", "pattern"), "labels": ("labels",), "members": ("members",), "expression": ("expression",), "shape": ("shape",), "tag": ("tagged",)}
_NUMBERS = ("number", "integer", "float", "percent")


@dataclass(frozen=True)
class Declared:
    name: str
    parent: str
    least: float | None = None
    most: float | None = None
    min_bytes: int | None = None
    max_bytes: int | None = None
    pattern: str | None = None
    labels: tuple[str, ...] | None = None
    members: tuple[str, ...] | None = None
    expression: str | None = None
    shape: str | None = None
    tagged: tuple[str, ...] | None = None

    @property
    def family(self) -> str | None:
        found = [f for f, names in FAMILIES.items() if any(getattr(self, n) is not None for n in names)]
        if len(found) > 1:
            raise ValueError(f"{self.name}: constraints of several families: {', '.join(found)}")
        return found[0] if found else None


class CustomTypes:
    """Declared types by name, over the types that are known anyway."""

    def __init__(self, declared: list[Declared] = (), types: S.Types | None = None):
        self.types = types or S.Types()
        self.by_name: dict[str, Declared] = {}
        for d in declared:
            self.add(d)

    @classmethod
    def from_rows(cls, rows: DataFrame, types: S.Types | None = None) -> CustomTypes:
        """From a table with a row for each type, in order of `_line` where it has one; absent columns count as null. Declarations are metadata: one row a type."""
        names = {f.name for f in fields(Declared)}
        listed = (rows.orderBy("_line") if "_line" in rows.columns else rows).collect()
        return cls([Declared(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if k in names and v is not None}) for r in listed], types)

    def lineage(self, name: str) -> list[str]:
        """The type, then each ancestor up to a built-in one."""
        out = [name]
        while out[-1] in self.by_name:
            out.append(self.by_name[out[-1]].parent)
        base = out[-1]
        while base in S.PARENTS:
            base = S.PARENTS[base]
            out.append(base)
        return out

    def base(self, name: str) -> str:
        while name in self.by_name:
            name = self.by_name[name].parent
        return name

    def add(self, d: Declared) -> None:
        if d.name in self.by_name or d.name in S.BASIC:
            raise ValueError(f"{d.name}: this type exists")
        spec = self.types.resolve(self.base(d.parent))
        family, root = d.family, self.lineage(self.base(d.parent))
        if spec.kind == "name" and spec.name not in S.BASIC and spec.name not in ("table", "any", "raw"):
            raise ValueError(f"{d.name}: unknown parent {d.parent}")
        if family == "range":
            if "int64" in root or not any(n in root for n in _NUMBERS):
                raise ValueError(f"{d.name}: a range needs a number type, not {d.parent}")
            if d.least is not None and d.most is not None and d.least > d.most:
                raise ValueError(f"{d.name}: least is above most")
        if family == "text":
            if "string" not in root and "ascii" not in root:
                raise ValueError(f"{d.name}: lengths and patterns need a text type, not {d.parent}")
            if d.min_bytes is not None and (d.min_bytes < 0 or d.max_bytes is not None and d.min_bytes > d.max_bytes):
                raise ValueError(f"{d.name}: impossible lengths")
        if family == "labels" and (spec.kind != "enum" or not {x.lower() for x in d.labels} <= {x.lower() for x in self.labels(d.parent)}):
            raise ValueError(f"{d.name}: labels that {d.parent} does not have")
        if family == "members" and (spec.kind != "union" or not set(d.members) <= set(self.members(d.parent))):
            raise ValueError(f"{d.name}: members that {d.parent} does not have")
        if family == "tag":
            if bad := [m for m in d.tagged if not self.narrower(m, d.parent)]:
                raise ValueError(f"{d.name}: no subtypes of {d.parent}: {', '.join(bad)}")
        self.by_name[d.name] = d

    def labels(self, name: str) -> list[str]:
        for d in map(self.by_name.get, self.lineage(name)):
            if d and d.labels is not None:
                return list(d.labels)
        return list(self.types.resolve(self.base(name)).items)

    def members(self, name: str) -> list[str]:
        for d in map(self.by_name.get, self.lineage(name)):
            if d and d.members is not None:
                return list(d.members)
        return [str(m) for m in self.types.resolve(self.base(name)).items]

    def tag_members(self, tag: str) -> list[str]:
        return sorted(self.by_name[tag].tagged or ())

    def in_tag(self, name: str, tag: str) -> bool:
        """Whether a type is a member of a tag, narrower than one, or in a tag that is one."""
        return any(name == m or self.narrower(name, m) or m in self.by_name and self.by_name[m].tagged is not None and self.in_tag(name, m) for m in self.by_name[tag].tagged or ())

    def narrower(self, a: str, b: str) -> bool:
        if b in self.by_name and self.by_name[b].tagged is not None and self.in_tag(a, b):
            return True
        return b in self.lineage(a) or b not in self.by_name and self.types.narrower(self.base(a), b)

    # -- Columns --

    def _shaped(self, c: Column, shape: str) -> Column:
        """The canonical JSON of a text that reads completely as a table type, else null."""
        from .tables import nested_value

        kind = self.types.spark(shape)
        read = nested_value(c, kind)
        full = F.forall(read, lambda x: x.isNotNull()) if isinstance(kind, T.ArrayType) else F.lit(True)
        if isinstance(kind, T.StructType):
            full = F.lit(True)
            for f in kind:
                full = full & read[f.name].isNotNull()
        return F.when(full, F.to_json(read))

    def value(self, c: Column, name: str) -> Column:
        """A text cell as the type: null where it is no value of it."""
        return F.when(self.problem(c, name) == "", self._cast(c, name))

    def _cast(self, c: Column, name: str) -> Column:
        base = self.base(name)
        for d in map(self.by_name.get, self.lineage(name)):
            if d and d.shape is not None:
                return self._shaped(c, d.shape)
        spec = self.types.resolve(base)
        if spec.kind == "enum":
            return V.to_enum(c, self.labels(name))
        if spec.kind == "union":
            return V.to_union(c, [m for m in self.members(name) if m != "nil"])
        return V.cast_cell(c, spec.name)

    def problem(self, c: Column, name: str) -> Column:
        """ "" where a text cell is a value of the type, else what it breaks first: the base type, then each constraint from the oldest ancestor on."""
        cast = self._cast(c, name)
        out = F.when(cast.isNull(), F.lit(f"no {name}"))
        for d in [self.by_name[n] for n in reversed(self.lineage(name)) if n in self.by_name]:
            rules: list[tuple[Column, str]] = []
            if d.family == "range":
                number = V.to_number(c)
                rules = [(number >= F.lit(d.least), f"below {d.least:g}")] if d.least is not None else []
                rules += [(number <= F.lit(d.most), f"above {d.most:g}")] if d.most is not None else []
            elif d.family == "text":
                rules = [(F.octet_length(c) >= d.min_bytes, f"under {d.min_bytes} bytes")] if d.min_bytes is not None else []
                rules += [(F.octet_length(c) <= d.max_bytes, f"over {d.max_bytes} bytes")] if d.max_bytes is not None else []
                rules += [(matches_any(c, d.pattern), f"does not match {d.pattern}")] if d.pattern is not None else []
            elif d.family == "expression":
                holds = compile_expression(d.expression, {"value": self._cast(c, d.parent)})
                rules = [(holds, f"not {d.expression.lstrip('=')}")]
            for ok, message in rules:
                out = out.when(~F.coalesce(ok, F.lit(False)), F.lit(message))
        return out.otherwise("")

    def violations(self, df: DataFrame, columns: dict[str, str], key: str, source: str = "") -> DataFrame:
        """pk, column, value, type, message (and the other columns of a violation) of each non-empty text cell that is no value of its type."""
        items = []
        for name, kind in columns.items():
            message = self.problem(F.col(name), kind)
            items.append(F.when((F.coalesce(F.col(name), F.lit("")) != "") & (message != ""), F.struct(F.lit(name).alias("column"), F.col(name).alias("value"), F.lit(kind).alias("type"), message.alias("message"))))
        found = df.select(F.col(key).cast("string").alias("pk"), F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
        return found.select(F.lit(source).alias("source"), F.lit(None).cast("long").alias("line"), "pk", "x.column", "x.value", "x.type", F.lit("error").alias("level"), "x.message")
