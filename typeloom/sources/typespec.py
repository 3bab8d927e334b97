"""The type language of table headers: parsed on the driver, compiled to Spark types and checks.

    name  T|U  {T}  {K:V}  {A,B}  {f:T,g:U}  {enum:a|b}  {extends:P,f:T}

A single pair in braces is a map, several are a record (fields sorted by name), several bare types a tuple.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

#: Built-in names and their Spark types. Fixed values.
BASIC = {
    "boolean": T.BooleanType(), "string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "float": T.DoubleType(), "long": T.LongType(), "int64": T.LongType(),
    "ubyte": T.ShortType(), "ushort": T.IntegerType(), "uint": T.LongType(), "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "percent": T.DoubleType(),
    "ratio": T.MapType(T.StringType(), T.DoubleType()), "true": T.BooleanType(), "nil": T.NullType(), "hexbytes": T.StringType(), "base64bytes": T.StringType(), "version": T.StringType(),
    "text": T.StringType(), "comment": T.StringType(), "markdown": T.StringType(), "ascii": T.StringType(), "asciitext": T.StringType(), "asciimarkdown": T.StringType(), "name": T.StringType(),
    "identifier": T.StringType(), "filepath": T.StringType(), "http": T.StringType(), "regex": T.StringType(), "expression": T.StringType(), "type": T.StringType(), "type_spec": T.StringType(),
    "cmp_version": T.StringType(), "node_name": T.StringType(), "composable_name": T.StringType(), "undirected_edge_key": T.StringType(), "directed_edge_key": T.StringType(),
}
#: Narrower name -> the wider one it restricts. Fixed values.
PARENTS = {
    "ubyte": "ushort", "ushort": "uint", "uint": "integer", "byte": "short", "short": "int", "int": "integer", "integer": "number", "float": "number", "long": "number", "percent": "number",
    "text": "string", "comment": "string", "markdown": "text", "ascii": "string", "asciitext": "ascii", "asciimarkdown": "asciitext", "name": "ascii", "identifier": "name", "filepath": "string",
    "http": "string", "regex": "string", "expression": "string", "version": "ascii", "cmp_version": "ascii", "hexbytes": "ascii", "base64bytes": "ascii", "node_name": "identifier", "composable_name": "identifier",
}


@dataclass(frozen=True)
class Spec:
    """kind: name, union, array, map, tuple, record, enum or extends; items by kind."""

    kind: str
    name: str = ""
    items: tuple = ()

    def __str__(self) -> str:
        if self.kind == "name":
            return self.name
        if self.kind == "union":
            return "|".join(map(str, self.items))
        if self.kind == "enum":
            return "{enum:" + "|".join(self.items) + "}"
        if self.kind in ("array", "tuple"):
            return "{" + ",".join(map(str, self.items)) + "}"
        pairs = ",".join(f"{k}:{v}" for k, v in self.items)
        return "{" + (f"extends:{self.name}" + ("," if pairs else "") if self.kind == "extends" else "") + pairs + "}"


def parse(text: str) -> Spec:
    tokens = re.findall(r"[A-Za-z_][\w.]*|[{}:,|]", text.replace(" ", ""))
    if "".join(tokens) != text.replace(" ", ""):
        raise ValueError(f"bad type {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(want: str = "") -> str:
        nonlocal at
        t = peek()
        if not t or want and t != want:
            raise ValueError(f"bad type {text!r}: {want or 'a name'} expected")
        at += 1
        return t

    def union() -> Spec:
        parts = [one()]
        while peek() == "|":
            take("|")
            parts.append(one())
        return parts[0] if len(parts) == 1 else Spec("union", items=tuple(parts))

    def one() -> Spec:
        if peek() != "{":
            t = take()
            if not re.match(r"[A-Za-z_]", t):
                raise ValueError(f"bad type {text!r}")
            return Spec("name", t)
        take("{")
        if peek() == "enum" and tokens[at + 1 : at + 2] == [":"]:
            take()
            take(":")
            labels = [take()]
            while peek() == "|":
                take("|")
                labels.append(take())
            take("}")
            return Spec("enum", items=tuple(labels))
        if peek() == "}":
            take("}")
            return Spec("name", "table")
        bare, pairs = [], []
        while True:
            left = union()
            if peek() == ":":
                take(":")
                pairs.append((str(left), union()))
            else:
                bare.append(left)
            if peek() != ",":
                break
            take(",")
        take("}")
        if pairs and bare:
            raise ValueError(f"bad type {text!r}: fields and bare types mixed")
        if bare:
            return Spec("array" if len(bare) == 1 else "tuple", items=tuple(bare))
        if pairs[0][0] == "extends":
            return Spec("extends", str(pairs[0][1]), tuple(sorted(pairs[1:])))
        if len(pairs) == 1:
            return Spec("map", items=tuple(pairs))
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError(f"bad type {text!r}: a field twice")
        return Spec("record", items=tuple(sorted(pairs)))

    out = union()
    if at < len(tokens):
        raise ValueError(f"bad type {text!r}")
    return out


class Types:
    """Known types: built-in ones, aliases, and tags (named groups)."""

    def __init__(self, aliases: dict[str, str] | None = None, tags: dict[str, set[str]] | None = None):
        self.aliases = {k: parse(v) for k, v in (aliases or {}).items()}
        self.tags = tags or {}

    def resolve(self, spec: Spec | str, depth: int = 0) -> Spec:
        """A spec with its outermost alias and inheritance replaced."""
        spec = parse(spec) if isinstance(spec, str) else spec
        if depth > 50:
            raise ValueError(f"type {spec} refers to itself")
        if spec.kind == "name" and spec.name in self.aliases:
            return self.resolve(self.aliases[spec.name], depth + 1)
        if spec.kind == "extends":
            parent = self.resolve(parse(spec.name), depth + 1)
            if not spec.items:
                return parent
            fields = dict(parent.items)
            for name, kind in spec.items:
                if name in fields and str(kind) != "nil" and not self.narrower(kind, fields[name]):
                    raise ValueError(f"field {name}: {kind} is no narrower than {fields[name]}")
                fields[name] = kind
            return Spec("record", items=tuple(sorted(fields.items())))
        return spec

    def nullable(self, spec: Spec | str) -> bool:
        s = self.resolve(spec)
        return s.kind == "name" and s.name == "nil" or s.kind == "union" and any(self.nullable(m) for m in s.items)

    def narrower(self, a: Spec | str, b: Spec | str) -> bool:
        """Whether every value of a is one of b: by name lineage, tags, members, elements and fields."""
        a, b = (parse(x) if isinstance(x, str) else x for x in (a, b))
        if str(a) == str(b):
            return True
        if b.kind == "name" and b.name in self.tags:
            return any(self.narrower(a, m) for m in self.tags[b.name])
        if a.kind == "name" and b.kind == "name" and a.name in PARENTS:
            return self.narrower(Spec("name", PARENTS[a.name]), b)
        x, y = self.resolve(a), self.resolve(b)
        if x.kind == "union":
            return all(self.narrower(m, y) for m in x.items)
        if y.kind == "union":
            return any(self.narrower(x, m) for m in y.items)
        if x.kind == "enum":
            return y.kind == "name" and y.name in ("string", "ascii", "name", "identifier") or y.kind == "enum" and set(x.items) <= set(y.items)
        if x.kind in ("array", "tuple") and x.kind == y.kind and len(x.items) == len(y.items):
            return all(self.narrower(m, n) for m, n in zip(x.items, y.items, strict=True))
        if x.kind == y.kind == "map":
            return self.narrower(parse(x.items[0][0]), parse(y.items[0][0])) and self.narrower(x.items[0][1], y.items[0][1])
        if x.kind == y.kind == "record":
            own = dict(x.items)
            return all(k in own and self.narrower(own[k], v) for k, v in y.items)
        if (x, y) != (a, b):
            return self.narrower(x, y)
        return False

    def spark(self, spec: Spec | str) -> T.DataType:
        """The Spark type. A union of one type and nil is that type; other unions are struct<type, value>."""
        s = self.resolve(spec)
        if s.kind == "name":
            if s.name in BASIC:
                return BASIC[s.name]
            if s.name in ("table", "raw", "any"):
                return T.VariantType()
            raise ValueError(f"unknown type {s.name}")
        if s.kind == "enum":
            return T.StringType()
        if s.kind == "array":
            return T.ArrayType(self.spark(s.items[0]))
        if s.kind == "map":
            return T.MapType(self.spark(s.items[0][0]), self.spark(s.items[0][1]))
        if s.kind == "tuple":
            return T.StructType([T.StructField(f"_{i}", self.spark(m)) for i, m in enumerate(s.items, 1)])
        if s.kind == "record":
            return T.StructType([T.StructField(k, self.spark(v)) for k, v in s.items])
        members = [m for m in s.items if str(m) != "nil"]
        if len(members) == 1:
            return self.spark(members[0])
        return T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])


@dataclass(frozen=True)
class Column:
    name: str
    spec: Spec
    default: str | None = None
    published: bool = False


def header_column(text: str) -> Column:
    """`name[!]:type[:default]`; without a type it is string."""
    m = re.match(r"^([^:!]+)(!?)(?::(.*))?$", text, re.S)
    if not m or not m[1].strip():
        raise ValueError(f"bad header cell {text!r}")
    rest = m[3] or "string"
    depth = 0
    for i, ch in enumerate(rest):
        depth += (ch == "{") - (ch == "}")
        if ch == ":" and depth == 0:
            return Column(m[1], parse(rest[:i] or "string"), rest[i + 1 :], bool(m[2]))
    return Column(m[1], parse(rest), None, bool(m[2]))


def header(cells: list[str], parent: list[Column] | None = None) -> list[Column]:
    """Columns of a header line; a missing default is the parent table's. The first column, the key, has to be basic."""
    inherited = {c.name: c.default for c in parent or []}
    out = [c if c.default is not None else Column(c.name, c.spec, inherited.get(c.name), c.published) for c in map(header_column, cells)]
    if len({c.name for c in out}) < len(out):
        raise ValueError("a column name stands twice")
    if out and out[0].spec.kind not in ("name", "enum", "union"):
        raise ValueError("the key column is not basic")
    return out


def schema_rows(types: Types) -> list[tuple[str, str, str]]:
    """(name, definition, kind) of each alias."""
    return [(k, str(v), types.resolve(v).kind) for k, v in sorted(types.aliases.items())]


# -- exploded columns: a.b._1, items[1], stats[1]= --


def exploded(names: list[str]) -> dict[str, dict]:
    """root -> {"kind": record, tuple, array or map, "columns": ...} of columns that spell out a nested value."""
    out: dict[str, dict] = {}
    for n in names:
        if m := re.match(r"^(\w+)\[(\d+)\](=?)$", n):
            got = out.setdefault(m[1], {"kind": "array", "keys": {}, "values": {}})
            got["values" if m[3] else "keys"][int(m[2])] = n
        elif "." in n:
            root, _, path = n.partition(".")
            out.setdefault(root, {"kind": "record", "fields": {}})["fields"][path] = n
    for root, got in out.items():
        if got["kind"] == "record":
            f = got["fields"]
            if all(re.match(r"^_\d+$", k) for k in f):
                if sorted(int(k[1:]) for k in f) != list(range(1, len(f) + 1)):
                    raise ValueError(f"{root}: tuple fields are not consecutive")
                got["kind"] = "tuple"
        else:
            if sorted(got["keys"]) != list(range(1, len(got["keys"]) + 1)):
                raise ValueError(f"{root}: indices are not 1, 2, ...")
            if got["values"]:
                got["kind"] = "map"
                if set(got["values"]) != set(got["keys"]):
                    raise ValueError(f"{root}: a key without a value or a value without a key")
    return out
