"""Cell expressions as Columns: a small whitelisted grammar, never evaluated as code.

Python's own parser reads the text, whose operators are first given Python's spelling at the same precedence; only arithmetic, comparison, boolean operators,
literals, self.field, self[field], self[position], published names and the listed functions are translated. Each part is compiled with the kinds of value it can have. Where
they are known and agree, the Column is a plain typed one; where operands of `and` and `or` differ, it is a variant, and what works on it looks at
the kind each row holds. Rules of the language: only nil (null) and false do not hold; texts of numbers count as numbers in arithmetic but equal none; values of two kinds are
never equal; what the language refuses (arithmetic on a boolean, a comparison of a number with a text, a zero divisor of integers) is null in that row and
ends no job. Derived columns are put in dependency order, cycles are refused.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.numbers import float_divide, floored_mod


class Value(NamedTuple):
    """kind: nil, boolean, int, float, string, table, variant (known by row only), other, or unknown (taken as it stands)."""

    column: Column
    kind: str


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "string"
    for of, name in ((T.BooleanType, "boolean"), (T.IntegralType, "int"), (T.NumericType, "float"), (T.VariantType, "variant"), (T.NullType, "nil")):
        if isinstance(kind, of):
            return name
    return "table" if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else "other"


# -- what a variant holds, by row --


def _holds_kind(v: Column, *names: str) -> Column:
    return F.coalesce(F.regexp_like(F.schema_of_variant(v), F.lit(f"^(?:{'|'.join(names)})")), F.lit(False))


_NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def _got(v: Column, to: str, *names: str) -> Column:
    return F.when(_holds_kind(v, *names), F.try_variant_get(v, "$", to))


def as_variant(v: Value) -> Column:
    if v.kind == "variant":
        return v.column
    if v.kind == "nil":
        return F.lit(None).cast("variant")
    if v.kind == "table":
        return F.to_variant_object(v.column)
    return (v.column.cast("long") if v.kind == "int" else v.column).cast("variant")


def number(v: Value, coerce: bool = True) -> Column:
    """The value as a number, long or double; null where it is none. coerce: texts of numbers count."""
    if v.kind == "int":
        return v.column.cast("long")
    if v.kind in ("float", "unknown"):
        return v.column
    if v.kind == "string" and coerce:
        return F.btrim(v.column).try_cast("double")
    if v.kind == "variant":
        exact = _got(v.column, "double", *_NUMBERS)
        return F.coalesce(exact, F.btrim(_got(v.column, "string", "STRING")).try_cast("double")) if coerce else exact
    return F.lit(None).cast("double")


def text(v: Value, coerce: bool = True) -> Column:
    """The value as text; null where it is neither text nor (coerce) number."""
    if v.kind in ("string", "unknown") or v.kind in ("int", "float") and coerce:
        return v.column.cast("string")
    if v.kind == "variant":
        return _got(v.column, "string", "STRING", *(_NUMBERS if coerce else ()))
    return F.lit(None).cast("string")


def truth(v: Value) -> Column:
    """Whether the value holds; never null."""
    if v.kind in ("boolean", "unknown"):
        return F.coalesce(v.column, F.lit(False))
    if v.kind == "nil":
        return F.lit(False)
    if v.kind == "variant":
        return F.coalesce(~_holds_kind(v.column, "VOID"), F.lit(False)) & F.coalesce(_got(v.column, "boolean", "BOOLEAN"), v.column.isNotNull())
    return v.column.isNotNull()


def is_nil(v: Value) -> Column:
    return v.column.isNull() | _holds_kind(v.column, "VOID") if v.kind == "variant" else F.lit(True) if v.kind == "nil" else v.column.isNull()


def converted(v: Value, to: T.DataType) -> Column:
    """The value as a column type; null where it does not fit."""
    if v.kind == "nil":
        return F.lit(None).cast(to)
    if v.kind != "variant":
        return v.column.cast(to) if v.kind in ("unknown", "table") else v.column.try_cast(to)
    if isinstance(to, T.VariantType):
        return v.column
    if isinstance(to, T.StringType):
        return F.when(~_holds_kind(v.column, "VOID"), F.try_variant_get(v.column, "$", "string"))
    if isinstance(to, T.BooleanType):
        return _got(v.column, "boolean", "BOOLEAN")
    if isinstance(to, T.IntegralType):
        n = number(v)
        return F.coalesce(_got(v.column, "long", "BIGINT"), F.when(n == F.floor(n), F.floor(n))).try_cast(to)
    if isinstance(to, T.NumericType):
        return number(v).try_cast(to)
    return F.try_variant_get(v.column, "$", to.simpleString())


# -- operators --

_SAME = {"int": "number", "float": "number"}


def _numeric(a: Value, b: Value) -> str:
    return "unknown" if "unknown" in (a.kind, b.kind) and "variant" not in (a.kind, b.kind) else "int" if a.kind == b.kind == "int" else "float"


def _floor_divide(a: Column, b: Column, kind: str) -> Column:
    if kind == "int":
        return F.when(b != 0, F.call_function("div", a - F.when(b != 0, floored_mod(a, b)), F.when(b != 0, b)))
    q = float_divide(a, b)
    return F.when(F.abs(q) < 2.0**62, F.floor(F.when(F.abs(q) < 2.0**62, q)).cast("double")).otherwise(q)


def arithmetic(op: type, a: Value, b: Value) -> Value:
    kind, x, y = _numeric(a, b), number(a), number(b)
    if op in (ast.Div, ast.Pow):
        return Value(float_divide(x, y) if op is ast.Div else F.pow(x, y), "float")
    if op is ast.FloorDiv:
        return Value(_floor_divide(x, y, kind), kind)
    if op is ast.Mod:
        return Value(floored_mod(x, y), kind)
    return Value({ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[op](x, y), kind)


def equal(a: Value, b: Value) -> Column:
    if "nil" in (a.kind, b.kind):
        return is_nil(b if a.kind == "nil" else a)
    if "variant" not in (a.kind, b.kind):
        if "unknown" in (a.kind, b.kind) or _SAME.get(a.kind, a.kind) == _SAME.get(b.kind, b.kind):
            return a.column.eqNullSafe(b.column)
        return is_nil(a) & is_nil(b)
    x, y = (Value(as_variant(v), "variant") for v in (a, b))
    long, logical = (lambda v: _got(v.column, "long", "BIGINT")), (lambda v: _got(v.column, "boolean", "BOOLEAN"))
    same = F.coalesce(long(x) == long(y), number(x, False) == number(y, False), text(x, False) == text(y, False), logical(x) == logical(y))
    return F.coalesce(same, is_nil(x) & is_nil(y))


def ordered(op: type, a: Value, b: Value) -> Column:
    by = {ast.Lt: lambda x, y: x < y, ast.LtE: lambda x, y: x <= y, ast.Gt: lambda x, y: x > y, ast.GtE: lambda x, y: x >= y}[op]
    if "variant" not in (a.kind, b.kind):
        known = "unknown" in (a.kind, b.kind) or a.kind == b.kind or {a.kind, b.kind} == {"int", "float"}
        return by(a.column, b.column) if known else F.lit(None).cast("boolean")
    return F.coalesce(by(number(a, False), number(b, False)), by(text(a, False), text(b, False)))


def one_of(choices: list[tuple[Column, Value]], last: Value) -> Value:
    """The first choice whose condition holds, else the last: of their common kind, or a variant."""
    kinds = {v.kind for _, v in choices} | {last.kind}
    kinds -= {"nil"} if len(kinds) > 1 else set()
    if kinds == {"int", "float"}:
        to, kind = (lambda v: number(v).cast("double") if v.kind != "nil" else v.column.cast("double")), "float"
    elif len(kinds) == 1 or "unknown" in kinds:
        to, kind = (lambda v: v.column), next(iter(kinds - {"unknown"}), "unknown")
    else:
        to, kind = as_variant, "variant"
    out = to(last)
    for holds, v in reversed(choices):
        out = F.when(holds, to(v)).otherwise(out)
    return Value(out, kind)


#: Functions of numbers and of texts, by name: Column function, and the kind of the result (None: that of the argument).
NUMBER_FUNCTIONS: dict[str, tuple[Callable[..., Column], str | None]] = {
    "abs": (F.abs, None), "ceil": (F.ceil, "int"), "floor": (F.floor, "int"), "max": (lambda *c: F.greatest(*c) if len(c) > 1 else c[0], None), "min": (lambda *c: F.least(*c) if len(c) > 1 else c[0], None),
    "sqrt": (F.sqrt, "float"), "exp": (F.exp, "float"), "sin": (F.sin, "float"), "cos": (F.cos, "float"), "tan": (F.tan, "float"), "log": (F.log, "float"),
}
CONSTANTS = {"pi": (math.pi, "float"), "huge": (math.inf, "float"), "maxinteger": (2**63 - 1, "int"), "mininteger": (-(2**63), "int")}


def _part(c: Column, begin: Column, end: Column) -> Column:
    """Bytes from begin to end, both counted from 1, or from the end where negative."""
    size = F.octet_length(c)
    a = F.greatest(F.when(begin < 0, size + begin + 1).otherwise(begin), F.lit(1))
    b = F.least(F.when(end < 0, size + end + 1).otherwise(end), size)
    return F.when(a > b, "").otherwise(F.decode(F.substring(F.encode(c, "UTF-8"), a.cast("int"), (b - a + 1).cast("int")), "UTF-8"))


def _text_function(name: str, args: list[Value]) -> Value | None:
    if not args:
        return None
    c = text(args[0])
    if name in ("lower", "upper", "reverse", "trim") and len(args) == 1:
        return Value({"lower": F.lower, "upper": F.upper, "reverse": F.reverse, "trim": lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))}[name](c), "string")
    if name == "len" and len(args) == 1:
        return Value(F.octet_length(c).cast("long"), "int")
    if name == "sub" and len(args) in (2, 3):
        return Value(_part(c, number(args[1]), number(args[2]) if len(args) == 3 else F.lit(-1)), "string")
    return None


def _size(v: Value) -> Value:
    """#v: bytes of a text, entries of a table."""
    if v.kind == "table":
        return Value(F.when(v.column.isNotNull(), F.size(v.column)).cast("long"), "int")
    if v.kind == "variant":
        items = F.size(_got(v.column, "array<variant>", "ARRAY"))
        return Value(F.coalesce(F.octet_length(text(v, False)), F.when(_holds_kind(v.column, "ARRAY"), items)).cast("long"), "int")
    return Value(F.octet_length(text(v) if v.kind in ("string", "unknown") else F.lit(None).cast("string")).cast("long"), "int")


def _general_function(name: str, args: list[Value]) -> Value | None:
    if len(args) != 1:
        return None
    (v,) = args
    if name == "tostring":
        simple = {"nil": F.lit("nil"), "boolean": F.coalesce(v.column.cast("string"), F.lit("nil"))}
        if v.kind in simple:
            return Value(simple[v.kind], "string")
        if v.kind == "variant":
            return Value(F.when(is_nil(v), "nil").otherwise(F.try_variant_get(v.column, "$", "string")), "string")
        return Value(F.coalesce(v.column.cast("string"), F.lit("nil")), "string")
    if name == "tonumber":
        return Value(number(v).try_cast("double"), "float")
    if name == "tointeger":
        n = number(v)
        return Value(F.when(n == F.floor(n), F.floor(n)), "int")
    if name == "type":
        named = {"boolean": "boolean", "int": "number", "float": "number", "string": "string", "table": "table"}
        if v.kind in named:
            return Value(F.when(v.column.isNull(), "nil").otherwise(named[v.kind]), "string")
        if v.kind == "nil":
            return Value(F.lit("nil"), "string")
        if v.kind == "variant":
            found = F.when(is_nil(v), "nil").when(_holds_kind(v.column, *_NUMBERS), "number").when(_holds_kind(v.column, "STRING"), "string").when(_holds_kind(v.column, "BOOLEAN"), "boolean")
            return Value(found.otherwise("table"), "string")
    return None


# -- compilation --


def _text(source: str) -> str:
    """The expression with its operators in Python's spelling and precedence; quoted parts stay as they are."""
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", source.removeprefix("="))
    for i in range(0, len(parts), 2):
        p = parts[i].replace("~=", "!=")
        if re.search(r"[~&|+]\s*[~&|+]|[~&|@]|<<|>>|!(?!=)|(?<![!<>=])=(?!=)", p):
            raise ValueError(f"not allowed in an expression: {source[:80]}")
        # joining stands below sums and above comparisons, as `|` does; not and # stand with the sign, as `~` and a leading `+` do
        p = re.sub(r"\bnot\b", "~", p.replace("^", "**").replace("..", " | ").replace("#", "+"))
        p = re.sub(r":\s*([A-Za-z_]\w*)\s*\(", r".\1(", p)
        parts[i] = re.sub(r"\bnil\b", "None", re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", p)))
    return "".join(parts).strip()


def _field(n: ast.AST, columns: list[str]) -> str | None:
    """The field of self that a node names, by name or position."""
    if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
        return n.attr
    if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id == "self" and isinstance(n.slice, ast.Constant):
        at = n.slice.value
        if isinstance(at, int) and not isinstance(at, bool):
            if not 1 <= at <= len(columns):
                raise ValueError(f"self[{at}]: there are {len(columns)} columns")
            return columns[at - 1]
        return at
    return None


def _dotted(n: ast.AST) -> str | None:
    """a.b.c of a chain of names."""
    if isinstance(n, ast.Name):
        return n.id
    head = _dotted(n.value) if isinstance(n, ast.Attribute) else None
    return f"{head}.{n.attr}" if head else None


def references(source: str, columns: list[str] = ()) -> set[str]:
    """Fields of self that an expression names; columns: what positions mean."""
    return {f for n in ast.walk(ast.parse(_text(source), mode="eval")) if (f := _field(n, list(columns))) is not None}


def compile_value(source: str, names: dict[str, Column] | None = None, kinds: dict[str, T.DataType] | None = None) -> Value:
    """A Column and its kind. names: what published contexts offer, dotted; kinds: the types of self's fields in their order (without them a field is taken as it stands, and as a boolean by and, or and not)."""
    columns = [k for k in kinds or {} if k != "_line"]

    def go(n: ast.AST) -> Value:
        if isinstance(n, ast.Constant) and (n.value is None or type(n.value) in (int, float, str, bool)):
            return Value(F.lit(n.value), {type(None): "nil", bool: "boolean", int: "int", float: "float", str: "string"}[type(n.value)])
        if (name := _field(n, columns)) is not None:
            return Value(F.col(f"`{name}`"), kind_of(kinds[name]) if kinds and name in kinds else "unknown")
        dotted = _dotted(n)
        if dotted and names and dotted in names:
            return Value(names[dotted], "unknown")
        if dotted and dotted.startswith("math.") and dotted[5:] in CONSTANTS:
            value, kind = CONSTANTS[dotted[5:]]
            return Value(F.lit(value), kind)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.BitOr):
            return Value(F.concat(text(go(n.left)), text(go(n.right))), "string")
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow)):
            return arithmetic(type(n.op), go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            v = go(n.operand)
            return Value(-number(v), v.kind if v.kind in ("int", "unknown") else "float")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Invert):
            return Value(~truth(go(n.operand)), "boolean")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd):
            return _size(go(n.operand))
        if isinstance(n, ast.BoolOp):
            return both(n.values) if isinstance(n.op, ast.And) else either(n.values)
        if isinstance(n, ast.Compare):
            out = go(n.left)
            for op, right in zip(n.ops, map(go, n.comparators), strict=True):  # from the left: the first answer is what the second is compared with
                if isinstance(op, (ast.Eq, ast.NotEq)):
                    out = Value(equal(out, right) if isinstance(op, ast.Eq) else ~equal(out, right), "boolean")
                elif isinstance(op, (ast.Lt, ast.LtE, ast.Gt, ast.GtE)):
                    out = Value(ordered(type(op), out, right), "boolean")
                else:
                    raise ValueError(f"not allowed in an expression: {source[:80]}")
            return out
        if isinstance(n, ast.Call) and not n.keywords:
            return call(n)
        raise ValueError(f"not allowed in an expression: {ast.dump(n)[:80]}")

    def call(n: ast.Call) -> Value:
        name = _dotted(n.func) or ""
        library, _, short = name.rpartition(".")
        args = None
        if library in ("", "math", "string", "stringUtils") and not (library and names and library in names):
            args = list(map(go, n.args))
        elif isinstance(n.func, ast.Attribute):  # text:upper()
            short, library, args = n.func.attr, "string", [go(n.func.value), *map(go, n.args)]
        out = None
        if args and library in ("", "math") and short in NUMBER_FUNCTIONS:
            function, kind = NUMBER_FUNCTIONS[short]
            own = {a.kind for a in args}
            own = "int" if own == {"int"} else "unknown" if "unknown" in own else "float"
            out = Value(function(*map(number, args)), kind or own)
        if out is None and args and library in ("", "string", "stringUtils"):
            out = _text_function(short, args)
        if out is None and args and library in ("", "math"):
            out = _general_function(short, args)
        if out is None:
            raise ValueError(f"not allowed in an expression: {ast.unparse(n)[:80]}")
        return out

    def both(nodes: list[ast.AST]) -> Value:
        """The first value that does not hold, else the last."""
        values = [go(n) for n in nodes]
        *first, last = values
        if all(v.kind in ("boolean", "unknown") for v in values):
            return Value(reduce(lambda a, b: a & b, map(truth, values)), "boolean")
        false = lambda v: Value(F.lit(False), "boolean") if v.kind in ("boolean", "variant", "unknown") else Value(F.lit(None), "nil")
        choices = []
        for v in first:
            if v.kind in ("variant", "boolean"):
                choices.append((is_nil(v), Value(F.lit(None), "nil")))
            choices.append((~truth(v), false(v)))
        return one_of(choices, last)

    def holding(n: ast.AST) -> list[tuple[Column, Value]]:
        """The values a node can have where it holds: what it is where it does not is of no interest to an or."""
        if isinstance(n, ast.BoolOp) and isinstance(n.op, ast.And):
            values = [go(v) for v in n.values]
            return [(reduce(lambda a, b: a & b, map(truth, values)), values[-1])]
        if isinstance(n, ast.BoolOp):
            return [x for v in n.values for x in holding(v)]
        v = go(n)
        return [(truth(v), v)]

    def either(nodes: list[ast.AST]) -> Value:
        """The first value that holds, else the last."""
        last, choices = go(nodes[-1]), [x for n in nodes[:-1] for x in holding(n)]
        if last.kind in ("boolean", "unknown") and all(v.kind in ("boolean", "unknown") for _, v in choices):
            return Value(reduce(lambda a, b: a | b, [c for c, _ in choices]) | truth(last), "boolean")
        return one_of(choices, last)

    return go(ast.parse(_text(source), mode="eval").body)


def compile_expression(source: str, names: dict[str, Column] | None = None, kinds: dict[str, T.DataType] | None = None, to: T.DataType | None = None) -> Column:
    """The Column of compile_value(), as the type `to` if one is given: what does not fit it is null."""
    v = compile_value(source, names, kinds)
    return v.column if to is None else converted(v, to)


def in_order(expressions: dict[str, str], columns: list[str] = ()) -> list[str]:
    """Names of derived columns so that each comes after those it refers to; a cycle is an error."""
    left = {k: references(v, columns) & set(expressions) for k, v in expressions.items()}
    done: list[str] = []
    while left:
        ready = [k for k, need in left.items() if need <= set(done)]
        if not ready:
            raise ValueError(f"expressions refer to each other: {', '.join(sorted(left))}")
        done += ready
        for k in ready:
            del left[k]
    return done


def derive(df: DataFrame, expressions: dict[str, str], names: dict[str, Column] | None = None) -> DataFrame:
    """df with each derived column; a column that is there keeps its own values where they are not null (the expression is its default, of its type)."""
    for name in in_order(expressions, [c for c in df.columns if c != "_line"]):
        kinds = {f.name: f.dataType for f in df.schema}
        value = compile_expression(expressions[name], names, kinds, kinds.get(name))
        df = df.withColumn(name, F.coalesce(F.col(f"`{name}`"), value) if name in kinds else value)
    return df
