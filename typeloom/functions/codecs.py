"""Value codecs beyond Spark's own: MessagePack, and table literals.

Both go through JSON text, which Spark makes from any column (to_json) and reads into any type (from_json); integers stay exact.
Table literals: {1,2,key="text"}, the sequence part first, keyed entries sorted as text; nesting is bounded by MAX_DEPTH. Common literals are made and read by Spark
expressions; only values that these cannot spell, and texts beyond their grammar, go to Python.
"""

from __future__ import annotations

import json
import re
import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegralType, StringType, StructType

MAX_DEPTH = 10
_NAME = re.compile(r"^[A-Za-z_]\w*$")
_TOKEN = re.compile(r"\s*(?:(-?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?))|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|([{}\[\]=,;]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


# -- MessagePack --


def pack(v) -> bytes:
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128:
            return bytes([v])
        if -32 <= v < 0:
            return struct.pack("b", v)
        for code, form, low, high in ((0xCC, ">B", 0, 2**8), (0xCD, ">H", 0, 2**16), (0xCE, ">I", 0, 2**32), (0xCF, ">Q", 0, 2**64), (0xD0, ">b", -(2**7), 0), (0xD1, ">h", -(2**15), 0), (0xD2, ">i", -(2**31), 0), (0xD3, ">q", -(2**63), 0)):
            if low <= v < high:
                return bytes([code]) + struct.pack(form, v)
        raise ValueError(f"{v} has more than 64 bits")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, (str, bytes)):
        raw = v.encode() if isinstance(v, str) else v
        n = len(raw)
        text = isinstance(v, str)
        if text and n < 32:
            return bytes([0xA0 | n]) + raw
        for code, form, high in ((0xD9 if text else 0xC4, ">B", 2**8), (0xDA if text else 0xC5, ">H", 2**16), (0xDB if text else 0xC6, ">I", 2**32)):
            if n < high:
                return bytes([code]) + struct.pack(form, n) + raw
    n = len(v)
    small, mid, large = (0x90, 0xDC, 0xDD) if isinstance(v, list) else (0x80, 0xDE, 0xDF)
    head = bytes([small | n]) if n < 16 else bytes([mid]) + struct.pack(">H", n) if n < 2**16 else bytes([large]) + struct.pack(">I", n)
    if isinstance(v, list):
        return head + b"".join(map(pack, v))
    return head + b"".join(pack(k) + pack(v[k]) for k in sorted(v))


def unpack(data: bytes):
    at = 0

    def take(form: str):
        nonlocal at
        out = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
        return out

    def raw(n: int) -> bytes:
        nonlocal at
        at += n
        if at > len(data):
            raise ValueError("truncated")
        return data[at - n : at]

    def value():
        c = take("B")
        if c < 0x80:
            return c
        if c >= 0xE0:
            return c - 256
        if c < 0x90:
            return {value(): value() for _ in range(c & 15)}
        if c < 0xA0:
            return [value() for _ in range(c & 15)]
        if c < 0xC0:
            return raw(c & 31).decode()
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c]
        numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
        if c in numbers:
            return take(numbers[c])
        sizes = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
        if c not in sizes:
            raise ValueError(f"unknown type byte {c:#x}")
        n = take(sizes[c])
        if c <= 0xC6:
            return raw(n)
        if c <= 0xDB:
            return raw(n).decode()
        return [value() for _ in range(n)] if c <= 0xDD else {value(): value() for _ in range(n)}

    out = value()
    if at != len(data):
        raise ValueError("bytes left over")
    return out


@F.pandas_udf(BinaryType())
def _pack_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else pack(json.loads(t)))


@F.pandas_udf(StringType())
def _unpack_json(data: pd.Series) -> pd.Series:
    def one(b):
        try:
            return None if b is None else json.dumps(unpack(bytes(b)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, struct.error, IndexError, TypeError):
            return None

    return data.map(one)


def to_msgpack(c: Column) -> Column:
    """MessagePack of a struct, array or map; keys sorted."""
    return _pack_json(F.to_json(c))


def from_msgpack(c: Column) -> Column:
    """JSON text of MessagePack bytes; null where they are none."""
    return _unpack_json(c)


def sql_blob(c: Column) -> Column:
    return F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("X'"), F.hex(c), F.lit("'")))


def from_sql_blob(c: Column) -> Column:
    return F.unhex(F.nullif(F.regexp_extract(c, "^[Xx]'((?:[0-9A-Fa-f]{2})*)'\\z", 1), F.lit("")))


# -- table literals --


def literal(v, depth: int = 0) -> str:
    if depth > MAX_DEPTH:
        raise ValueError("nested too deeply")
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        text = v.replace("\\", "\\\\").replace('"', '\\"')
        return '"' + text.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if isinstance(v, list):
        return "{" + ",".join(literal(x, depth + 1) for x in v) + "}"
    return "{" + ",".join(sorted((k if _NAME.match(k) else f"[{literal(k)}]") + "=" + literal(x, depth + 1) for k, x in v.items())) + "}"


def parse_literal(text: str):
    """The value of a literal: a list, a dict with text keys (indices where items and keys are mixed), or a scalar."""
    tokens, at = [], 0
    body = text.rstrip()
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m:
            raise ValueError(f"bad literal at {at}")
        tokens.append(m)
        at = m.end()
    i = 0

    def symbol(s: str) -> bool:
        return i < len(tokens) and tokens[i][4] == s

    def value(depth: int):
        nonlocal i
        if depth > MAX_DEPTH or i >= len(tokens):
            raise ValueError("bad literal")
        m = tokens[i]
        i += 1
        if m[1]:
            return int(m[1], 16) if "x" in m[1].lower() else float(m[1]) if re.search("[.eE]", m[1]) else int(m[1])
        if m[2]:
            return re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[2][1:-1], flags=re.S)
        if m[3]:
            if m[3] not in ("nil", "true", "false"):
                raise ValueError(f"unknown word {m[3]}")
            return {"nil": None, "true": True, "false": False}[m[3]]
        if m[4] != "{":
            raise ValueError("bad literal")
        items, named = [], {}
        while not symbol("}"):
            if symbol("["):
                i += 1
                key = value(depth + 1)
                if isinstance(key, (list, dict)) or key is None or not symbol("]"):
                    raise ValueError("bad key")
                i += 2
                if tokens[i - 1][4] != "=":
                    raise ValueError("= expected")
                named[str(key)] = value(depth + 1)
            elif i + 1 < len(tokens) and tokens[i][3] and tokens[i + 1][4] == "=":
                key = tokens[i][3]
                i += 2
                named[key] = value(depth + 1)
            else:
                items.append(value(depth + 1))
            if symbol(",") or symbol(";"):
                i += 1
            elif not symbol("}"):
                raise ValueError("} expected")
        i += 1
        if not named:
            return items
        return named if not items else {str(n): x for n, x in enumerate(items, 1)} | named

    out = value(0)
    if i < len(tokens):
        raise ValueError("text after the literal")
    return out


@F.pandas_udf(StringType())
def _literal_json(texts: pd.Series) -> pd.Series:
    return texts if texts.isna().all() else texts.map(lambda t: None if t is None else literal(json.loads(t)))


@F.pandas_udf(StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """JSON text of table literals, by Python's parser."""

    def one(t):
        try:
            return None if t is None else json.dumps(parse_literal(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts if texts.isna().all() else texts.map(one)


#: Numbers that Spark, Python and JSON spell alike: at most 15 digits, no exponent.
_DECIMAL = "-?(?!0\\.0000)(?:0|[1-9][0-9]{0,5})\\.(?:0|[0-9]{0,8}[1-9])"
_SCALAR = f'(?:{_DECIMAL}|0|-?[1-9][0-9]{{0,17}}|true|false|"[^"\\\\\\x00-\\x1f]*+")'
_ITEMS = f"^\\{{{_SCALAR}(?:,{_SCALAR})*+\\}}\\z"
#: Keyed entries; a key that comes again behind a brace or comma, even within a text, is left to Python.
_ENTRY = f"([A-Za-z_][A-Za-z0-9_]*+)=(?!.*,\\1=){_SCALAR}"
_ENTRIES = f"^\\{{{_ENTRY}(?:,{_ENTRY.replace(chr(92) + '1', chr(92) + '2')})*+\\}}\\z"
#: Longer texts go to Python: Java's matcher recurs with each entry. Fixed value.
_MATCHED = 1000


def _spelled(c: Column, kind: DataType, depth: int = 0) -> tuple[Column, Column | None] | None:
    """A value's literal (null for null) and where it is right (None: everywhere); None for types that are left to Python."""
    if depth > MAX_DEPTH:
        return None
    if isinstance(kind, (IntegralType, BooleanType)):
        return c.cast("string"), None
    if isinstance(kind, DoubleType):
        return c.cast("string"), c.isNull() | c.cast("string").rlike(f"^{_DECIMAL}\\z")
    if isinstance(kind, StringType):
        text = c
        for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(plain), F.lit(mark))
        return F.concat(F.lit('"'), text, F.lit('"')), None
    if isinstance(kind, ArrayType):
        if _spelled(c, kind.elementType, depth + 1) is None:
            return None
        items = c.cast("array<string>") if isinstance(kind.elementType, (IntegralType, BooleanType, DoubleType)) else F.transform(c, lambda x: _spelled(x, kind.elementType, depth + 1)[0])
        right = None if _spelled(c, kind.elementType, depth + 1)[1] is None else c.isNull() | F.forall(c, lambda x: _spelled(x, kind.elementType, depth + 1)[1])
        return F.concat(F.lit("{"), F.array_join(items, ",", "nil"), F.lit("}")), right
    if isinstance(kind, StructType) and len(set(kind.names)) == len(kind.names):
        fields = sorted((((f.name if _NAME.match(f.name) else f"[{literal(f.name)}]") + "=", f) for f in kind), key=lambda x: x[0])
        found = [(key, _spelled(c.getField(f.name), f.dataType, depth + 1)) for key, f in fields]
        if any(x is None for _, x in found):
            return None
        right = [x[1] for _, x in found if x[1] is not None]
        text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(key), x[0]) for key, x in found]), F.lit("}"))
        return F.when(c.isNotNull(), text), reduce(lambda a, b: a & b, right) if right else None
    return None


def plain_json(c: Column) -> Column:
    """JSON text of literals of plain items or plain keyed entries, without blanks, escapes or nesting; null for all others."""
    short = F.char_length(c) <= _MATCHED
    items = F.concat(F.lit("["), F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit("]"))
    entries = F.regexp_replace(c, '([{,])([A-Za-z_][A-Za-z0-9_]*)=("[^"]*"|[^,}"]*)', '$1"$2":$3')
    return F.when(short & c.rlike(_ITEMS), items).when(short & c.rlike(_ENTRIES), entries)


def to_literal(c: Column, kind: DataType | None = None) -> Column:
    """A struct, array or map as a table literal. With its type, Python is only asked for what Spark spells otherwise."""
    found = _spelled(c, kind) if isinstance(kind, (ArrayType, StructType)) else None
    if found is None:
        return _literal_json(F.to_json(c))
    text, right = found
    return text if right is None else F.when(right, text).otherwise(_literal_json(F.to_json(F.when(~right, c))))


def from_literal(c: Column) -> Column:
    """JSON text of a table literal (for from_json or parse_json); null where the text is none."""
    plain = plain_json(c)
    return F.coalesce(plain, literal_json(F.when(plain.isNull(), c)))
