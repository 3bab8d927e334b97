"""String functions as Columns. Lengths are bytes and white space is ASCII, as in the table formats read here."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SPACES = " \t\n\x0b\f\r"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def split(c: Column, delimiter: str = "\t") -> Column:
    """Parts between literal delimiters; at least one, empty ones kept."""
    quoted = "".join("\\" + ch if not ch.isalnum() and ch != "_" and ord(ch) < 128 else ch for ch in delimiter)
    return F.split(c, quoted, -1)


def unix_eol(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def escape_text(c: Column) -> Column:
    """Line ends to LF, then backslash, tab and LF to two-character escapes."""
    c = F.replace(unix_eol(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape_text(c: Column) -> Column:
    """The inverse of escape_text; a backslash before any other character stands for that character. Line ends become LF.

    Doubled backslashes are cut out first, so that an escaped backslash before a t stays one."""

    def plain(part: Column) -> Column:
        part = F.replace(F.replace(part, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
        return F.regexp_replace(part, "(?s)\\\\(.)", "$1")

    return F.when(c.contains("\\"), unix_eol(F.array_join(F.transform(F.split(c, "\\\\\\\\"), plain), "\\"))).otherwise(unix_eol(c))


def string_to_identifier(c: Column) -> Column:
    """"_" and the text, each byte of a character other than ASCII letters, digits and "_" as 0xXX."""

    def one(ch: Column) -> Column:
        return F.when(ch.rlike("^[A-Za-z0-9_]$"), ch).otherwise(F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "0x$1"))

    return F.concat(F.lit("_"), F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), one), ""))


def number_to_identifier(c: Column) -> Column:
    """_I5, _I_5, _F1_5, _NaN, _Infinity, __Infinity for a double."""
    text = F.when(c == F.floor(c), F.concat(F.lit("I"), F.floor(c).cast("string"))).otherwise(F.concat(F.lit("F"), c.cast("string")))
    return (
        F.when(F.isnan(c), "_NaN")
        .when(c == float("inf"), "_Infinity")
        .when(c == float("-inf"), "__Infinity")
        .otherwise(F.concat(F.lit("_"), F.translate(text, "-.", "__")))
    )


def identifier_to_number(c: Column) -> Column:
    """The inverse of number_to_identifier, null where the text is none."""
    whole = F.replace(F.regexp_extract(c, "^_I(_?[0-9]+)$", 1), F.lit("_"), F.lit("-"))
    real = F.concat(F.replace(F.regexp_extract(c, "^_F(_?)[0-9]+_[0-9]+$", 1), F.lit("_"), F.lit("-")), F.regexp_replace(F.regexp_extract(c, "^_F_?([0-9]+_[0-9]+)$", 1), "_", "."))
    return (
        F.when(c == "_NaN", float("nan")).when(c == "_Infinity", float("inf")).when(c == "__Infinity", float("-inf")).when(whole != "", whole.try_cast("double")).otherwise(F.nullif(real, F.lit("")).try_cast("double"))
    )


def range_to_identifier(low: Column, high: Column) -> Column:
    """_R_GE_<low>_LE_<high>; an open bound is left out."""
    return F.concat(F.lit("_R"), F.coalesce(F.concat(F.lit("_GE"), number_to_identifier(low)), F.lit("")), F.coalesce(F.concat(F.lit("_LE"), number_to_identifier(high)), F.lit("")))


def identifier_to_range(c: Column) -> Column:
    """struct<low, high> of range_to_identifier()."""
    low = F.regexp_extract(c, "^_R(?:_GE(_[IF]_?[0-9_]+?))?(?:_LE(_.*))?$", 1)
    high = F.regexp_extract(c, "^_R(?:_GE(_[IF]_?[0-9_]+?))?(?:_LE(_.*))?$", 2)
    return F.struct(identifier_to_number(low).alias("low"), identifier_to_number(high).alias("high"))


def longest_matching_prefix(candidates: Column, c: Column) -> Column:
    """The longest of the candidates with which the text begins, "" if none does."""
    fits = F.filter(candidates, lambda p: F.startswith(c, p))
    return F.aggregate(fits, F.lit(""), lambda best, p: F.when(F.octet_length(p) > F.octet_length(best), p).otherwise(best))


def strip_fences(c: Column) -> Column:
    """Markdown code fences around a JSON text taken away, then trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(trim(c), "^```[A-Za-z]*[ \t]*\n?", ""), "\n?[ \t]*```$", ""))


def osa(a: str, b: str, most: int | None = None) -> int:
    """Edit distance over bytes in which swapping neighbours counts 1 (optimal string alignment)."""
    x, y = a.encode(), b.encode()
    if most is not None and abs(len(x) - len(y)) > most:
        return most + 1
    before, row = [], list(range(len(y) + 1))
    for i in range(1, len(x) + 1):
        new = [i]
        for j in range(1, len(y) + 1):
            cost = x[i - 1] != y[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + cost)
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


@F.pandas_udf(IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def default_max_distance(c: Column) -> Column:
    return F.least(F.lit(3), F.floor(F.octet_length(c) / 4).cast("int") + 1)


def closest_match(c: Column, candidates: list[str], max_distance: int | None = None) -> Column:
    """The candidate of least edit distance within the maximum (default min(3, bytes / 4 + 1)); the first one wins ties. Null if none."""

    @F.pandas_udf("string")
    def nearest(values: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        out = []
        for v in values:
            if v is not None and v not in known:
                most = max_distance if max_distance is not None else min(3, len(v.encode()) // 4 + 1)
                d, at = min(((osa(v, x, most), k) for k, x in enumerate(candidates)), default=(most + 1, 0))
                known[v] = candidates[at] if d <= most else None
            out.append(known.get(v))
        return pd.Series(out, dtype="object")

    return nearest(c)


def did_you_mean(c: Column, candidates: list[str], max_distance: int | None = None) -> Column:
    """A suffix for messages: " (did you mean 'x'?)", or ""."""
    found = closest_match(c, candidates, max_distance)
    return F.coalesce(F.concat(F.lit(" (did you mean '"), found, F.lit("'?)")), F.lit(""))


VERSION = "^([0-9]+)\\.([0-9]+)\\.([0-9]+)\\z"


def parse_version(c: Column) -> Column:
    """struct<major, minor, patch> of X.Y.Z, else null."""
    part = lambda k: F.regexp_extract(c, VERSION, k).try_cast("int")
    return F.when(c.rlike(VERSION), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def version_satisfies(op: str, required: Column, installed: Column) -> Column:
    """Whether an installed version struct meets `op required`: = == > >= < <= ~ (same minor, patch at least) ^ (compatible)."""
    r, i = required, installed
    if op in ("=", "=="):
        return i == r
    if op in (">", ">=", "<", "<="):
        return {">": i > r, ">=": i >= r, "<": i < r, "<=": i <= r}[op]
    same_minor = (i["major"] == r["major"]) & (i["minor"] == r["minor"])
    if op == "~":
        return same_minor & (i["patch"] >= r["patch"])
    if op == "^":
        return (i >= r) & F.when(r["major"] > 0, i["major"] == r["major"]).when(r["minor"] > 0, same_minor).otherwise(i == r)
    raise ValueError(f"unknown version operator {op}")


# -- patterns of the table format -------------------------------------------------

#: Character classes of the pattern language and what they are in Java's.
CLASSES = {"a": "A-Za-z", "c": "\\x00-\\x1F\\x7F", "d": "0-9", "g": "!-~", "l": "a-z", "p": "!-/:-@\\[-`{-~", "s": " \\t\\n\\x0B\\f\\r", "u": "A-Z", "w": "A-Za-z0-9", "x": "0-9A-Fa-f"}


def _others(body: str) -> str:
    """The complement of a character class, written out, so that it can stand in a set with others."""
    inside = re.compile(f"[{body}]")
    codes = [k for k in range(128) if not inside.match(chr(k))]
    runs = [(k, next(m for m in range(k, 129) if m not in codes) - 1) for k in codes if k - 1 not in codes]
    return "".join(f"\\x{a:02X}-\\x{b:02X}" for a, b in runs) + "\\x{80}-\\x{10FFFF}"


def pattern_parts(pattern: str) -> list[str]:
    """The alternatives of a multi-pattern: cut at "|" unless written "%|"."""
    parts, at = [""], 0
    while at < len(pattern):
        if pattern[at] == "%" and at + 1 < len(pattern):
            parts[-1] += pattern[at : at + 2]
            at += 2
            continue
        if pattern[at] == "|":
            parts.append("")
        else:
            parts[-1] += pattern[at]
        at += 1
    if "" in parts:
        raise ValueError("empty alternative in a pattern")
    return parts


def pattern_to_regex(pattern: str) -> str:
    """A single pattern as a Java regular expression; frontier, balance and back-references are refused."""
    out, at, n = [], 0, len(pattern)
    inside = False
    while at < n:
        ch = pattern[at]
        if ch == "%":
            if at + 1 >= n:
                raise ValueError("a pattern ends in %")
            x = pattern[at + 1]
            if x in "bf" or x.isdigit():
                raise ValueError(f"%{x} has no regular expression")
            if x.lower() in CLASSES:
                body = CLASSES[x.lower()]
                if x.islower():
                    out.append(body if inside else f"[{body}]")
                else:
                    out.append(f"[^{body}]" if not inside else _others(body))
            else:
                out.append("\\" + x if not x.isalnum() else x)
            at += 2
            continue
        if inside:
            if ch == "]":
                inside = False
            out.append(ch if ch in "]-^" else "\\" + ch if ch in "[&\\~" else ch)
        elif ch == "[":
            inside = True
            out.append("[")
            if pattern[at + 1 : at + 2] == "^":
                out.append("^")
                at += 1
        elif ch == "-":
            out.append("*?")
        elif ch in "*+?().":
            out.append(ch)
        elif ch == "^":
            out.append("^" if at == 0 else "\\^")
        elif ch == "$":
            out.append("\\z" if at == n - 1 else "\\$")
        else:
            out.append("\\" + ch if ch in "\\{}|" else ch)
        at += 1
    return "(?s)" + "".join(out)


def matches_any(c: Column, pattern: str) -> Column:
    """Whether one of a multi-pattern's alternatives occurs in the text."""
    return c.rlike("|".join(f"(?:{pattern_to_regex(p)})" for p in pattern_parts(pattern)))
