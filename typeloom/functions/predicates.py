"""Predicates as Columns: true or false for every value, false for null unless a predicate says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NumericType, StringType, StructType

#: File names that some systems reserve, whatever their extension. Fixed values.
RESERVED_FILES = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def truthy(c: Column, kind: DataType | None = None) -> Column:
    """Only null and false are false: 0 and "" hold."""
    return _sure(c) if kind is None or isinstance(kind, BooleanType) else c.isNotNull()


def is_identifier(c: Column) -> Column:
    return _sure(c.rlike("^[A-Za-z_][A-Za-z0-9_]*\\z") & (c != "_"))


def is_name(c: Column) -> Column:
    """Identifiers joined by dots."""
    return _sure(c.rlike("^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*\\z") & ~c.rlike("(^|\\.)_(\\.|\\z)"))


def is_non_empty(c: Column) -> Column:
    return _sure(F.octet_length(c) > 0)


def is_blank(c: Column) -> Column:
    return _sure(F.btrim(c, F.lit(" \t\n\x0b\f\r")) == "")


def is_non_blank(c: Column) -> Column:
    return _sure(F.btrim(c, F.lit(" \t\n\x0b\f\r")) != "")


def is_non_zero(c: Column) -> Column:
    return _sure(c != 0)


def is_positive(c: Column) -> Column:
    return _sure(c > 0)


def is_integer_value(c: Column) -> Column:
    return _sure((c == F.floor(c)) & ~F.isnan(c.cast("double")))


def is_default(c: Column, kind: DataType) -> Column:
    """null, false, 0, "" or an empty container."""
    if isinstance(kind, BooleanType):
        return ~_sure(c)
    if isinstance(kind, NumericType):
        return F.coalesce(c == 0, F.lit(True))
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.size(c) <= 0, F.lit(True))
    return F.coalesce(c == "", F.lit(True)) if isinstance(kind, StringType) else c.isNull()


def is_version(c: Column) -> Column:
    return _sure(c.rlike("^[0-9]+\\.[0-9]+\\.[0-9]+\\z"))


def is_file_name(c: Column) -> Column:
    """Not empty, no separator, none of <>:"|?*, no reserved base name, no three dots, no dot or blank at the end."""
    base = F.upper(F.coalesce(F.nullif(F.regexp_extract(c, "^([^.]+)", 1), F.lit("")), c))
    return _sure((c != "") & ~c.rlike("[/\\\\<>:\"|?*]") & ~base.isin(RESERVED_FILES) & ~c.contains("...") & ~c.rlike("[. ]\\z"))


def is_path(c: Column) -> Column:
    """File names joined by "/"; one "/" may end it."""
    return _sure(F.forall(F.split(F.regexp_replace(c, "/\\z", ""), "/"), is_file_name))


def is_qualified_path(c: Column) -> Column:
    """A path, with or without `package:` before it."""
    rest = F.regexp_extract(c, "(?s)^[^:/\\\\]+:(.+)$", 1)
    return F.when(rest != "", is_path(rest)).otherwise(is_path(c))


def is_value_keyword(c: Column) -> Column:
    return _sure(c.isin("nil", "true", "false"))


def is_reserved_name(c: Column) -> Column:
    return _sure(c == "self")


def is_tuple_field(c: Column) -> Column:
    return _sure(c.rlike("^_[0-9]+\\z"))


def is_percent(c: Column) -> Column:
    """A number with "%", or a ratio of integers whose divisor has no sign and is not 0."""
    return _sure(c.rlike("^-?[0-9]+(\\.[0-9]+)?%\\z") | (c.rlike("^-?[0-9]+/[0-9]+\\z") & ~c.rlike("/0+\\z")))


def is_http_url(c: Column) -> Column:
    """http or https, a host with a dot, perhaps a port, and a plain path, query and fragment."""
    shape = "^https?://[A-Za-z0-9._-]+\\.[A-Za-z0-9]+(:?[0-9]*)/?[A-Za-z0-9./?=&_#-]*\\z"
    port = F.regexp_extract(c, shape, 1)
    return _sure(c.rlike(shape) & ((port == "") | port.rlike(":[0-9]")))


def is_ascii(c: Column) -> Column:
    return _sure(F.octet_length(c) == F.char_length(c))


def is_utf8(c: Column) -> Column:
    return _sure(F.is_valid_utf8(c))


def is_true(c: Column) -> Column:
    return c.eqNullSafe(True)


def is_false(c: Column) -> Column:
    return c.eqNullSafe(False)


def is_non_default(c: Column, kind: DataType) -> Column:
    return ~is_default(c, kind)


def is_non_zero_integer(c: Column) -> Column:
    return is_integer_value(c) & is_non_zero(c)


def is_positive_integer(c: Column) -> Column:
    return is_integer_value(c) & is_positive(c)


def is_non_empty_container(c: Column) -> Column:
    """An array or map with entries."""
    return _sure(F.size(c) > 0)


def is_full_sequence(keys: Column) -> Column:
    """Whether the keys of a map (an array of numbers) are 1 to n without a gap."""
    n = F.size(keys)
    return _sure((n == 0) | ((F.array_min(keys) == 1) & (F.array_max(keys) == n) & (F.size(F.array_distinct(keys)) == n)))


def is_mixed(keys: Column) -> Column:
    """Whether the keys of a map (an array of texts) hold 1, 2, ... and others beside them."""
    def run(n: Column, k: Column) -> Column:
        return F.when(F.array_contains(keys, (n + 1).cast("string")), n + 1).otherwise(n)

    sequence = F.aggregate(keys, F.lit(0), run)
    return _sure((sequence > 0) & (F.size(keys) > sequence))


def is_pattern(c: Column) -> Column:
    """Whether a text is a pattern of the table format: brackets closed, no single % at its end."""
    plain = F.regexp_replace(c, "(?s)%.", "")
    sets = F.regexp_replace(plain, "(?s)\\[\\^?\\]?[^\\]]*\\]", "")
    depth = F.aggregate(F.split(F.regexp_replace(sets, "(?s)[^()]", ""), ""), F.lit(0), lambda d, x: F.when(d < 0, d).when(x == "(", d + 1).when(x == ")", d - 1).otherwise(d))
    return _sure(~plain.endswith("%") & ~sets.contains("[") & (depth == 0))


# -- facts of a type, known without looking at a value --


def kind_is_basic(kind: DataType) -> bool:
    return not isinstance(kind, (ArrayType, MapType, StructType))


def kind_is_integer(kind: DataType) -> bool:
    return isinstance(kind, IntegralType)


def kind_is_table(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType))


def kind_is_string(kind: DataType) -> bool:
    return isinstance(kind, StringType)


def kind_is_boolean(kind: DataType) -> bool:
    return isinstance(kind, BooleanType)


def kind_is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def kind_is_comparable(kind: DataType) -> bool:
    return isinstance(kind, (StringType, NumericType))
