"""Number functions as Columns: percent texts, exact 64-bit integers, floored division, plain number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(c: Column) -> Column:
    """"150%" -> 1.5, "1/3" -> 0.33...; a bare number n is n / 100 (an error by percent_error()); null otherwise."""
    number = "[+-]?[0-9]+(?:\\.[0-9]+)?"
    a, b = F.regexp_extract(c, f"^({number})/({number})$", 1), F.regexp_extract(c, f"^({number})/({number})$", 2)
    quotient = F.try_divide(a.try_cast("double"), b.try_cast("double"))
    return F.when(c.rlike(f"^{number}%$"), F.regexp_extract(c, f"^({number})%$", 1).try_cast("double") / 100).when(c.rlike(f"^{number}/{number}$"), quotient).when(c.rlike(f"^{number}$"), c.try_cast("double") / 100)


def percent_error(c: Column) -> Column:
    """Whether a text is no percent: neither n% nor a/b with b other than 0."""
    number = "[+-]?[0-9]+(?:\\.[0-9]+)?"
    return ~F.coalesce(c.rlike(f"^{number}%$") | (c.rlike(f"^{number}/{number}$") & percent(c).isNotNull()), F.lit(False))


def floored_mod(a: Column, b: Column) -> Column:
    """a - floor(a / b) * b: the result has the sign of b; null where b is 0."""
    r = F.when(b != 0, a % F.when(b != 0, b))
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def float_divide(a: Column, b: Column) -> Column:
    """Division as doubles: a zero divisor gives an infinity or NaN, never an error."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
    return F.when(y != 0, x / F.when(y != 0, y)).when(y == 0, F.when(x.isNotNull(), zero))


def format_integer(c: Column) -> Column:
    """Digits without an exponent."""
    return c.cast("decimal(38,0)").cast("string")


def plain_number(c: Column) -> Column:
    """Never scientific; at most 14 decimals, trailing zeros taken away; nan, inf and -inf spelled out."""
    text = F.regexp_replace(c.try_cast("decimal(38,14)").cast("string"), "(\\.[0-9]*?)0+$", "$1")
    text = F.regexp_replace(text, "\\.$", "")
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.when(text == "-0", "0").otherwise(text))


# -- exact 64-bit integers: null where a result does not fit --


def int64(c: Column) -> Column:
    return c.try_cast("bigint")


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def negate(a: Column) -> Column:
    return F.try_subtract(F.lit(0).cast("bigint"), a)


def absolute(a: Column) -> Column:
    return F.when(a < 0, negate(a)).otherwise(a)


def sign(a: Column) -> Column:
    return F.when(a < 0, -1).when(a > 0, 1).when(a == 0, 0)


def to_bytes(a: Column) -> Column:
    """8 bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(a), 16, "0"))


def from_bytes(b: Column) -> Column:
    return F.conv(F.hex(b), 16, -10).cast("bigint")


def unsafe_integer(c: Column, limit: int = 2**53) -> Column:
    """Whether a text holds an integer literal of at least 2^53, which a double would not keep."""
    digits = F.regexp_extract_all(c, F.lit("(?<![0-9.A-Za-z_])[0-9]+(?![0-9.A-Za-z_])"), 0)
    return F.exists(digits, lambda d: F.coalesce(d.try_cast("decimal(38,0)") >= F.lit(limit), F.lit(True)))
