"""Row-local operators on streams.

Casts, predicates, expressions, bulk rules and row checks are plain Columns, so they apply to a streaming DataFrame
unchanged; what needs all rows (diffs, row numbers, graphs) is for batch. The one stateful operator here keeps the first row of
each key within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from typeloom.operators.patch import Rule, bulk_patch
from typeloom.operators.validate import Validator, row_violations


def first_rows(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state of keys older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def violations(stream: DataFrame, validators: list[Validator], key: str, source: str = "stream") -> DataFrame:
    return row_violations(stream, validators, key, source)


def patched(stream: DataFrame, rules: list[Rule]) -> DataFrame:
    return bulk_patch(stream, rules)
