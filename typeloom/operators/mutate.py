"""Row and column mutations of one table, each a DataFrame in and a DataFrame out, and a script runner over named tables.

The key is the table's first column. Errors that need no data (an unknown column) are raised at once; those that do
(a key that is there already) are found by the *_problems functions of the patch module or by has_row().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.strings import matches_any


def _known(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise ValueError(f"no column {n}")


def _key(df: DataFrame):
    return F.col(df.columns[0])


# -- rows --


def has_row(df: DataFrame, key) -> bool:
    return not df.where(_key(df) == F.lit(key)).isEmpty()


def get_row(df: DataFrame, key) -> DataFrame:
    return df.where(_key(df) == F.lit(key))


def add_row(df: DataFrame, values: dict) -> DataFrame:
    _known(df, *values)
    row = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(row)


def remove_row(df: DataFrame, key) -> DataFrame:
    return df.where(~F.coalesce(_key(df) == F.lit(key), F.lit(False)))


def copy_row(df: DataFrame, key, new_key) -> DataFrame:
    first = df.columns[0]
    return df.unionByName(get_row(df, key).withColumn(first, F.lit(new_key).cast(df.schema[first].dataType)))


def set_cell(df: DataFrame, key, column: str, value) -> DataFrame:
    _known(df, column)
    return df.withColumn(column, F.when(_key(df) == F.lit(key), F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def set_cells(df: DataFrame, column: str, value) -> DataFrame:
    _known(df, column)
    return df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))


def set_cells_where(df: DataFrame, column: str, value, where_column: str, where_value) -> DataFrame:
    _known(df, column, where_column)
    return df.withColumn(column, F.when(F.col(where_column) == F.lit(where_value), F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def move_cells_matching(df: DataFrame, source: str, target: str, pattern: str) -> DataFrame:
    """Cells of source that match go to target, and leave "" behind; both are computed from the original source."""
    _known(df, source, target)
    if source == target:
        raise ValueError("source and target are one column")
    hit = F.coalesce((F.col(source) != "") & matches_any(F.col(source), pattern), F.lit(False))
    return df.withColumns({target: F.when(hit, F.col(source)).otherwise(F.col(target)), source: F.when(hit, F.lit("")).otherwise(F.col(source))})


def transform_cells(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Each cell replaced by an expression of its row; null keeps the cell. Other rows are seen as they were."""
    _known(df, column)
    return df.withColumn(column, F.coalesce(value.cast(df.schema[column].dataType), F.col(column)))


# -- columns --


def add_column(df: DataFrame, name: str, value: Column, position: int | None = None) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return move_column(df.withColumn(name, value), name, position) if position is not None else df.withColumn(name, value)


def remove_column(df: DataFrame, name: str) -> DataFrame:
    _known(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _known(df, old)
    return df.withColumnRenamed(old, new)


def move_column(df: DataFrame, name: str, position: int | str) -> DataFrame:
    """To a 0-based position, or before ("<other") or after (">other") another column."""
    _known(df, name)
    rest = [c for c in df.columns if c != name]
    at = position if isinstance(position, int) else rest.index(position[1:]) + (position[0] == ">")
    return df.select(*rest[:at], name, *rest[at:])


def copy_column(df: DataFrame, source: str, new: str, position: int | None = None) -> DataFrame:
    _known(df, source)
    return add_column(df, new, F.col(source), position)


def set_column_type(df: DataFrame, name: str, kind: str) -> DataFrame:
    _known(df, name)
    return df.withColumn(name, F.col(name).try_cast(kind))


def set_column_default(df: DataFrame, name: str, default: str) -> DataFrame:
    _known(df, name)
    return df.withMetadata(name, {**df.schema[name].metadata, "default": default})


def split_table(df: DataFrame, keep: list[str], target: list[str]) -> tuple[DataFrame, DataFrame]:
    _known(df, *keep, *target)
    return df.select(*keep), df.select(*target)


# -- scripts --

COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "addRow": add_row, "removeRow": remove_row, "copyRow": copy_row, "setCell": set_cell, "setCells": set_cells, "setCellsWhere": set_cells_where, "moveCellsMatching": move_cells_matching,
    "removeColumn": remove_column, "renameColumn": rename_column, "moveColumn": move_column, "copyColumn": copy_column, "setColumnType": set_column_type, "setColumnDefault": set_column_default,
}


def run_script(tables: dict[str, DataFrame], script: list[tuple]) -> dict[str, DataFrame]:
    """Tables after a script of (command, table, arguments...); stops at the first error. Table commands: copyFile, renameFile, deleteFile, assertColumn."""
    out = dict(tables)
    for n, (command, name, *args) in enumerate(script, 1):
        if not command or command.startswith("#"):
            continue
        if name not in out:
            raise ValueError(f"line {n}: no table {name}")
        if command == "copyFile":
            out[args[0]] = out[name]
        elif command == "renameFile":
            out[args[0]] = out.pop(name)
        elif command == "deleteFile":
            del out[name]
        elif command == "assertColumn":
            _known(out[name], args[0])
        elif command in COMMANDS:
            out[name] = COMMANDS[command](out[name], *args)
        else:
            raise ValueError(f"line {n}: unknown command {command}")
    return out
