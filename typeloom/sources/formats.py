"""One way in and out for all table formats, and checks of what was written.

write() makes part files in parallel; read() gives the same typed rows back, whatever the format: tab-separated lines (with JSON or literal
cells), triples, JSON lines (natural or typed), XML, SQL text. All read their files in splits, but for XML rows. Texts come back to the character, whatever tabs, line
ends, quotes, backslashes or blanks they hold, and null texts stay apart from empty ones: in lines, triples and XML a text has
backslash escapes, and null is a backslash and N. Triples hold one row an entity. round_trip_problems() compares
two tables deeply, cell by cell, with one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.operators import ordering as O
from typeloom.operators import relational as R

from . import files as FL
from . import tables as TB
from . import typespec as S

FORMATS = ("tsv", "literal_tsv", "eav", "jsonl", "typed_jsonl", "xml", "sql")


def kind_of(path: str) -> str:
    """A format by the file's extension, compression aside."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower().removesuffix(".gz")
    extension = name.rsplit(".", 1)[-1]
    if extension not in FORMATS:
        raise ValueError(f"{path}: unknown format {extension}; known are {', '.join(FORMATS)}")
    return extension


def schema_of(columns: list[S.Column], types: S.Types | None = None) -> T.StructType:
    types = types or S.Types()
    return T.StructType([T.StructField(c.name, types.spark(c.spec)) for c in columns])


#: Control characters that XML cannot hold. Fixed values.
_CONTROLS = [chr(i) for i in range(32) if chr(i) not in "\t\n\r"] + ["\ufffe", "\uffff"]
_ESCAPES = {"\t": "t", "\n": "n", "\r": "r"} | {ch: f"u{ord(ch):04x}" for ch in _CONTROLS}
NULL = "\\N"


def escaped(c: Column) -> Column:
    """A text in one line of characters that any format can hold; null is a mark that no text gives."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for ch in "\t\n\r":
        out = F.replace(out, F.lit(ch), F.lit("\\" + _ESCAPES[ch]))
    rare = out
    for ch in _CONTROLS:
        rare = F.replace(rare, F.lit(ch), F.lit("\\" + _ESCAPES[ch]))
    return F.coalesce(F.when(out.rlike("[\\x00-\\x1f\ufffe\uffff]"), rare).otherwise(out), F.lit(NULL))


def unescaped(c: Column) -> Column:
    """The inverse of escaped(). Doubled backslashes are cut out first, so that an escaped backslash before a t stays one."""

    def plain(part: Column) -> Column:
        some = part
        for ch in "\t\n\r":
            some = F.replace(some, F.lit("\\" + _ESCAPES[ch]), F.lit(ch))
        rare = some
        for ch in _CONTROLS:
            rare = F.replace(rare, F.lit("\\" + _ESCAPES[ch]), F.lit(ch))
        return F.when(part.contains("\\"), F.when(some.contains("\\u"), rare).otherwise(some)).otherwise(part)

    return F.when(c == NULL, F.lit(None)).when(c.contains("\\"), F.array_join(F.transform(F.split(c, "\\\\\\\\", -1), plain), "\\")).otherwise(c)


def _cells(df: DataFrame, nested: str = "json") -> list[Column]:
    """The columns as escaped text; absent values that are no texts are empty."""
    return [escaped(F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else TB.cell_text(F.col(f"`{f.name}`"), f.dataType, nested)).alias(f.name) for f in df.schema]


def _typed(rows: DataFrame, columns: list[S.Column], types: S.Types | None) -> DataFrame:
    """Typed rows of texts (cells); texts are taken as they are, null or empty."""
    types = types or S.Types()

    def is_text(c: S.Column) -> bool:
        spec = types.resolve(c.spec)
        members = [m for m in spec.items if str(m) != "nil"] if spec.kind == "union" else []
        spec = types.resolve(members[0]) if len(members) == 1 else spec
        return c.default is None and spec.kind not in ("enum", "union") and str(spec) in TB.ESCAPED | {"string"}

    plain = [i for i, c in enumerate(columns) if is_text(c)]
    out = TB.typed(rows.select(F.monotonically_increasing_id().alias("_line"), "cells", *[F.col("cells")[i].alias(f"_text{i}") for i in plain]), columns, types, keep=[f"_text{i}" for i in plain])
    return out.select(*[F.col(f"_text{i}").alias(c.name) if i in plain else F.col(f"`{c.name}`") for i, c in enumerate(columns)])


def write(df: DataFrame, path: str, kind: str | None = None, table: str = "table", compression: str = "none") -> None:
    """df in a format (default: by the path's extension). Triples take their entity from the first column. Part files that are compressed (by zlib at its fastest level) are read whole, one a task."""
    kind = kind or kind_of(path)

    def put(lines: DataFrame) -> None:
        lines.write.option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)

    if kind in ("tsv", "literal_tsv"):
        put(df.select(F.concat_ws("\t", *_cells(df, "literal" if kind == "literal_tsv" else "json")).alias("value")))
    elif kind == "eav":
        key, first = df.columns[:2]
        triples = R.unpivot(df.select(*_cells(df)), key, skip_empty=False)  # the first cell is written even if empty, so that no row goes
        put(triples.where((F.col("value") != "") | (F.col("attribute") == first)).select(F.concat_ws("\t", "entity", "attribute", "value").alias("value")))
    elif kind == "jsonl":
        put(TB.natural_json(df))
    elif kind == "typed_jsonl":
        put(TB.typed_json(df))
    elif kind == "xml":
        TB.write_xml(df.select(*[escaped(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema]), path, compression)
    elif kind == "sql":
        put(TB.insert_lines(df, table))
    else:
        raise ValueError(f"unknown format {kind}")


def read(spark: SparkSession, path: str, columns: list[S.Column], kind: str | None = None, types: S.Types | None = None, table: str = "table") -> DataFrame:
    """Typed rows of a file or folder that write() made; columns are its header."""
    kind, schema = kind or kind_of(path), schema_of(columns, types)
    names = [c.name for c in columns]
    lines = spark.read.option("lineSep", "\n").text(path) if kind not in ("xml", "sql") else None
    if kind in ("tsv", "literal_tsv"):
        rows = lines.where(F.col("value") != "") if len(columns) > 1 else lines
        rows = rows.select(F.transform(F.split("value", "\t", -1), unescaped).alias("cells"))
    elif kind == "eav":
        cells = F.split("value", "\t", -1)
        long = lines.select(cells[0].alias("entity"), cells[1].alias("attribute"), cells[2].alias("value"))
        if not (bad := lines.where((F.size(cells) != 3) | (cells[0] == "") | (cells[1] == ""))).isEmpty():
            raise ValueError(f"{path}: no triple: {bad.first()['value'][:80]!r}")
        wide = R.pivot(long.withColumn("_line", F.monotonically_increasing_id()), "_line", names[1:], "last")
        rows = wide.select(F.transform(F.array("entity", *[f"`{n}`" for n in names[1:]]), unescaped).alias("cells"))
    elif kind == "jsonl":
        rows = lines.select(F.from_json("value", "array<string>").alias("cells"))
    elif kind == "typed_jsonl":
        return TB.read_typed_json(lines, schema)
    elif kind == "xml":
        back = TB.read_xml(spark, path, schema)
        texts = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
        return back.select(*[unescaped(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) if n in texts else F.col(f"`{n}`") for n in names])
    elif kind == "sql":
        return FL.read_inserts(FL.statements(spark, path), table, schema)
    else:
        raise ValueError(f"unknown format {kind}")
    return _typed(rows, columns, types)


def typed_json_problems(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """value, column, found of cells whose JSON is not what the type writes: integers and floats are tagged objects, absent ones null."""
    v = F.try_parse_json("value")

    def expected(kind: T.DataType) -> list[str]:
        if isinstance(kind, T.IntegralType):
            return ["OBJECT<integer: STRING>", "VOID"]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return ["OBJECT<float: STRING>", "VOID"]
        return ["STRING", "VOID"] if isinstance(kind, T.StringType) else ["BOOLEAN", "VOID"]

    items = []
    for i, f in enumerate(schema):
        found = F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$[{i}]", "variant")), F.lit("nothing"))
        items.append(F.when(~found.isin(expected(f.dataType)), F.struct(F.lit(f.name).alias("column"), found.alias("found"))))
    bad = lines.select("value", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x"))
    return bad.select("value", "x.column", "x.found")


#: Texts and binaries of more bytes are compared by their digests. Fixed value.
_WHOLE = 64


def _mark(c: Column, kind: T.DataType) -> Column:
    """What stands for a cell where it is compared: long texts and binaries are named by their size and SHA-256, others by themselves."""
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        return c
    n = F.octet_length(c)
    return F.struct(F.when(n <= _WHOLE, c).alias("whole"), F.when(n > _WHOLE, F.struct(n.alias("n"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("long"))


def round_trip_problems(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, column of cells that differ, deeply compared; column is null for rows that only one side has. Floats have to be equal to the bit. Long texts meet as digests, so that they are not shuffled."""
    names = [f.name for f in before.schema if f.name != key]

    def side(df: DataFrame, there: str) -> DataFrame:
        return df.select(F.col(f"`{key}`"), *[_mark(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names], F.lit(True).alias(there))

    a, b = side(before, "_l").alias("a"), side(after, "_r").alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    one_side = F.col("a._l").isNull() | F.col("b._r").isNull()

    def same(f: T.StructField) -> Column:
        x, y = F.col(f"a.`{f.name}`"), F.col(f"b.`{f.name}`")
        return x.eqNullSafe(y) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else O.same(x, y, f.dataType)

    items = [F.when(~one_side & ~same(f), F.lit(f.name)) for f in before.schema if f.name != key]
    found = F.when(one_side, F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.array(*items), lambda x: x.isNotNull()))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").cast("string").alias("key"), F.explode(found).alias("column"))
