"""Readers and writers of typed tables: tab-separated text, triples, JSON, XML, SQL text.

A reader turns cells into typed columns in one projection: an empty cell takes its default, then is cast by its declared
type (containers from JSON or table literals, with or without the outer braces); cells that do not fit become null here and rows of cast_violations(). The header is read alone, by a one-row job.
Files that have to be read whole (triples in order, transposed tables) keep `_line`, their order within the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.codecs import from_literal, literal_json, plain_json, to_literal
from typeloom.functions.strings import unescape_text
from typeloom.operators import relational as R
from typeloom.operators import validate as V
from typeloom.operators.expression import compile_expression, in_order

from . import jsondocs as JD
from . import typespec as S

ESCAPED = {"text", "asciitext", "markdown", "asciimarkdown"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """_line (1-based) and value of one text file; line ends of any kind. Large files are read in splits: lines are put in order by split and place in it, and counted in two levels."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return R.numbered(rows, ["_block", "_at"], "_line").select("_line", "value")


def raw_rows(df: DataFrame) -> DataFrame:
    """_line and cells of data lines: comments (#) and blank lines are left out."""
    return df.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("_line", F.split("value", "\t", -1).alias("cells"))


def row_at(raw: DataFrame, index: int) -> DataFrame:
    """The data row at a 1-based position by `_line`."""
    return R.numbered(raw, "_line", "_at").where(F.col("_at") == index).drop("_at")


def raw_problems(df: DataFrame) -> DataFrame:
    """_line of rows with a cell that is no UTF-8 or holds a line end."""
    return df.where(F.exists("cells", lambda x: ~F.is_valid_utf8(x) | x.rlike("[\r\n]"))).select("_line")


def cell(c: Column, column: S.Column, types: S.Types) -> Column:
    """A text cell as its declared type: default for empty, then cast; containers are JSON or table literals."""
    spec = types.resolve(column.spec)
    text = F.nullif(c, F.lit(""))
    if column.default is not None and not column.default.startswith("="):
        text = F.coalesce(text, F.lit(column.default))
    if spec.kind == "union":
        members = [m for m in spec.items if str(m) != "nil"]
        if len(members) > 1:
            return V.to_union(text, [str(m) for m in members])
        spec = types.resolve(members[0])
    kind = types.spark(spec)
    if spec.kind == "enum":
        return V.to_enum(text, list(spec.items))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return nested_value(text, kind)
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.try_parse_json(text), F.try_parse_json(from_literal(text)))
    if spec.name in ESCAPED:
        return unescape_text(text)
    value = V.cast_cell(text, spec.name)
    return value.cast(kind) if not isinstance(kind, T.StringType) else (F.coalesce(value, F.lit("")) if spec.name == "string" else value)


def _nested(text: Column, sequence: bool) -> Column:
    """JSON text of a container's cell: JSON itself, a table literal with its braces, or one without them (a,b or k=v)."""
    braced = F.when(text.rlike("(?s)^\\s*[{].*[}]\\s*\\z"), text).otherwise(F.concat(F.lit("{"), text, F.lit("}")))
    # texts that do not begin as JSON are not parsed, as each failure costs an exception
    is_json = F.when(text.rlike("^\\s*\\[" if sequence else "^\\s*(?:\\[|[{]\\s*[\"}])"), F.try_parse_json(text).isNotNull()).otherwise(False)
    plain = plain_json(text)  # never JSON itself
    return F.coalesce(plain, F.when(is_json, text).otherwise(literal_json(F.when(plain.isNull() & ~is_json, braced))))


def nested_value(text: Column, kind: T.DataType) -> Column:
    """A container's cell as its type; the positions of a sequence are the fields of a tuple."""
    json = _nested(text, isinstance(kind, T.ArrayType))
    whole = F.from_json(json, kind)
    if not isinstance(kind, T.StructType) or [f.name for f in kind] != [f"_{i}" for i in range(1, len(kind) + 1)]:
        return whole
    items = F.from_json(json, "array<string>")
    fields = []
    for i, f in enumerate(kind, 1):
        item = F.try_element_at(items, F.lit(i))
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        fields.append((nested_value(item, f.dataType) if nested else item.try_cast(f.dataType)).alias(f.name))
    return F.when(items.isNotNull(), F.struct(*fields)).otherwise(whole)


def typed(raw: DataFrame, columns: list[S.Column], types: S.Types | None = None, names: dict[str, Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Typed columns (and _line, and those of keep) of raw rows (_line, cells); defaults that are expressions come last, in dependency order."""
    types = types or S.Types()
    # the cells as columns first, behind a generator of one row: the optimiser would put what makes a cell in wherever it is read, a hundred times for a container
    cells = raw.select("_line", *(keep or []), F.inline(F.array(F.struct(*[F.get("cells", F.lit(i)).alias(f"_cell{i}") for i in range(len(columns))]))))
    out = cells.select("_line", *(keep or []), *[cell(F.col(f"_cell{i}"), c, types).alias(c.name) for i, c in enumerate(columns)])
    computed = {c.name: c.default for c in columns if c.default and c.default.startswith("=")}
    for name in in_order(computed, [c.name for c in columns]) if computed else []:
        kind = types.spark(next(c.spec for c in columns if c.name == name))
        out = out.withColumn(name, F.coalesce(F.col(f"`{name}`"), compile_expression(computed[name], names, {f.name: f.dataType for f in out.schema if f.name not in (keep or [])}, kind)))
    return out


def read_tsv(spark: SparkSession, path: str, types: S.Types | None = None, parent: list[S.Column] | None = None) -> tuple[DataFrame, list[S.Column]]:
    """A typed table and its columns. The first data line is the header."""
    raw = raw_rows(lines(spark, path))
    first = raw.orderBy("_line").limit(1).collect()
    if not first:
        raise ValueError(f"{path}: no header")
    columns = S.header(first[0]["cells"], parent)
    return typed(raw.where(F.col("_line") > first[0]["_line"]), columns, types), columns


def read_transposed(spark: SparkSession, path: str, types: S.Types | None = None) -> DataFrame:
    """A table written one field a line; short lines are padded. Only its header, the first cell of each line, passes the driver."""
    raw = raw_rows(lines(spark, path))
    head = raw.select("_line", F.col("cells")[0].alias("name")).orderBy("_line").collect()
    columns = S.header([r["name"] for r in head])
    given = raw.select(F.col("_line").alias("field"), F.posexplode("cells").alias("pos", "cell")).where("pos > 0")
    rows = given.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("field", "cell"))).alias("m"))
    cells = F.array(*[F.coalesce(F.try_element_at("m", F.lit(r["_line"])), F.lit("")) for r in head])
    return typed(rows.select(F.col("pos").cast("long").alias("_line"), cells.alias("cells")), columns, types)


def read_triples(spark: SparkSession, path: str, on_conflict: str = "error") -> DataFrame:
    """A wide table of text cells from entity, attribute, value lines; columns in order of first appearance. Lines that are no triple are an error."""
    raw = raw_rows(lines(spark, path))
    if not (bad := triple_problems(raw)).isEmpty():
        first = bad.orderBy("_line").first()
        raise ValueError(f"{path}: line {first['_line']}: {first['problem']}")
    t = raw.select("_line", F.col("cells")[0].alias("entity"), F.col("cells")[1].alias("attribute"), F.col("cells")[2].alias("value"))
    if on_conflict == "error" and not R.conflicts(t).isEmpty():
        raise ValueError(f"{path}: a cell is given twice")
    return R.pivot(t, "_line", R.attributes_in_order(t, "_line"), on_conflict)


def triple_problems(raw: DataFrame) -> DataFrame:
    """_line, problem of rows that are no entity, attribute, value."""
    n = F.size("cells")
    problem = F.when(n != 3, F.concat(n.cast("string"), F.lit(" cells"))).when(F.col("cells")[0] == "", "no entity").when(F.try_element_at("cells", F.lit(2)) == "", "no attribute")
    return raw.select("_line", problem.alias("problem")).where("problem is not null")


def is_triples(raw: DataFrame) -> bool:
    return triple_problems(raw).isEmpty()


def parse_json(spark: SparkSession, path: str, layout: str, columns: list[S.Column], types: S.Types | None = None) -> DataFrame:
    """A JSON file as objects ([{...}]), rows ([[...]]) or columns ([[...], ...]); absent and null values are empty. Text that is no such JSON, values past the header and missing columns are errors
    when the rows are read (in the layout columns, those of the outer arrays at once); jsondocs.records() gives them as rows."""
    types = types or S.Types()
    if layout == "columns":
        cells = JD.column_rows(spark, path, len(columns))
        return typed(cells.select("_line", F.transform("cells", lambda x: F.coalesce(x, F.lit(""))).alias("cells")), columns, types)
    found = JD.records(spark, path, layout)
    text = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit(f"{path}: "), F.col("problem"))).cast("string")).otherwise(F.col("value"))
    fast, array = {"mode": "FAILFAST"}, "array<string>"
    if layout == "objects":
        rows = found.select("_line", F.from_json(text, "struct<" + ",".join(f"`{c.name}`:string" for c in columns) + ">", fast).alias("o"))
        return typed(rows.select("_line", F.array(*[F.coalesce(F.col(f"o.`{c.name}`"), F.lit("")) for c in columns]).alias("cells")), columns, types)
    rows = found.select("_line", F.from_json(text, array, fast).alias("x"))
    long = F.raise_error(F.lit(f"{path}: a row has more values than the header")).cast(array)
    rows = rows.select("_line", F.when(F.size("x") > len(columns), long).otherwise(F.col("x")).alias("x"))
    return typed(rows.select("_line", F.transform("x", lambda x: F.coalesce(x, F.lit(""))).alias("cells")), columns, types)


# -- writers --


def cell_text(c: Column, kind: T.DataType, nested: str = "json") -> Column:
    """A value as a text cell: null is empty, containers are JSON (plain or typed) or table literals, floats keep a point."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(to_literal(c, kind) if nested == "literal" else F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def tsv_lines(df: DataFrame, columns: list[S.Column] | None = None, drop_comments: bool = True, nested: str = "json") -> DataFrame:
    """value: one line a row, tab between cells. Columns of type comment are left out; nested: how containers are written, json or literal."""
    keep = [f for f in df.schema if f.name != "_line" and not (drop_comments and columns and any(c.name == f.name and str(c.spec) == "comment" for c in columns))]
    from typeloom.functions.strings import escape_text

    return df.select(F.concat_ws("\t", *[escape_text(cell_text(F.col(f"`{f.name}`"), f.dataType, nested)) for f in keep]).alias("value"))


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Part files of lines without a header (schema_line() gives it), written in parallel."""
    tsv_lines(df).write.option("compression", compression).text(path)


def schema_line(columns: list[S.Column]) -> str:
    return "\t".join(f"{c.name}{'!' if c.published else ''}:{c.spec}" + (f":{c.default}" if c.default is not None else "") for c in columns)


def natural_json(df: DataFrame) -> DataFrame:
    """value: each row as a JSON array of its plain values."""
    def plain(c: str) -> Column:
        text = F.to_json(F.array(F.col(f"`{c}`")))
        return F.substring(text, F.lit(2), F.char_length(text) - 2)

    return df.select(F.concat(F.lit("["), F.concat_ws(",", *map(plain, df.columns)), F.lit("]")).alias("value"))


def object_json(*columns: Column) -> Column:
    """Plain values as a JSON object; nulls are left out."""
    return F.to_json(F.struct(*columns))


def typed_json_cell(c: Column, kind: T.DataType) -> Column:
    """A value as JSON that keeps its type: integers and floats are tagged objects, others plain."""
    if isinstance(kind, T.IntegralType):
        text = F.concat(F.lit('{"integer":"'), c.cast("string"), F.lit('"}'))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
        text = F.concat(F.lit('{"float":"'), plain, F.lit('"}'))
    elif isinstance(kind, T.StringType):
        inner = F.to_json(F.array(c))
        text = F.substring(inner, F.lit(2), F.char_length(inner) - 2)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def typed_json(df: DataFrame) -> DataFrame:
    """value: each row as a JSON array of typed_json_cell()s."""
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *[typed_json_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]), F.lit("]")).alias("value"))


def read_typed_json(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of typed_json()."""
    v = F.parse_json("value")

    def one(i: int, f: T.StructField) -> Column:
        if isinstance(f.dataType, T.IntegralType):
            return F.try_variant_get(v, f"$[{i}].integer", "string").cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            t = F.try_variant_get(v, f"$[{i}].float", "string")
            return F.when(t == "nan", float("nan")).when(t == "inf", float("inf")).when(t == "-inf", float("-inf")).otherwise(t.try_cast("double")).cast(f.dataType)
        return F.try_variant_get(v, f"$[{i}]", f.dataType.simpleString())

    return rows.select(*[one(i, f).alias(f.name) for i, f in enumerate(schema)])


#: Spark type -> SQL column type of dumps. Fixed values.
SQL_TYPES = {"boolean": "SMALLINT", "tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def sql_name(name: str, others: set[str]) -> str:
    """Dots and brackets become underscores; a name that is taken gets one more."""
    out = "".join("_" if ch in ".[]=" else ch for ch in name)
    while out in others:
        out += "_"
    return out


def create_table(name: str, schema: T.StructType) -> str:
    """CREATE TABLE text; the first column is the primary key."""
    used: set[str] = set()
    parts = []
    for i, f in enumerate(schema):
        column = sql_name(f.name, used)
        used.add(column)
        parts.append(f'"{column}" {SQL_TYPES.get(f.dataType.simpleString(), "TEXT")}' + (" PRIMARY KEY" if i == 0 else ""))
    return f'CREATE TABLE "{name}" ({", ".join(parts)});'


def insert_lines(df: DataFrame, name: str) -> DataFrame:
    """value: one INSERT a row."""
    from typeloom.functions.collections import sql_literal

    kinds = {"boolean": "boolean", "binary": "binary", "string": "string"}
    cells = [sql_literal(F.col(f"`{f.name}`") if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(f"`{f.name}`"), kinds.get(f.dataType.simpleString(), "number" if isinstance(f.dataType, T.NumericType) else "string")) for f in df.schema]
    return df.select(F.concat(F.lit(f'INSERT INTO "{name}" VALUES ('), F.concat_ws(", ", *cells), F.lit(");")).alias("value"))


def write_xml(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.format("xml").option("rootTag", "file").option("rowTag", "row").option("compression", compression).option("zlib.compress.level", "BEST_SPEED").save(path)


def read_xml(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "row").option("ignoreSurroundingSpaces", False).schema(schema).load(path)


# -- packages: small metadata on the driver --


def topological(graph: dict[str, set[str]], rank: dict[str, int] | None = None) -> list[str]:
    """Ids so that each comes after those it depends on; among the ready ones by rank, then id. A cycle is an error."""
    rank, left, out = rank or {}, {k: {d for d in v if d in graph} for k, v in graph.items()}, []
    while left:
        ready = sorted((k for k, need in left.items() if not need - set(out)), key=lambda k: (rank.get(k, 0), k))
        if not ready:
            raise ValueError(f"packages depend on each other: {', '.join(sorted(left))}")
        out.append(ready[0])
        del left[ready[0]]
    return out


def load_order(files: DataFrame) -> DataFrame:
    """files (path, load_order) with place: by load order (default 1), then path, case aside."""
    keyed = files.withColumn("_order", F.coalesce("load_order", F.lit(1))).withColumn("_path", F.lower("path"))
    return R.numbered(keyed, ["_order", "_path"], "place").drop("_order", "_path")


def active(files: DataFrame, variants: set[str], packages: set[str]) -> DataFrame:
    """Catalog rows whose variant is chosen (or not set) and whose onlyIfPackages are all there."""
    some = F.array(*[F.lit(p) for p in sorted(packages)]) if packages else F.array().cast("array<string>")
    ok = F.coalesce(F.col("variant") == "", F.lit(True)) | F.col("variant").isin(sorted(variants) or [""])
    return files.where(ok & (F.size(F.array_except(F.coalesce("only_if_packages", F.array().cast("array<string>")), some)) == 0))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: * within a name, ** across, ? one character; without "/" it matches the base name. Case does not matter."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            ch = glob[i]
            out += "[^/]*" if ch == "*" else "[^/]" if ch == "?" else "\\" + ch if not ch.isalnum() and ch != "_" else ch
            i += 1
    return "(?i)^" + ("" if "/" in glob else "(?:.*/)?") + out + "$"
