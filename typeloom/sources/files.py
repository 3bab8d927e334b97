"""Files and archives as tables: directory scans by glob, members of zip archives, SQL text read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import glob_regex


def scan(spark: SparkSession, folder: str, globs: list[str] | None = None) -> DataFrame:
    """path, length, modificationTime of files below a folder whose path matches one of the globs; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return df.where(F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))) if globs else df


def zip_members(spark: SparkSession, path: str, max_bytes: int = 64 << 20, read: bool = True) -> DataFrame:
    """path, member, size, content of archives' members. Members larger than max_bytes, and all if read is false, have no content;
    unsafe names (absolute, or with "..") and folders are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        parts = m.filename.replace("\\", "/").split("/")
                        if m.is_dir() or m.filename.startswith("/") or ".." in parts or ":" in parts[0]:
                            continue
                        body = z.read(m) if read and m.file_size <= max_bytes else None
                        yield pd.DataFrame({"path": [p], "member": [m.filename], "size": [m.file_size], "content": [body]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, size long, content binary")


def _open_after(text: Column) -> Column:
    """Whether a quote stands open after text that began outside of quotes. Comments (--) hold no quotes."""
    return F.contains(F.regexp_replace(text, "'[^']*'|--[^\n]*", ""), F.lit("'"))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """value: SQL statements, or lines outside of quotes, of files that are read in splits, with those put together again whose quoted text spans lines.

    A line turns the state at its begin (outside or inside of quotes) into the state at its end: it keeps it, turns it over, or sets it whatever it was. Within a split the
    state before a line is thus the one last set, turned over as often as a line since did so, else that of the split's begin, likewise; the begin of each split comes from one
    row a split. Only lines of statements that span some are shuffled a second time."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = F.instr("value", F.lit("'"))
    out, into = _open_after(F.col("value")), F.when(first == 0, True).otherwise(_open_after(F.substring("value", first + 1, F.octet_length("value"))))
    lines = lines.select("*", out.alias("_out"), into.alias("_in"))
    split, before = Window.partitionBy("_file", "_block").orderBy("_at"), Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sets, turns = F.col("_out") == F.col("_in"), (F.col("_out") & ~F.col("_in")).cast("long")
    lines = lines.withColumn("_turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    last = F.last(F.when(sets, F.struct(F.col("_out").cast("long").alias("state"), F.col("_turns").alias("turns"))), ignorenulls=True)
    lines = lines.withColumn("_set", last.over(before))

    def state(begin: Column) -> Column:
        return F.pmod(F.when(F.col("_set").isNotNull(), F.col("_set.state") + F.col("_turns") - F.col("_set.turns")).otherwise(begin + F.col("_turns")), F.lit(2))

    # each split as a function of its begin, then its begin, and the statement that is open there
    outside, inside = state(F.lit(0)), state(F.lit(1))
    ends = lines.select("_file", "_block", "_at", *[F.when(s == 0, F.col("_out")).otherwise(F.col("_in")).cast("long").alias(n) for s, n in ((outside, "e0"), (inside, "e1"))], *[F.when(s == 0, F.col("_at")).alias(n) for s, n in ((outside, "s0"), (inside, "s1"))])
    blocks = ends.groupBy("_file", "_block").agg(F.max_by("e0", "_at").alias("e0"), F.max_by("e1", "_at").alias("e1"), F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_n", F.coalesce(F.sum(((F.col("e0") == 1) & (F.col("e1") == 0)).cast("long")).over(earlier), F.lit(0)))
    fixed = F.last(F.when(F.col("e0") == F.col("e1"), F.struct("e0", F.col("_n").alias("n"))), ignorenulls=True).over(earlier)
    blocks = blocks.withColumn("_f", fixed).withColumn("_begin", F.pmod(F.coalesce(F.col("_f.e0") + F.col("_n") - F.col("_f.n"), F.col("_n")), F.lit(2)))
    started = F.when(F.col("_begin") == 0, F.col("s0")).otherwise(F.col("s1"))
    own = F.struct(F.col("_block").alias("b"), started.alias("a"))
    blocks = blocks.select("_file", "_block", "_begin", F.last(F.when(started.isNotNull(), own), ignorenulls=True).over(earlier).alias("_open"))
    lines = lines.join(blocks, ["_file", "_block"]).withColumn("_state", state(F.col("_begin")))
    starts = F.when(F.col("_state") == 0, F.struct(F.col("_block").alias("b"), F.col("_at").alias("a")))
    lines = lines.withColumn("_statement", F.coalesce(F.last(starts, ignorenulls=True).over(split), F.col("_open")))
    whole = (F.col("_state") == 0) & ~F.col("_out")
    parts = lines.where(~whole).groupBy("_file", "_statement").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("parts"))
    return lines.where(whole).select("value").unionByName(parts.select(F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value")))


#: A literal of SQL text whose quoted parts are in hexadecimal: quoted, binary, or bare.
_LITERAL = "([Xx]?'#[0-9A-F]*'|[^,\\s)]+)"


def _shielded(body: Column) -> Column:
    """SQL text with what stands in quotes in hexadecimal, and doubled quotes within it as one: no character of it can be taken for a separator any more."""
    parts = F.transform(F.split(body, "'", -1), lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("'#"), F.hex(p), F.lit("'"))).otherwise(p))
    return F.replace(F.array_join(parts, ""), F.lit("''#"), F.lit("27"))


def read_inserts(lines: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Rows of `INSERT INTO "table" VALUES (...);` statements (value), typed by schema. Digits never pass through a double."""
    head = f'INSERT INTO "{table}" VALUES ('
    body = F.substring("value", len(head) + 1, 2**30)
    cells = lines.where(F.col("value").startswith(head)).select(F.regexp_extract_all(_shielded(body), F.lit(_LITERAL), 1).alias("cells"))

    def one(i: int, f: T.StructField) -> Column:
        c = F.try_element_at("cells", F.lit(i + 1))
        quoted = F.decode(F.unhex(F.regexp_extract(c, "#([0-9A-F]*)'", 1)), "UTF-8")
        text = F.when(c.startswith("'"), quoted).otherwise(c)
        if isinstance(f.dataType, T.BinaryType):
            value = F.unhex(quoted)
        elif isinstance(f.dataType, T.BooleanType):
            value = c == "1"
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.from_json(text, f.dataType)
        else:
            value = text.try_cast(f.dataType)
        return F.when(c != "NULL", value).alias(f.name)

    return cells.select(*[one(i, f) for i, f in enumerate(schema)])
