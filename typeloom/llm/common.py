"""Helpers shared by the corpus operators.

White space always means the six ASCII characters space, tab, line feed, vertical tab, form feed and carriage
return; lower-casing always means A-Z only, so results do not depend on a Unicode version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. Pure ASCII strings take the built-in fast path; others keep their non-ASCII letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts 0. Each run becomes one letter, as an array of all words would fill the heap."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.char_length(F.translate(marks, SPACES, "")).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most: what a task makes of a part's texts is freed before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of df if they are at most n, else the about n rows of smallest hashed key: a filter in place, not a sort that gathers rows."""
    total = df.count()
    if total <= n:
        return df
    return df.where(F.xxhash64(key) < int(n / total * 2**64) - 2**63)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or a folder below the warehouse where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df stored as Parquet in the shared folder and read back: its lineage ends here, and any executor can re-read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by written() that no later step reads."""
    spark = df.sparkSession
    folder = df.inputFiles()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
