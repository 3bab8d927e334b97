"""A training corpus from raw documents: toxicity, line dedup, near copies, benchmark leaks, mix.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of docs, whatever columns those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import table, written
from typeloom.llm.decontaminate import drop_leaks
from typeloom.llm.jaccard_join import drop_near_copies
from typeloom.llm.line_dedup import line_dedup
from typeloom.llm.mixing import mix
from typeloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go. It learns from labels outside the held-out third."""
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 3) == 1, F.lit(False))
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has as well go; every document stays, with n_chars of its new text."""
    out = line_dedup(docs)
    new = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document left the words that the mix takes."""
    return mix(docs.select("doc_id", "text", "source"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("mixing sources", mixture)]

#: The stages' models, edit distances and components are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
