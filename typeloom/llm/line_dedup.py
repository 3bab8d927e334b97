"""Line dedup: explode normalised lines, hash them, count documents per hash, drop repeats, reassemble by position.

DataFrame functions only. A line's key is the line without white space at its ends and with A-Z lower-cased. A key of
at least `min_chars` code points found in at least `min_docs` documents keeps its lines only in the document with the
smallest id that holds it.

Defined results: a null or empty text is one empty line; a null id never takes part in a comparison and keeps all its
lines; rows that repeat a document id count as one document, each row is treated by its own text; other columns pass
through whatever their names; an empty table gives an empty table.

Scale: only 16-byte digests, ids and positions are shuffled for the count, with partial aggregation, so a line that a
third of all documents share is one row a task before the exchange. The join that finds the lines to drop leaves its
exchanges to AQE, which splits a hot key. Texts are shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, table

MIN_CHARS, MIN_DOCS = 10, 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with the text replaced, and n_lines (before) and n_dropped, in place of columns so named."""
    keyed = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tk"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
        .select("_id", "_tk", "_pos", F.btrim("_line", F.lit(SPACES)).alias("_line"))
        .where(F.char_length("_line") >= min_chars)
        .select("_id", "_tk", "_pos", F.unhex(F.md5(ascii_lower(F.col("_line")))).alias("_h"))
    )
    if min_docs <= 2:  # two different ids exist when the smallest and the largest differ
        stats = keyed.groupBy("_h").agg(F.min("_id").alias("_keep"), F.max("_id").alias("_last"))
        stats = stats if min_docs < 2 else stats.where(F.col("_keep") < F.col("_last"))
    else:
        stats = keyed.groupBy("_h").agg(F.min("_id").alias("_keep"), F.count_distinct("_id").alias("_n")).where(F.col("_n") >= min_docs)
    dropped = keyed.join(stats.select("_h", "_keep"), "_h").where(F.col("_id") != F.col("_keep")).groupBy("_id", "_tk").agg(F.collect_set("_pos").alias("_drop"))
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    # the lines are split below the join, so that the kept ones are picked from a stored array in linear time
    whole = docs.select(*[F.col(c) for c in rest], F.xxhash64(text_col).alias("_row_tk"), _lines(F.col(text_col)).alias("_all"))
    out = whole.join(dropped, (F.col(id_col) == F.col("_id")) & (F.col("_row_tk") == F.col("_tk")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.col("_drop")), lambda i: F.element_at("_all", i + 1))
    text = F.when(F.col("_drop").isNull(), F.array_join("_all", "\n")).otherwise(F.array_join(kept, "\n"))
    made = {text_col: text}
    return out.select(
        *[made[c].alias(c) if c in made else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("_all").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
d AS (SELECT k, min(doc_id) AS keep FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.doc_id, l.line, l.pos, coalesce(d.keep <> l.doc_id, false) AS gone FROM l LEFT JOIN d ON l.k = d.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
