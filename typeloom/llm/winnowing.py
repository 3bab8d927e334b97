"""Document fingerprints by winnowing, and their likeness to an edited text and to the next document.

DataFrame functions only. Words are maximal runs of other characters than the six ASCII spaces, A-Z lower-cased. Each GRAM words in a row have a
polynomial hash of their words' hashes; of each WINDOW such hashes in a row the smallest is kept, the rightmost of equal ones, with the place of its first word.
Two texts that share WINDOW + GRAM - 1 words in a row therefore share a fingerprint at matching places, and none is shared that is not a
shared run of GRAM words (or a hash met by chance). Hash and place are one long, hash * 2^32 + (2^32 - 1 - place), so that a plain minimum prefers the rightmost.

The edited text of a document has its last floor(n / 2) code points replaced by the first as many (or all) of the next document by ascending id; the last one's
next is the first. Likeness is the Jaccard resemblance of the sets of hashes.

Defined results: null counts as the empty text; a text of fewer than GRAM words has one hash, of all its words, one without words has none and the fingerprint '';
two fingerprints without hashes are alike (1.0), one with and one without are not (0.0); rows that repeat an id follow each other by text; a row without id has no next document,
its edited text is its first half and near_next is 0.0; a single document is its own next; other columns are ignored; an empty table gives no rows.

Scale: texts move once, and fingerprints never: to buckets of about BUCKET_ROWS documents in a row by id, whose borders are quantiles of the ids and
therefore ids themselves, so the first document of a bucket is known by its id alone and goes to the bucket before as well. Within a bucket the next document is the next row. Rows
that repeat one id share a bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, table

GRAM, WINDOW = 5, 8
PRIME, BASE = 1_073_741_789, 911_382_323
BUCKET_ROWS, MAX_BUCKETS = 256, 10_000
_LOW = 2**32 - 1


def _words(text: Column) -> Column:
    """The hashes, 1 to 2^32, of a text's words; empty without words."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    words = F.filter(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % PRIME + 1)


def _slid(values: str, reach: int, stride: int) -> Column:
    """At each place the least of the values there and up to reach - 1 strides on; what lies beyond the end counts for nothing."""
    return F.transform(values, lambda x, i: F.least(x, *[F.get(F.col(values), i + stride * j) for j in range(1, reach)]))


def fingerprints(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the fingerprint of its column text, an array of longs by ascending place, in a column into."""
    power = [pow(BASE, j, PRIME) for j in range(GRAM)]
    w, h, m = (f"_{c}_{into}" for c in "whm")
    df = df.withColumn(w, _words(F.col(text)))
    grams = F.greatest(F.size(w) - (GRAM - 1), F.least(F.size(w), F.lit(1)))
    # a text of fewer words counts as if words of value 0 followed
    rolled = F.transform(
        F.slice(w, 1, grams),
        lambda x, i: F.shiftleft(sum((F.coalesce(F.get(F.col(w), i + j), F.lit(0)) * power[GRAM - 1 - j] for j in range(1, GRAM)), x * power[GRAM - 1]) % PRIME, 32)
        .bitwiseOR(F.lit(_LOW) - i),
    )
    df = df.withColumn(h, rolled).withColumn(m, _slid(h, 4, 1))
    windows = F.greatest(F.size(h) - (WINDOW - 1), F.least(F.size(h), F.lit(1)))
    df = df.withColumn(into, F.array_distinct(F.slice(_slid(m, 2, WINDOW - 4), 1, windows)))
    return df.drop(w, h, m)


def shown(fingerprint: Column) -> Column:
    """hash:place of each, the hash in hexadecimal, joined by blanks."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string"))
    return F.array_join(F.transform(fingerprint, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard resemblance of the hashes of two fingerprints."""
    a, b = (F.array_distinct(F.transform(x, lambda y: F.shiftright(y, 32))) for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(1.0))


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id not null) with _bucket and _after: a bucket's rows, then, marked 1, those with which the next bucket begins."""
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    shares = [i / buckets for i in range(buckets)]
    found = docs.select(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, max(10_000, 10 * buckets)).alias("q")).first()
    begins = sorted({float(x) for x in [found["least"], *(found["q"] or [])] if x is not None}) or [0.0]
    last = len(begins) - 1
    placed = Bucketizer(splits=[*begins, float("inf")] if last else [float("-inf"), begins[0], float("inf")], inputCol="_id", outputCol="_bucket").transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    number = F.col("_bucket").cast("int") if last else F.lit(0)
    first = F.col("_id") == F.element_at(F.lit(begins), number + 1)
    before = F.when(number > 0, number - 1).otherwise(F.lit(last))
    places = F.when(first, F.array(F.struct(number.alias("_bucket"), F.lit(0).alias("_after")), F.struct(before.alias("_bucket"), F.lit(1).alias("_after"))))
    return placed.select(*docs.columns, F.inline(F.coalesce(places, F.array(F.struct(number.alias("_bucket"), F.lit(0).alias("_after"))))))


def winnow(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint (arrays), near_edited, near_next for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("_bucket").orderBy("_after", "doc_id", "text")
    # the fingerprints are made between the exchange and the window, which asks for no other one: they are never shuffled
    following = fingerprints(_bucketed(docs.where("doc_id is not null")).repartition("_bucket"), "text", "fingerprint")
    following = following.select("*", F.lead("text").over(order).alias("_next_text"), F.lead("fingerprint").over(order).alias("_next")).where("_after = 0")
    alone = fingerprints(docs.where("doc_id is null"), "text", "fingerprint").select("*", F.lit(None).cast("string").alias("_next_text"), F.lit(None).cast("array<long>").alias("_next"))
    both = following.select("doc_id", "text", "fingerprint", "_next_text", "_next").unionByName(alone)
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.left("text", F.col("n_chars") - F.col("_half")), F.coalesce(F.left("_next_text", "_half"), F.lit("")))
    both = both.select("doc_id", "n_chars", "fingerprint", "_next", edited.alias("edited"))
    both = fingerprints(both, "edited", "edited_fingerprint")
    near_next = F.when(F.col("_next").isNull(), 0.0).otherwise(likeness(F.col("fingerprint"), F.col("_next")))
    return both.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), near_next.alias("near_next"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next"
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                  coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents),
e AS (SELECT a.doc_id, a.n, a.next_id, a.text, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS edited FROM d a JOIN d b ON a.next_id = b.doc_id),
t AS (SELECT doc_id, 0 AS kind, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, kind, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos, len(l) AS words FROM
      (SELECT doc_id, kind, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM t)),
v AS (SELECT doc_id, kind, pos, words, ('0x' || left(md5(word), 8))::BIGINT % 1073741789 + 1 AS v FROM w),
h AS (SELECT doc_id, kind, pos, words,
             (v * 986117150 + coalesce(lead(v, 1) OVER p, 0) * 278119462 + coalesce(lead(v, 2) OVER p, 0) * 130403365
              + coalesce(lead(v, 3) OVER p, 0) * 911382323 + coalesce(lead(v, 4) OVER p, 0)) % 1073741789 AS h
      FROM v WINDOW p AS (PARTITION BY doc_id, kind ORDER BY pos)),
g AS (SELECT *, max(pos) OVER (PARTITION BY doc_id, kind) - 6 AS windows,
             min(h * 4294967296 + (4294967295 - pos)) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m
      FROM h WHERE pos <= greatest(words - 5, 0)),
f AS (SELECT DISTINCT doc_id, kind, m // 4294967296 AS h, 4294967295 - m % 4294967296 AS place FROM g WHERE pos < greatest(windows, 1)),
s AS (SELECT doc_id, kind, string_agg(printf('%x:%d', h, place), ' ' ORDER BY place) AS shown, list_distinct(list(h)) AS hs FROM f GROUP BY doc_id, kind),
r AS (SELECT e.doc_id, e.n, e.edited, coalesce(a.shown, '') AS fa, coalesce(b.shown, '') AS fb,
             coalesce(a.hs, []) AS ha, coalesce(b.hs, []) AS hb, coalesce(c.hs, []) AS hc
      FROM e LEFT JOIN s a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN s b ON b.doc_id = e.doc_id AND b.kind = 1
             LEFT JOIN s c ON c.doc_id = e.next_id AND c.kind = 0)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       coalesce(len(list_intersect(ha, hb)) / nullif(len(ha) + len(hb) - len(list_intersect(ha, hb)), 0), 1.0) AS near_edited,
       coalesce(len(list_intersect(ha, hc)) / nullif(len(ha) + len(hc) - len(list_intersect(ha, hc)), 0), 1.0) AS near_next
FROM r
"""
