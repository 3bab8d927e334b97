r"""Ranked lexical search by block-max WAND over segments of compressed posting blocks.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that hold a term,
L their terms with repeats, n a document's terms with repeats, df the documents that hold a term and tf its occurrences in one, a term weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document has m = 10 + (90 n N) div L, and its score for an item sums
w * ((1000000000 tf) div (1000 tf + 8 m)) over the item's distinct terms. Each item gets its k best documents with a score above 0.

1. One scan counts each document's terms that an item asks for. The result, a few numbers a document, is written; N and L come from it.
2. Segments of at most SEGMENT_DOCS documents or about SEGMENT_POSTINGS postings are made where the counts lie, without a shuffle: in
   a segment documents are numbered by ascending id, and a term's postings are cut into blocks of BLOCK. A block stores gaps and tf in one, two or four bytes each, its last
   document and its greatest impact, the score without w. Document frequencies are sums over the segments.
3. An item walks a segment by shallow moves: the ends of its terms' blocks cut the documents into stretches, within which each term stands
   in one block; the sum of w times these blocks' impacts bounds all documents of the stretch. Stretches are opened by falling bound, so that the threshold (the k-th
   score so far) rises at once; those below it are never opened, and blocks that only they touch are never decompressed.
4. One segment in PRIMERS goes first and gives each item a threshold that all others start from. The k best of each segment are ranked together.

Defined results: null and empty texts hold no term and rank nowhere; an item without terms, or whose terms no document holds, has no rows; texts of rows that repeat an item id
are one item, a null id included; rows that repeat a document id are documents each; documents without an id count and rank after all
with one at equal scores; other columns are ignored; empty tables give no rows.

Scale: documents are read once for items of at most MAX_TERMS terms, which go out as a broadcast together; where a benchmark has more, it goes in blocks of
so many, each one's result written before the next. What leaves a task of the last step is k rows an item and segment.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, slices, table, written

TOP, BLOCK, SEGMENT_DOCS, SEGMENT_POSTINGS, MAX_TERMS, PRIMERS = 10, 64, 16_384, 1_000_000, 1_000_000, 16

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _width(values: np.ndarray) -> int:
    top = int(values.max())
    return 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4


def pack(gaps: np.ndarray, tf: np.ndarray) -> bytes:
    """A block: the widths of its two arrays, then the arrays."""
    g, t = _width(gaps), _width(tf)
    return bytes((g, t)) + gaps.astype(f"<u{g}").tobytes() + tf.astype(f"<u{t}").tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    g, t = block[0], block[1]
    n = (len(block) - 2) // (g + t)
    return np.frombuffer(block, f"<u{g}", n, 2).astype(np.int64), np.frombuffer(block, f"<u{t}", n, 2 + n * g).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _counted(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n, held, tf: for each document the numbers of the terms asked for that it holds, and how often."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for b in slices(batches):
            sizes, held, often = [], [], []
            for t in b.column("text"):
                words = terms(t.as_py())
                found = sorted((number[w], k) for w, k in Counter(words).items() if w in number)
                sizes.append(len(words))
                held.append([x for x, _ in found])
                often.append([k for _, k in found])
            lists = (pa.array(x, pa.list_(pa.int32())) for x in (held, often))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "held", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, held array<int>, tf array<int>")


_LISTS = {"m": pa.int64(), "terms": pa.int32(), "begin": pa.int32(), "df": pa.int32(), "last": pa.int32(), "peak": pa.int64(), "at": pa.int32()}


def _segment(ids: pa.Array, n: np.ndarray, sizes: np.ndarray, held: np.ndarray, tf: np.ndarray, documents: int, total: int) -> pa.RecordBatch:
    """One row: the documents' ids and m, the terms with their first block and df, the blocks' last documents, greatest impacts, places and bytes."""
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    m = (10 + 90 * n * documents // total)[order]
    doc = np.repeat(place, sizes)
    by = np.lexsort((doc, held))
    doc, held, tf = doc[by], held[by].astype(np.int64), tf[by].astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    df = np.diff(np.concatenate((starts, [len(held)])))
    within = np.arange(len(held)) - np.repeat(starts, df)
    cuts = np.flatnonzero(within % BLOCK == 0)
    ends = np.concatenate((cuts[1:], [len(held)]))
    gaps = np.diff(doc, prepend=-1)
    gaps[starts] = doc[starts] + 1
    blocks = [pack(gaps[a:b], tf[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    values = {
        "m": m, "terms": held[starts], "begin": np.concatenate((np.searchsorted(cuts, starts), [len(cuts)])), "df": df,
        "last": doc[ends - 1], "peak": np.maximum.reduceat(impact(tf, m[doc]), cuts), "at": np.cumsum([0, *map(len, blocks)]),
    }
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    arrays = [one(ids.take(pa.array(order))), *(one(pa.array(values[c], kind)) for c, kind in _LISTS.items()), pa.array([b"".join(blocks)], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["ids", *_LISTS, "bytes"])


def _index(counted: DataFrame, documents: int, total: int) -> DataFrame:
    """The segments, one a row."""
    kind = counted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, postings = [], 0, 0

        def flush() -> pa.RecordBatch:
            columns = [pa.concat_arrays([p[i] for p in parts]) for i in range(4)]
            sizes = pc.list_value_length(columns[2]).to_numpy()
            return _segment(columns[0], columns[1].to_numpy(), sizes, columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy(), documents, total)

        for b in slices(batches):
            parts.append([b.column(c) for c in ("doc_id", "n", "held", "tf")])
            docs, postings = docs + b.num_rows, postings + len(parts[-1][2].flatten())
            if docs + 1000 > SEGMENT_DOCS or postings > SEGMENT_POSTINGS:
                yield flush()
                parts, docs, postings = [], 0, 0
        if parts:
            yield flush()

    named = {pa.int32(): "int", pa.int64(): "long"}
    schema = ", ".join([f"ids array<{kind}>", *(f"{c} array<{named[t]}>" for c, t in _LISTS.items()), "bytes binary"])
    return counted.where(F.size("held") > 0).mapInArrow(run, schema)


class Segment:
    """A segment's blocks, decompressed as they are asked for."""

    def __init__(self, row: dict):
        for c in _LISTS:
            setattr(self, c, row[c])
        self.bytes, self.opened = row["bytes"], {}

    def block(self, i: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block i. first: of its term's blocks."""
        if i not in self.opened:
            gaps, tf = unpack(self.bytes[self.at[i] : self.at[i + 1]])
            doc = np.cumsum(gaps) + (-1 if first else self.last[i - 1])
            self.opened[i] = doc, impact(tf, self.m[doc])
        return self.opened[i]

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best that score `floor` or more. asked: ascending term numbers."""
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        here = (self.terms[at] == asked) & (weights > 0)
        at, weights = at[here], weights[here]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(at):
            return docs, scores
        lists = list(zip(self.begin[at].tolist(), self.begin[at + 1].tolist(), weights.tolist(), strict=True))
        ends = np.unique(np.concatenate([self.last[a:b] for a, b, _ in lists]))
        begins = np.concatenate(([0], ends[:-1] + 1))
        bound, blocks = np.zeros(len(ends), np.int64), []
        for a, b, w in lists:  # shallow moves: the block in which each stretch lies
            i = a + np.searchsorted(self.last[a:b], ends)
            blocks.append(i)
            bound[i < b] += w * self.peak[i[i < b]]
        total, added = np.zeros(len(self.m), np.int64), [np.zeros(b - a, bool) for a, b, _ in lists]
        threshold, step = max(floor, 1), 4
        left = np.argsort(-bound, kind="stable")
        left = left[bound[left] >= threshold]
        while len(left):
            now, left = left[:step], left[step:]
            for (a, b, w), i, done in zip(lists, blocks, added, strict=True):
                asks = i[now]
                asks = asks[asks < b]
                for x in np.unique(asks[~done[asks - a]]).tolist():  # a block is added once, for all its stretches
                    doc, worth = self.block(x, x == a)
                    total[doc] += w * worth
                    done[x - a] = True
            size = ends[now] - begins[now] + 1
            found = np.repeat(begins[now] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            found = found[total[found] >= threshold]
            docs, scores = np.concatenate((docs, found)), np.concatenate((scores, total[found]))
            keep = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                threshold = max(threshold, int(scores[-1]))
            left, step = left[bound[left] >= threshold], 2 * step
        return docs, scores


def _searched(index: DataFrame, queries, k: int) -> DataFrame:
    """item (its number), doc_id, score: each segment's k best of each item. queries: (term numbers, weights, floor) of each item."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            segment = Segment({c: b.column(c)[0].values.to_numpy() for c in _LISTS} | {"bytes": b.column("bytes")[0].as_py()})
            found = [segment.best(*q[:2], k, q[2]) for q in queries.value]
            items = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
            docs, scores = (np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), b.column("ids")[0].values.take(pa.array(docs)), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, f"item long, doc_id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """(item_id, terms) lists of about MAX_TERMS terms, or of one item, and whether it is the only one; never more than one in the driver's memory."""
    held, size, first = [], 0, True
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if held and held[-1][0] == row["item_id"]:
            held[-1][1].update(terms(row["text"]))
            continue
        if size > MAX_TERMS:
            yield held, False
            held, size, first = [], 0, False
        held.append((row["item_id"], set(terms(row["text"]))))
        size += len(held[-1][1])
    if held:
        yield held, first


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) its k best of docs (doc_id, text)."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_type}, rank int, doc_id {id_type}, score long"
    out = None
    for block, only in _item_blocks(items):
        number = {t: i for i, t in enumerate(sorted(set().union(*(t for _, t in block))))}
        numbers = spark.sparkContext.broadcast(number)
        counted = written(_counted(docs, numbers), "counted")
        documents, total = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            discard(counted)
            break
        index = written(_index(counted, documents, total).withColumn("first", F.xxhash64("bytes") % PRIMERS == 0), "segments")
        df = np.zeros(len(number), np.int64)
        for t, n in index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df")).collect():  # at most as many as the block has terms
            df[t] = n
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        asked = [np.array(sorted(number[t] for t in words), np.int64) for _, words in block]
        begun = _ranked(_searched(index.where("first"), spark.sparkContext.broadcast([(a, weight[a], 1) for a in asked]), k), k)
        begun = written(begun.select("item", "doc_id", "score"), "primed")
        floors = {r["item"]: r["floor"] for r in begun.groupBy("item").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        queries = spark.sparkContext.broadcast([(a, weight[a], floors.get(i, 1)) for i, a in enumerate(asked)])
        found = _ranked(begun.unionByName(_searched(index.where("not first"), queries, k)), k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item long, item_id {item_type}")
        found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = written(found, "ranked")
        for used in (counted, index, begun):
            discard(used)
        out = found if out is None else out.unionByName(found)
        if only:
            break
    return spark.createDataFrame([], schema) if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN c USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
