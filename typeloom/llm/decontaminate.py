"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike: lower case, every run of other characters than letters and digits one space. An item of m characters may occur in a
document with up to k = floor(max_error * m) edits. Cut into k + 1 pieces, an item with at most k edits keeps one piece whole, so
every such occurrence is found by looking for exact pieces; around each piece hit Myers' bit-parallel algorithm gives the
least edit distance to any stretch of the document, and the pair counts if that is at most k.

Result: one row for each document row and item that match: doc_id, item_id, distance (the least), begin and end of the
leftmost-ending such stretch in the normalised text, item_chars. Defined results: null or empty texts match nothing; items
without letters or digits match nothing; items shorter than 1 / max_error must occur exactly; items that repeat give rows of their own; other
columns are ignored; empty tables give no rows.

Scale: documents are scanned where they are read, without a shuffle, and only matches leave a task. Items go out in blocks of at most BLOCK_CHARS characters; where
there are several, the result of each is written before the next block is read, and the block is destroyed, so that the driver, the tasks and the plan hold
one block whatever the benchmark's size, at the cost of one scan of the documents a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MAX_ERROR = 0.08
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, max_error: float = MAX_ERROR) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 pieces, as equal in length as can be."""
    m, n = len(item), int(max_error * len(item)) + 1
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to any substring of text, smallest end of such a substring)."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | 1 << i
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, ch in enumerate(text, 1):
        e = eq.get(ch, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], max_error: float):
        """items: (row number, text); texts are normalised here."""
        self.items = {n: t for n, text in items if (t := normalise(text))}
        self.k = {n: int(max_error * len(t)) for n, t in self.items.items()}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, t in self.items.items():
            for offset, piece in pieces(t, max_error):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item row number, distance, begin, end) of each item that occurs in text."""
        doc = normalise(text)
        if not doc or not self.any:
            return []
        hits: dict[int, list[int]] = {}
        for last, (size, places) in self.automaton.iter(doc):
            at = last + 1 - size
            for n, offset in places:
                hits.setdefault(n, []).append(at - offset)
        out = []
        for n, starts in hits.items():
            item, k = self.items[n], self.k[n]
            best, found, upto = k + 1, None, -1
            starts.sort()
            i = 0
            while i < len(starts):  # windows around hits, merged where they overlap
                lo, hi = max(0, starts[i] - k), starts[i] + len(item) + k
                while i + 1 < len(starts) and starts[i + 1] - k <= hi:
                    i += 1
                    hi = starts[i] + len(item) + k
                i += 1
                if hi > upto:
                    window = doc[lo:hi]
                    exact = window.find(item)
                    distance, end = (0, exact + len(item)) if exact >= 0 else myers(item, window)
                    if distance < best:
                        best, found, upto = distance, (lo, lo + end), hi
            if found:
                lo, end = found
                back, size = myers(item[::-1], doc[max(0, end - len(item) - k) : end][::-1])
                out.append((n, best, end - size if back == best else max(0, end - len(item)), end))
        return out


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """(item_id, text) lists of at most BLOCK_CHARS characters, or of one item, and whether it is the only one; never more than one in the driver's memory."""
    held, size, first = [], 0, True
    for row in items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row["text"]) > BLOCK_CHARS:
            yield held, False
            held, size, first = [], 0, False
        held.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if held:
        yield held, first


def find_items(docs: DataFrame, items: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """Matches of items (item_id, text) in docs (doc_id, text); see the module's text for the columns."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    schema = f"doc_id {id_type}, n long, distance long, begin long, end long, item_chars long"
    out = None
    for block, only in _blocks(items):
        texts = spark.sparkContext.broadcast([(n, t) for n, (_, t) in enumerate(block)])

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(texts.value, max_error)
            for b in batches:
                rows = [(i, *m) for i, t in enumerate(b.column("text")) for m in matcher.find(t.as_py())]
                at, n, distance, begin, end = ([r[k] for r in rows] for k in range(5))
                ids = b.column("doc_id").take(pa.array(at, pa.int64()))
                numbers = [pa.array(x, pa.int64()) for x in (n, distance, begin, end, [len(matcher.items[k]) for k in n])]
                yield pa.RecordBatch.from_arrays([ids, *numbers], names=["doc_id", "n", "distance", "begin", "end", "item_chars"])

        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"n long, item_id {item_type.simpleString()}")
        found = docs.select("doc_id", "text").mapInArrow(run, schema).join(F.broadcast(names), "n")
        found = found.select("doc_id", "item_id", "distance", "begin", "end", "item_chars")
        if not only:
            found = written(found, "matches")
            texts.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type.simpleString()}, distance long, begin long, end long, item_chars long")
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """The rows of docs in which no item (item_id, text) occurs, with all their columns."""
    spark = docs.sparkSession
    for block, only in _blocks(items):
        texts = spark.sparkContext.broadcast([t for _, t in block])

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(list(enumerate(texts.value)), max_error)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t.as_py()) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = written(docs, "clean")
            texts.destroy()
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
