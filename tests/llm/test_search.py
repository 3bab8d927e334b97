"""Hard negatives, fingerprints and ranked search against brute force and SQL, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same

TEXTS = "doc_id long, text string, rank string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_winnowing", "op13_lexical_search"])
def test_same_as_sql(name, spark, sf):
    from typeloom.llm.registry import QUERIES, SQL

    same(QUERIES[name](spark, sf).toPandas(), connect(sf).sql(SQL[name]).df())


# -- 11 --


def mined(rows, positives=5, negatives=3):
    """The contract by brute force; rows: (id, label, vector)."""
    out = set()
    width = max((len(v) for _, _, v in rows), default=0)
    padded = [(i, label, list(v) + [0] * (width - len(v))) for i, label, v in rows]
    for a, label, q in padded:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, other, v in padded if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fit)}
    return out


@pytest.mark.parametrize(("chunk", "leaf", "spread"), [(2048, 32, 300), (40, 4, 300), (40, 4, 2), (30, 2, 2**26)])
def test_hard_negatives(spark, monkeypatch, chunk, leaf, spread):
    from typeloom.llm import hard_negatives as h

    monkeypatch.setattr(h, "CHUNK", chunk)
    monkeypatch.setattr(h, "LEAF", leaf)
    monkeypatch.setattr(h, "ASKS", 3)
    rng = random.Random(chunk + leaf)
    rows = [(i, rng.randrange(3), [rng.randint(-spread, spread) for _ in range(rng.choice([5, 5, 5, 3, 0]))]) for i in range(400)]
    rows += [(i, i % 2, [spread, 1, 0, 0, 1]) for i in range(400, 600)]  # a third of all rows have one vector
    table = spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, v array<long>, anchor string")
    got = h.hard_negatives(table, F.col("id") % 50 == 0).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == mined(rows)


def test_hard_negatives_odd_rows(spark):
    from typeloom.llm.hard_negatives import hard_negatives

    schema, anchor = "id long, label int, v array<long>", F.col("id") % 50 == 0
    assert hard_negatives(spark.createDataFrame([], schema), anchor).count() == 0
    odd = [(None, 1, [9, 9]), (1, None, [9, 9]), (2, 1, None), (3, 1, [None, 9])]
    good = [(0, 1, [4, 4]), (0, 1, [4, 4]), (5, 1, [4, 3]), (6, 2, [3, 3]), (6, 2, [3, 3]), (7, 1, [-4, -4])]
    got = sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(odd + good, schema), anchor).collect())
    # 6 stands twice, as a row each; the window of the positive 7 (score -32) is empty
    assert got == [(0, 5, 1, 6, 28, 24), (0, 5, 2, 6, 28, 24)]
    with pytest.raises(ValueError, match="long"):
        hard_negatives(spark.createDataFrame([(0, 1, [2**31, 2**31])], schema), anchor)


def test_hard_negatives_query_skips_what_takes_no_part(spark, tmp_path):
    from typeloom.llm.hard_negatives import SQL, op11_hard_negatives

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(3))) for i in range(120)]
    rows += [(150, [float("nan"), 1.0, 1.0, 1.0], 1), (200, [float("inf"), 1.0, 1.0, 1.0], 1), (250, None, 1), (300, [None, 1.0, 1.0, 1.0], 1), (350, [1.0] * 4, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same(op11_hard_negatives(spark, str(tmp_path)).toPandas(), c.sql(SQL).df())


def test_trees_find_what_brute_force_finds():
    """Whole and narrow annuli, in one chunk, with far fewer rows scored than there are where space has few dimensions."""
    from typeloom.llm.hard_negatives import LEAF, Chunk, Space, Tree

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    x = np.floor(200 * x / np.sqrt((x**2).sum(1))[:, None]).astype(int)  # of about one norm, as embeddings are
    space = Space(3, 200, int((x**2).sum(1).max()))
    tree = Tree(space, x.astype(float), LEAF)
    order = np.concatenate(tree.rows)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    shape = {"vantage": place[tree.vantage], "inner": tree.inner, "near": tree.near, "far": tree.far, "sides": np.ravel(tree.sides), "begin": np.cumsum([0, *map(len, tree.rows)])}
    chunk = Chunk(space, order, np.zeros(3000, int), b"".join(space.pack(x[order].tolist())), shape)
    anchors = np.arange(0, 3000, 100)
    s = x[anchors] @ x.T
    own = s[np.arange(len(anchors)), anchors]
    low, high = np.stack((np.full(len(own), -(2**62)), own // 2), 1), np.stack((np.full(len(own), 2**62), own * 9 // 10), 1)
    found = chunk.best(x[anchors].astype(float), anchors, np.zeros(len(anchors), int), low, high, True, 3)
    for w in (0, 1):
        for n, a in enumerate(anchors):
            want = sorted((-int(v), i) for i, v in enumerate(s[n]) if i != a and low[n, w] <= v <= high[n, w])[:3]
            assert [(-v, order[r]) for i, r, v in zip(*found[w], strict=True) if i == n] == want
    assert chunk.opened < len(anchors) * len(tree.rows) / 4


# -- 12 --


def winnowed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    p, b = 1073741789, 911382323
    v = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % p + 1 for w in words]
    if not v:
        return []
    v += [0] * (5 - len(v))
    h = [sum(v[i + j] * pow(b, 4 - j, p) for j in range(5)) % p for i in range(len(v) - 4)]
    kept = set()
    for a in range(max(1, len(h) - 7)):
        kept.add(min((x, -i) for i, x in enumerate(h[a : a + 8], a)))
    return sorted(((x, -i) for x, i in kept), key=lambda y: y[1])


def alike(a, b):
    a, b = {x for x, _ in a}, {x for x, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing(spark, monkeypatch):
    from typeloom.llm import winnowing as w

    monkeypatch.setattr(w, "BUCKET_ROWS", 4)
    rng = random.Random(5)
    words = ["Éa", "b", "tree", "STONE", "tram", "x" * 40, "日本"]
    rows = [(7 * i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 13, 90])))) for i in range(40)]
    rows += [(3, None), (4, ""), (5, " \n\t "), (6, "one"), (12, "a b c d e f g\x0bh " * 30_000), (14, rows[2][1]), (13, "same " * 50)]
    got = {r["doc_id"]: r for r in w.winnow(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string")).collect()}
    ordered = sorted({i: t or "" for i, t in rows}.items())
    for at, (i, t) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited"]) == (len(t), edited)
        for field, text in (("fingerprint", t), ("edited_fingerprint", edited)):
            assert [(x >> 32, 2**32 - 1 - (x & 0xFFFFFFFF)) for x in r[field]] == winnowed(text)
        assert abs(r["near_edited"] - alike(winnowed(t), winnowed(edited))) < 1e-9
        assert abs(r["near_next"] - alike(winnowed(t), winnowed(following))) < 1e-9


def test_winnowing_guarantee(spark):
    """A shared run of WINDOW + GRAM - 1 words shares a fingerprint at places that lie as far apart as the runs."""
    from typeloom.llm.winnowing import GRAM, WINDOW, fingerprints

    rng = random.Random(9)
    pairs = []
    for n in range(60):
        run = [f"r{rng.randrange(4)}" for _ in range(WINDOW + GRAM - 1)]
        a, b = ([f"{side}{rng.randrange(1000)}" for _ in range(rng.randrange(30))] for side in "pq")
        pairs.append((n, " ".join(a + run), " ".join(b + run), len(a) - len(b)))
    table = spark.createDataFrame(pairs, "n long, a string, b string, shift long")
    for r in fingerprints(fingerprints(table, "a", "fa"), "b", "fb").collect():
        a, b = ({(x >> 32, 2**32 - 1 - (x & 0xFFFFFFFF)) for x in r[c]} for c in ("fa", "fb"))
        assert {(h, p - r["shift"]) for h, p in a} & b


def test_winnowing_odd_tables(spark):
    from typeloom.llm.winnowing import shown, winnow

    assert winnow(spark.createDataFrame([], TEXTS)).count() == 0
    (one,) = winnow(spark.createDataFrame([(5, "abcd", None)], TEXTS)).collect()
    assert (one["edited"], one["near_next"]) == ("abab", 1.0)
    rows = winnow(spark.createDataFrame([(None, "no id at all", None), (None, None, None), (1, "b", None), (1, "a", None), (2, "c c", None)], TEXTS))
    got = sorted((r["doc_id"] or 0, r["edited"], r["near_next"]) for r in rows.collect())
    assert got == [(0, "", 0.0), (0, "no id ", 0.0), (1, "a", 0.0), (1, "b", 0.0), (2, "c a", 0.0)]
    assert spark.createDataFrame([([],)], "f array<long>").select(shown(F.col("f"))).first()[0] == ""


# -- 13 --


def ranked(docs, items, k=10):
    """The contract by brute force; docs and items are lists of (id, text)."""

    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in words if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "docs_a_segment", "primers", "most_terms"), [(64, 16_384, 16, 1_000_000), (2, 1005, 2, 1_000_000), (3, 1001, 16, 4)])
def test_search(spark, monkeypatch, block, docs_a_segment, primers, most_terms):
    from typeloom.llm import lexical_search as s

    for name, value in (("BLOCK", block), ("SEGMENT_DOCS", docs_a_segment), ("PRIMERS", primers), ("MAX_TERMS", most_terms)):
        monkeypatch.setattr(s, name, value)
    rng = random.Random(block)
    words = ["tram", "Stone", "é1", "x-y", "7", "tree_", "日本 語", "rare" + "z" * 70_000]
    docs = [(i, " ".join(rng.choices(words, [40, 20, 9, 9, 5, 5, 1, 1], k=rng.choice([1, 2, 30, 300])))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, "!?"), (1003, "tram " * 70_000), (1004, "tram"), (1004, "tram"), (None, "tram"), (None, None)]
    items = [(1, "Tram"), (2, "rare" + "Z" * 70_000 + " x"), (3, None), (4, "nowhere"), (5, "stone, tree 7! TREE"), (6, "é1"), (6, "y 日本"), (None, "7"), (7, "tram tram stone x y é1 7 tree 語")]
    found = s.search(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(5), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"))
    assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items)


def test_search_in_empty_tables(spark):
    from typeloom.llm.lexical_search import search

    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert search(none, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert search(some, none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_blocks_are_opened_only_where_their_bound_reaches_the_threshold(spark):
    """Posting blocks round trip, and most stay compressed where a few documents score far above the rest."""
    from typeloom.llm import lexical_search as s

    for gaps, tf in (([1], [1]), ([1, 300, 70_000], [2, 1, 5]), ([255] * 64, [256] * 64)):
        a, b = s.unpack(s.pack(np.array(gaps), np.array(tf)))
        assert (a.tolist(), b.tolist()) == (gaps, tf)
    rows = [(i, 100, [0], [50 if i in (40, 41) else 1]) for i in range(10_000)]
    counted = spark.createDataFrame(rows, "doc_id long, n long, held array<int>, tf array<int>").coalesce(1)
    (row,) = s._index(counted, 10_000, 1_000_000).collect()
    segment = s.Segment({c: np.array(row[c]) for c in s._LISTS} | {"bytes": bytes(row["bytes"])})
    docs, scores = segment.best(np.array([0]), np.array([7]), 2)
    assert docs.tolist() == [40, 41] and scores[0] == 7 * s.impact(np.array([50]), np.array([100]))[0]
    assert len(segment.opened) <= 8 < len(row["last"])
