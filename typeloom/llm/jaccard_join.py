"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word 5-grams; two documents link when their Jaccard similarity is at least 0.8 (compared in
integers). The join is exact and gives the connected components of the links:

1. Documents with equal sets are one node, named by a 64-bit hash of the set; sets that share it but differ in a second
   one are named by the second.
2. Tokens get one global order, rare ones first; a node's prefix is its first n - ceil(0.8 n) + 1 tokens. Two nodes that
   link share a token of both prefixes. Frequent tokens are counted within each task over all documents, and over one
   document in SAMPLED across tasks; any order is exact.
3. Leaders: of the nodes that hold a token, the one with the largest share of prefix tokens that others have as well leads. Each node is compared
   with the leader that it shares most tokens with, and the links found make first components: a star of copies, however large, collapses in one step.
4. Matrix: the nodes of a component, or the small components around one leader, in bands of set size and chunks of about CHUNK nodes,
   are the groups of similar documents; a group's row of the matrix is the union of its members' prefix tokens. Joined by token, a node and a group with
   other components meet where the overlap of the node with the union, plus all that prefixes leave open, can reach the
   needed overlap for the group's range of set sizes. Only the groups that qualify are opened: a cogrouped task builds
   their full unions, bounds again, and counts exact overlaps. Nodes whose prefix tokens all stay within one component need no comparison at all.
5. Components of all links.

Defined results: texts without words, and null texts, have no shingles and are components of their own; texts of fewer
than five words are compared as whole sequences; rows with a null id get a null component and link with
nothing; rows that repeat an id with other texts count as copies of that id each, and its component is the smallest of theirs; other
columns are ignored; an empty table gives an empty table.

Scale: the rows shuffled are a fifth of the shingles (8-byte token, 8-byte node). No pairs within a component are
made, and what meets are nodes and groups, not nodes; a group's queries come CHUNK at a time, a hot group's being dealt to
several tasks. The order's table of frequent tokens is bounded by MAX_FREQUENT, the broadcast nodes and their places by MAX_IDS (beyond it the
texts and sets are joined by shuffle), the sets that share a first hash by MAX_TWICE (about N^2 / 2^65 of N sets do: an error beyond 6e11 sets).
Tables written on the way are deleted as soon as the last step that reads them is over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, slices, table, written
from .components import components
from .shingles import Shingler, node_name, set_hashes

MAX_FREQUENT, FREQUENT, SAMPLED, MAX_IDS, MAX_TWICE, CHUNK = 1_000_000, 8, 64, 1_000_000, 10_000, 256
#: Components of fewer nodes share the groups of their leaders. Ratio of the set sizes in a band.
SMALL, BAND = 32, 1.1
SEGMENT = 4_000_000


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that many documents have, and the binary logarithm of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, across, size = Shingler(), [], [np.zeros(0, np.int64)], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1  # what a task of thousands of texts meets once is no frequent token
            rare = np.concatenate(across)  # but it is one if many tasks meet it
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((tokens[more], rare))), pa.array(np.concatenate((n[more], np.ones(len(rare), np.int64))))], names=["token", "n"])

        for b in slices(batches):
            for t in b.column("text"):
                s = shingler(t.as_py())
                held.append(s)
                size += len(s)
                if len(s) and int(s[0]) % SAMPLED == 0:
                    across.append(s)
                if size >= SEGMENT:
                    yield flush()
                    held, across, size = [], across[:1], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = written(counts, "frequent")
    # the least power of two from which on there are no more than MAX_FREQUENT tokens
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("k")).count().collect()}
    least = next((k for k in sorted(sizes) if sum(v for j, v in sizes.items() if j >= k) <= MAX_FREQUENT), 63)
    found = counts.where(F.floor(F.log2(F.col("n").cast("double"))) >= least).toArrow()
    discard(counts)
    tokens, n = found.column("token").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order].astype(np.int64), np.log2(np.maximum(n[order], 1)).astype(np.int8)


def _signed(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, h, g (two hashes of the set), rare, common (the prefix) for each row of docs; a prefix is null without an id, and in a task's later rows of a set already given with one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(), set()
        tokens, level = frequent.value
        bitmap = np.zeros(1 << 22, bool)
        bitmap[tokens & 0x3FFFFF] = True
        for b in slices(batches):
            sets = [shingler(t.as_py()) for t in b.column("text")]
            n = np.array([len(s) for s in sets])
            every = np.concatenate([*sets, np.zeros(0, np.int64)])
            levels = np.zeros(len(every), np.int8)
            maybe = np.flatnonzero(bitmap[every & 0x3FFFFF])  # few tokens pass, and only these are searched for
            if len(maybe):
                some = every[maybe]
                at = np.minimum(np.searchsorted(tokens, some), len(tokens) - 1)
                levels[maybe] = np.where(tokens[at] == some, level[at], 0)
            ends = np.cumsum(n)
            hashes, prefixes = [set_hashes(s) if k else (None, None) for s, k in zip(sets, n.tolist(), strict=True)], []
            for name, e, k, has_id in zip(hashes, ends.tolist(), n.tolist(), b.column("doc_id").is_valid().to_pylist(), strict=True):
                s = every[e - k : e]
                if not k or not has_id or name in seen:
                    prefixes.append((None, None))
                    continue
                if len(seen) < 1_000_000:
                    seen.add(name)
                p = k - (8 * k + 9) // 10 + 1
                level_of = levels[e - k : e]
                order = np.argsort(level_of, kind="stable")[:p]
                rare = np.count_nonzero(level_of[order] == 0)
                prefixes.append((s[order[:rare]], s[order[rare:]]))
            h, g = (pa.array([x[i] for x in hashes], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), h, g, *(pa.array([x[i] for x in prefixes], pa.list_(pa.int64())) for i in (0, 1))], names=["doc_id", "n", "h", "g", "rare", "common"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, h long, g long, rare array<long>, common array<long>")


def _needed(n: Column, d: Column) -> Column:
    """Shared prefix tokens that nodes of n and d tokens must have at least, if they link (may be below 1)."""
    return F.ceil((n + d) * 4 / 9 - 1e-9) - F.ceil(F.greatest(n, d) * 0.8 - 1e-9) + 1


class _Roots(dict):
    """Components joined within a task."""

    def of(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x


def _open(members: list, queries: list) -> Iterator[tuple[int, int]]:
    """Links of queries (h, comp, tokens) with the group's members (h, comp, tokens), as many as join all components that link."""
    members = sorted({m[0]: m for m in members}.values(), key=lambda m: m[0])
    rows = np.concatenate([m[2] for m in members])
    sizes = np.array([len(m[2]) for m in members])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    union, row_token = (members[0][2], None) if len(members) == 1 else np.unique(rows, return_inverse=True)
    comps, roots = np.array([m[1] for m in members]), _Roots()
    for h, comp, tokens in {q[0]: q for q in queries}.values():
        at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        there = union[at] == tokens
        if 10 * there.sum() < 8 * len(tokens):  # the bound by the group's full union
            continue
        if row_token is None:
            both = np.array([there.sum()])
        else:
            mark = np.zeros(len(union), np.int64)
            mark[at[there]] = 1
            both = np.add.reduceat(mark[row_token], begins)
        for i in np.flatnonzero((100 * both >= 80 * (len(tokens) + sizes - both)) & (comps != comp)):
            x, y = roots.of(int(comps[i])), roots.of(int(comp))
            if x != y:
                roots[x] = y
                yield h, members[i][0]


def _open_pack(places: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) of all groups of a pack."""
    groups: dict[tuple, tuple[list, list]] = {}
    for gid, salt, asks, h, comp, tokens in zip(*(places[c] for c in ("gid", "salt", "asks", "h", "comp", "tokens")), strict=True):
        groups.setdefault((gid, salt), ([], []))[asks].append((h, comp, tokens))
    found = [link for m, q in groups.values() if m and q for link in _open(m, q)]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _verified(docs: DataFrame, asked: DataFrame, members: DataFrame, classes: DataFrame, twice: frozenset) -> DataFrame:
    """a, b links of asked (h, comp, gid) with members (h, comp, gid).

    A group meets CHUNK queries at a time; some such meetings make a pack, as a group of its own costs a task more than its work.
    Sets are made from the texts of the nodes' first documents, and go to their packs in one shuffle."""
    asked = written(asked, "asked")
    load = asked.groupBy("gid").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts"))
    members = members.distinct().join(load, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "h", "comp", F.lit(0).alias("asks"))
    queries = asked.join(load, "gid").select("gid", F.pmod(F.xxhash64("h"), "salts").cast("int").alias("salt"), "h", "comp", F.lit(1).alias("asks"))
    places = written(members.unionByName(queries), "places")
    n = places.count()
    ids = written(places.select("h").distinct().join(classes, "h").select(F.col("rep").alias("doc_id"), "h"), "ids")
    small = F.broadcast if n <= MAX_IDS else lambda df: df
    texts = docs.join(small(ids), "doc_id").select("h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in slices(batches):
            sets = [shingler(t.as_py()) for t in b.column("text")]
            same = [i for i, s in enumerate(sets) if len(s) and node_name(s, twice) == b.column("h")[i].as_py()]  # else a repeated id's other text
            yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(same, pa.int64())), pa.array([sets[i] for i in same], pa.list_(pa.int64()))], names=["h", "tokens"])

    dealt = texts.mapInArrow(run, "h long, tokens array<long>").join(small(places), "h")
    links = written(dealt.groupBy(F.pmod(F.xxhash64("gid", "salt"), F.lit(n // CHUNK + 1))).applyInPandas(_open_pack, "a long, b long"), "links")
    for used in (asked, places, ids):
        discard(used)
    return links


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    return _assigned(docs).select("doc_id", "n_shingles", "component_id")


def _assigned(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, h, g, comp for each row of docs: h, g are hashes of its set, comp names the component's nodes."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    signed = written(_signed(docs, spark.sparkContext.broadcast(_frequent(known))), "signed")
    both = signed.where("h is not null").groupBy("h").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2")
    twice = frozenset(r["h"] for r in both.select("h").limit(MAX_TWICE + 1).collect())
    if len(twice) > MAX_TWICE:
        raise ValueError("too many different sets share a hash")
    name = F.when(F.col("h").isin(sorted(twice)), F.col("g")).otherwise(F.col("h")) if twice else F.col("h")
    rows = written(signed.select("doc_id", "n", "h", "g", name.alias("node")), "rows")
    classes = written(rows.where("doc_id is not null and node is not null").groupBy(F.col("node").alias("h")).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")

    # tokens known to be frequent are shared; of the others, none of which many nodes have, those that two nodes have
    known_rows, same = signed.where("doc_id is not null"), Window.partitionBy("token")
    rare = known_rows.select(F.explode("rare").alias("token"), name.alias("h"), "n").select("*", F.min("h").over(same).alias("lo"), F.max("h").over(same).alias("hi")).where("lo <> hi")
    posting = rare.groupBy("token", "h").agg(F.first("n").alias("n")).unionByName(known_rows.select(F.explode("common").alias("token"), name.alias("h"), "n").groupBy("token", "h").agg(F.first("n").alias("n")))
    shared = written(posting, "shared")
    discard(signed)

    # leaders: of a token's nodes the one that shares most of its prefix; of a node's leaders the one that it shares most tokens with
    held = shared.groupBy("h").agg((F.count("*") / (F.first("n") - F.ceil(F.first("n") * 0.8 - 1e-9) + 1)).alias("part"))
    lead = shared.join(held, "h").groupBy("token").agg(F.max(F.struct("part", "h", "n")).alias("m"))
    offered = shared.join(lead, "token").where("h <> m.h").groupBy("h", "n", F.col("m.h").alias("leader"), F.col("m.n").alias("d")).agg(F.count("*").alias("c"))
    leaders = written(offered.groupBy("h").agg(F.max(F.struct("c", "d", "leader")).alias("x"), F.first("n").alias("n")).select("h", "n", "x.*"), "leaders")
    n, d = F.col("n"), F.col("d")
    asked = leaders.where((10 * n >= 8 * d) & (8 * n <= 10 * d) & (F.col("c") >= _needed(n, d))).select("h", F.col("h").alias("comp"), F.col("leader").alias("gid"))
    links = _verified(known, asked, asked.select(F.col("gid").alias("h"), F.col("gid").alias("comp"), "gid"), classes, twice)
    comps = components(links)

    # the matrix's groups: a large component, or the small ones around one leader, by band of set size and chunk
    sized = comps.join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp").select(F.col("node").alias("h"), "comp", "size")
    nodes = shared.select("h", "n").distinct().join(sized, "h", "left").join(leaders.select("h", "leader"), "h", "left")
    nodes = nodes.select("h", "n", F.coalesce("comp", "h").alias("comp"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.coalesce("leader", "h").alias("leader"))
    own = F.when(F.col("size") < SMALL, F.col("leader")).otherwise(F.col("comp"))
    nodes = written(nodes.select("h", "comp", "size", (F.col("size") < SMALL).alias("small"), own.alias("own"), F.floor(F.log("n") / math.log(BAND)).cast("int").alias("band")), "nodes")
    parts = nodes.groupBy("small", "own", "band").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    gid = F.xxhash64("small", "own", "band", F.pmod(F.xxhash64("h"), "chunks"))
    grouped = nodes.join(parts, ["small", "own", "band"]).select("h", "comp", "size", "small", "own", gid.alias("gid"))
    met = shared.join(grouped, "h")
    mixed = met.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    met = written(met.join(mixed, "token"), "met")
    discard(shared)
    matrix = met.groupBy("token", "gid", F.col("small").alias("g_small"), F.col("own").alias("g_own"), F.when(~F.col("small"), F.col("size")).alias("g_size"))
    matrix = matrix.agg(F.min("n").alias("d1"), F.max("n").alias("d2"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    # of two nodes of small components the one with the smaller group asks, else the one of the smaller component
    asks = F.when(F.col("g_small"), F.col("small") & (F.col("own") <= F.col("g_own"))).otherwise((F.col("size") < F.col("g_size")) | (F.col("size") == F.col("g_size")) & (F.col("comp") < F.col("g_own")))
    other = (F.col("c1") != F.col("comp")) | (F.col("c2") != F.col("comp"))
    met_groups = met.drop("gid").join(matrix, "token").where(asks & other & (10 * n >= 8 * F.col("d1")) & (8 * n <= 10 * F.col("d2")))
    met_groups = met_groups.groupBy("h", "comp", "n", "gid").agg(F.count("*").alias("c"), F.min("d1").alias("d1"), F.max("d2").alias("d2"))
    low, high = F.greatest(F.col("d1").cast("double"), n * 0.8), F.least(F.col("d2").cast("double"), n * 1.25)
    qualify = F.col("c") >= F.least(_needed(n, low), _needed(n, high)) - 1
    more = _verified(known, met_groups.where(qualify).select("h", "comp", "gid"), met.select("h", "comp", "gid"), classes, twice)
    final = components(links.unionByName(more))

    named = classes.join(final.select(F.col("node").alias("h"), "comp"), "h", "left")
    names = named.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("component"))
    named = written(named.join(names, "comp", "left").select(F.col("h").alias("_h"), F.coalesce("component", "rep").alias("component"), F.coalesce("comp", "h").alias("comp")), "named")
    for used in (nodes, leaders, met, links, more, comps, final, classes):
        discard(used)
    out = rows.join(named, F.when(F.col("doc_id").isNotNull(), F.col("node")) == F.col("_h"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "h", "g", "comp")


def _set_key(h, g):
    """A set's two hashes as text; empty without a set."""
    return F.coalesce(F.concat(h.cast("string"), F.lit(":"), g.cast("string")), F.lit(""))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with the _set_key() of each row's text in a column name."""

    @F.pandas_udf("h long, g long")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for texts in batches:
            pairs = [set_hashes(s) if len(s) else (None, None) for s in map(shingler, texts)]
            yield pd.DataFrame({c: pd.array([x[i] for x in pairs], dtype="Int64") for i, c in enumerate("hg")})

    return docs.withColumn(name, hashes("text")).withColumn(name, _set_key(F.col(f"{name}.h"), F.col(f"{name}.g")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component one row with its smallest id, with all its columns; other texts that repeat an id go or stay by their own component. Rows with a null id stay."""
    kept = _assigned(docs).where("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept"), "comp").agg(F.min(_set_key(F.col("h"), F.col("g"))).alias("_kept_set"))
    one = Window.partitionBy("doc_id", "_set").orderBy(F.xxhash64(*docs.columns))
    rest = _keyed(docs.where("doc_id is not null"), "_set").join(kept, (F.col("doc_id") == F.col("_kept")) & (F.col("_set") == F.col("_kept_set")), "left_semi")
    rest = rest.withColumn("_row_of_set", F.row_number().over(one)).where("_row_of_set = 1").select(*docs.columns)
    return rest.unionByName(docs.where("doc_id is null"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
