"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row is an id, a label and a vector of integers; the score of two rows is their inner product. With M the largest norm of all rows, a row v becomes
(v, sqrt(M^2 - |v|^2)) and an anchor q becomes (q, 0): then distance^2 = |q|^2 + M^2 - 2 score, so the best scores are the nearest rows and a window of
scores is an annulus around the anchor. An anchor's positives are its best rows of the same label; for each of them, the best rows of another label whose score lies within
low to high percent of the positive's are its hard negatives. Higher scores come first, equal ones by smaller id.

1. Top tree: a vantage-point tree over at most SAMPLE rows cuts space into leaves; every row is indexed, it goes to its leaf by the tree's radii, which bound all rows and not the
   sample alone. A leaf of more than CHUNK rows is dealt to several chunks, so equal vectors, however many, share none.
2. A chunk has a vantage-point tree of its own, with the least and greatest distance of either side of a vantage point.
3. An anchor first meets the chunk that it lies in. What it finds there narrows its annulus before it meets the other chunks, of which the top
   tree leaves those whose leaf can hold a row in it.
4. In a chunk anchors walk the tree's leaves nearest first, by the lower bounds of the path to each, together: leaves outside an anchor's annulus are never opened for it, the k-th row found
   pulls the outer radius in, and the walk ends beyond it.

The search is exact: recall is 1. Radii only prune, with a margin for rounding; rows are compared by integer scores.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of other lengths count as if zeros followed; an anchor's
positives and negatives never have its own id; rows that repeat an id are rows each, equal anchor rows are one anchor; an anchor without positives, or whose windows hold
no row, has no rows; scores that would not fit a long are an error; other columns are ignored; an empty table gives no rows.

Scale: vectors are stored in the fewest bytes that hold their components. Anchors travel to chunks (ASKS of them at a time make a row, so that a chunk asked by all is dealt to many tasks), and k rows a window
come back, cut to the k best before they are shuffled. The sample, the top tree and the sizes of its at most MAX_LEAVES leaves are all that the driver holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hash_sample, slices, table, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
SAMPLE, MAX_LEAVES, CHUNK, LEAF, ASKS = 8192, 512, 2048, 32, 256


class Space:
    """How vectors are stored and multiplied, and the distances of the augmented space."""

    def __init__(self, length: int, most: int, square: int):
        self.length, self.square = max(length, 1), square
        self.stored = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
        self.number = np.float64 if square < 1 << 52 else np.int64  # products of floats are exact below 2^53
        self.margin = 1e-6 * (1 + math.sqrt(square))

    def pack(self, vectors: list) -> list[bytes]:
        return [(np.array(v, self.stored) if len(v) == self.length else np.concatenate((v, np.zeros(self.length - len(v)))).astype(self.stored)).tobytes() for v in vectors]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), self.stored).reshape(len(packed), self.length).astype(self.number)

    def lift(self, x: np.ndarray) -> np.ndarray:
        """The component that the augmented rows have more."""
        return np.sqrt(np.maximum(float(self.square) - (x.astype(np.float64) ** 2).sum(1), 0))

    def between(self, x: np.ndarray, up: np.ndarray, y: np.ndarray, y_up: np.ndarray) -> np.ndarray:
        """Distances of augmented rows x to augmented rows y."""
        return np.sqrt(np.maximum(2 * (float(self.square) - x.astype(np.float64) @ y.astype(np.float64).T - up[:, None] * y_up), 0))

    def from_score(self, own: float, score):
        """Distance to an anchor of squared norm own at which a row has the score."""
        return np.sqrt(np.maximum(own + float(self.square) - 2.0 * np.asarray(score, np.float64), 0))


class Tree:
    """A vantage-point tree over x: per node its vantage point (a row), the reach of its inner side, the reach of its outer one, and its sides: a node, or ~leaf."""

    def __init__(self, space: Space, x: np.ndarray, leaf: int, leaves: int = 1 << 30):
        up = space.lift(x)
        self.vantage, self.inner, self.near, self.far, self.sides, self.rows = [], [], [], [], [], []
        waiting = [(np.arange(len(x)), None)]
        while waiting:
            rows, above = waiting.pop(0)  # level by level, so that a bound on leaves leaves them even
            node = None
            if len(rows) > leaf and len(self.rows) + len(waiting) + 2 <= leaves:
                point = rows[space.between(x[rows[:1]], up[rows[:1]], x[rows], up[rows])[0].argmax()]
                d = space.between(x[[point]], up[[point]], x[rows], up[rows])[0]
                radius = np.median(d)
                inside = d <= radius
                if not inside.all():
                    node = len(self.vantage)
                    self.vantage.append(int(point))
                    self.inner.append(float(d[inside].max()))
                    self.near.append(float(d[~inside].min()))
                    self.far.append(float(d.max()))
                    self.sides.append([0, 0])
                    waiting += [(rows[inside], (node, 0)), (rows[~inside], (node, 1))]
            if node is None:
                node = ~len(self.rows)
                self.rows.append(rows)
            if above:
                self.sides[above[0]][above[1]] = node


class TopTree:
    """The tree over the sample, without its rows: a row is inside a vantage point's radius or not, whether sampled or not."""

    def __init__(self, space: Space, x: np.ndarray, leaves: int):
        tree = Tree(space, x, 4, leaves)
        self.space, self.x = space, x[tree.vantage]
        self.up, self.radius, self.sides, self.leaves = space.lift(self.x), np.array(tree.inner), tree.sides, len(tree.rows)
        self.paths: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]
        waiting = [(0, [])] if tree.vantage else []
        while waiting:
            node, path = waiting.pop()
            for side, to in enumerate(self.sides[node]):
                if to < 0:
                    self.paths[~to] = [*path, (node, side)]
                else:
                    waiting.append((to, [*path, (node, side)]))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64) if len(self.x) else np.full(len(x), -1)
        inside = self.space.between(x, self.space.lift(x), self.x, self.up) <= self.radius if len(self.x) else None
        sides = np.array(self.sides)
        while (at >= 0).any():
            on = np.flatnonzero(at >= 0)
            at[on] = sides[at[on], np.where(inside[on, at[on]], 0, 1)]
        return ~at

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance at which each anchor can have rows of each leaf."""
        d = self.space.from_score((x.astype(np.float64) ** 2).sum(1)[:, None], x.astype(np.float64) @ self.x.astype(np.float64).T)
        least, most = np.zeros((len(x), self.leaves)), np.full((len(x), self.leaves), np.inf)
        for leaf, path in enumerate(self.paths):
            for node, side in path:
                r = self.radius[node]
                least[:, leaf] = np.maximum(least[:, leaf], d[:, node] - r if side == 0 else r - d[:, node])
                if side == 0:
                    most[:, leaf] = np.minimum(most[:, leaf], d[:, node] + r)
        return least, most


class Chunk:
    """The rows of a chunk in the order of their leaves, and its tree."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: bytes, tree: dict):
        self.space, self.ids, self.labels = space, ids, labels
        self.place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        self.x = np.frombuffer(vectors, space.stored).reshape(len(ids), space.length).astype(space.number)
        self.vantage, self.inner, self.near, self.far = (np.asarray(tree[c]) for c in ("vantage", "inner", "near", "far"))
        self.sides, self.begin = np.asarray(tree["sides"]).reshape(-1, 2).tolist(), np.asarray(tree["begin"]).tolist()
        self.points, self.opened = self.x[self.vantage], 0

    def reach(self, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance at which each anchor can have rows of each leaf."""
        leaves = len(self.begin) - 1
        least, most = np.zeros((len(q), leaves)), np.full((len(q), leaves), np.inf)
        d = self.space.from_score(own[:, None], q @ self.points.T)
        above = {0: (np.zeros(len(q)), np.full(len(q), np.inf))}
        for node, sides in enumerate(self.sides):  # a node stands after the one above it
            low, high = above.pop(node)
            inside = np.maximum(low, d[:, node] - self.inner[node]), np.minimum(high, d[:, node] + self.inner[node])
            outside = np.maximum(np.maximum(low, self.near[node] - d[:, node]), d[:, node] - self.far[node]), np.minimum(high, d[:, node] + self.far[node])
            for to, bounds in zip(sides, (inside, outside), strict=True):
                if to < 0:
                    least[:, ~to], most[:, ~to] = bounds
                else:
                    above[to] = bounds
        return least, most

    def best(self, q: np.ndarray, own_ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) for each window: the k first rows of the same or another label with low <= score <= high. low, high: by anchor and window.

        All anchors walk together, each nearest leaf first, some leaves at a time and then twice as many: a leaf is opened for the anchors of which a window's annulus, as narrow as
        what they have found made it, reaches into it."""
        own, low, margin = (q.astype(np.float64) ** 2).sum(1), low.copy(), self.space.margin
        least, most = self.reach(q, own)
        inner = self.space.from_score(own[:, None], high) - margin
        nearest, anchors = np.argsort(least, axis=1, kind="stable"), np.arange(len(q))[:, None]
        kept = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(low.shape[1])]
        at, step = 0, 4
        while at < least.shape[1]:
            outer = np.where(low <= high, self.space.from_score(own[:, None], low) + margin, -1.0)
            if not (np.take_along_axis(least, nearest[:, at : at + 1], 1) <= outer.max(1, keepdims=True)).any():
                break
            turn = np.zeros(least.shape, bool)
            turn[anchors, nearest[:, at : at + step]] = True
            reached = np.zeros(least.shape, bool)
            for w in range(low.shape[1]):
                reached |= (least <= outer[:, w : w + 1]) & (most >= inner[:, w : w + 1])
            turn &= reached
            floor, roof, met = low.min(1), high.max(1), []
            for leaf in np.flatnonzero(turn.any(0)).tolist():
                who, a, b = np.flatnonzero(turn[:, leaf]), self.begin[leaf], self.begin[leaf + 1]
                s = (q[who] @ self.x[a:b].T).astype(np.int64)
                fit = (s >= floor[who, None]) & (s <= roof[who, None]) & ((self.labels[None, a:b] == labels[who, None]) == same) & (self.ids[None, a:b] != own_ids[who, None])
                i, j = np.nonzero(fit)
                met.append((who[i], a + j, s[i, j]))
                self.opened += len(who)
            at, step = at + step, 2 * step
            if not met:
                continue
            who, row, score = (np.concatenate([m[i] for m in met]) for i in range(3))
            for w in range(low.shape[1]):
                new = (score >= low[who, w]) & (score <= high[who, w])
                if not new.any():
                    continue
                a, r, s = (np.concatenate((old, x[new])) for old, x in zip(kept[w], (who, row, score), strict=True))
                order = np.lexsort((self.place[r], -s, a))
                a, r, s = a[order], r[order], s[order]
                starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                n = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(a)]))))
                last = n == k - 1  # the k-th row found pulls the outer radius in
                low[a[last], w] = np.maximum(low[a[last], w], s[last])
                kept[w] = a[n < k], r[n < k], s[n < k]
        return kept


_TREE = "vantage array<int>, inner array<double>, near array<double>, far array<double>, sides array<int>, begin array<int>"


def _chunks(indexed: DataFrame, space: Space) -> DataFrame:
    """One row a chunk: its rows by leaf, and its tree."""
    id_type, label_type = (indexed.schema[c].dataType.simpleString() for c in ("id", "label"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable", ignore_index=True)
        x = space.unpack(rows["v"].tolist())
        tree = Tree(space, x, LEAF)
        order = np.concatenate(tree.rows)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out = {
            "chunk": rows["chunk"][0], "ids": rows["id"].to_numpy()[order], "labels": rows["label"].to_numpy()[order], "vectors": b"".join(rows["v"].to_numpy()[order]),
            "vantage": place[tree.vantage] if tree.vantage else np.zeros(0, np.int64), "inner": tree.inner, "near": tree.near, "far": tree.far,
            "sides": [x for pair in tree.sides for x in pair], "begin": np.cumsum([0, *map(len, tree.rows)]),
        }
        return pd.DataFrame({c: [v] for c, v in out.items()})

    return indexed.groupBy("chunk").applyInPandas(build, f"chunk int, ids array<{id_type}>, labels array<{label_type}>, vectors binary, {_TREE}")


def _routed(asked: DataFrame, top, sizes: DataFrame, at_home: bool) -> DataFrame:
    """asked with the chunks to ask: an anchor's own, or those others that may hold a row of one of its windows."""
    if at_home:
        return asked.withColumn("ask", F.col("chunk"))
    leaves = "leaves array<int>"
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in asked.schema)}, {leaves}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = top.value
        space = tree.space
        for b in slices(batches):
            x = space.unpack(b.column("v").to_pylist())
            own = (x.astype(np.float64) ** 2).sum(1)
            least, most = tree.reach(x) if b.num_rows else (np.zeros((0, 0)), np.zeros((0, 0)))
            picked = []
            for i, wants in enumerate(b.column("wants").to_pylist()):
                outer, inner = (space.from_score(own[i], [w[c] for w in wants]) for c in ("low", "high"))
                open_ = ((least[i][None] <= outer[:, None] + space.margin) & (most[i][None] >= inner[:, None] - space.margin)).any(0)
                picked.append(np.flatnonzero(open_))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(picked, pa.list_(pa.int32()))], names=[*b.schema.names, "leaves"])

    routed = asked.mapInArrow(run, schema).select(*asked.columns, F.explode("leaves").alias("leaf")).join(F.broadcast(sizes), "leaf")
    routed = routed.select(*asked.columns, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("chunks") - 1)).alias("ask"))
    return routed.where(F.col("ask") != F.col("chunk"))


def _found(routed: DataFrame, chunks: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """anchor, key, tag, id, score: for each window (tag) of each anchor asked the k first rows of the chunk."""
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    asks = routed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(1 << 20)))
    load = asks.groupBy("ask").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    asks = asks.join(load, "ask").groupBy("ask", (F.col("salt") % F.col("parts")).alias("part")).agg(F.collect_list(F.struct("anchor", "key", "label", "v", "wants")).alias("asked"))
    met = asks.join(chunks, F.col("ask") == F.col("chunk")).select("asked", *[c for c in chunks.columns if c != "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = {c: b.column(c)[0] for c in b.schema.names}
            ids = row["ids"].values
            tree = {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("vantage", "inner", "near", "far", "sides", "begin")}
            chunk = Chunk(space, ids.to_numpy(zero_copy_only=False), row["labels"].values.to_numpy(zero_copy_only=False), row["vectors"].as_py(), tree)
            asked = row["asked"].values
            column = lambda c: asked.field(c)
            wants = column("wants").to_pylist()
            windows = max(map(len, wants))
            low, high = np.full((len(wants), windows), 2**62), np.full((len(wants), windows), -(2**62))  # what an anchor has no window for is an empty one
            for i, some in enumerate(wants):
                for j, w in enumerate(some):
                    low[i, j], high[i, j] = w["low"], w["high"]
            plain = [column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "label")]
            for j, (who, at, score) in enumerate(chunk.best(space.unpack(column("v").to_pylist()), *plain, low, high, same, k)):
                who_ = pa.array(who)
                tags = pa.array([wants[i][j]["tag"] for i in who.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([column("anchor").take(who_), column("key").take(who_), tags, ids.take(pa.array(at)), pa.array(score)], names=["anchor", "key", "tag", "id", "score"])

    return met.mapInArrow(run, f"anchor {id_type}, key long, tag int, id {id_type}, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "key", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _search(asked: DataFrame, chunks: DataFrame, top, sizes: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """anchor, key, tag, id, score, n: for each window of each anchor the k first rows of all chunks. asked: anchor, key, label, v, chunk, wants."""
    near = written(_found(_routed(asked, top, sizes, True), chunks, space, same, k), "near")
    floor = near.groupBy("anchor", "key", "tag").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
    floors = floor.groupBy("anchor", "key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "floor"))).alias("floors"))
    rest = asked.join(floors, ["anchor", "key"], "left")
    narrowed = F.transform("wants", lambda w: F.struct(w.tag.alias("tag"), F.greatest(w.low, F.get(F.map_values(F.map_filter("floors", lambda t, _: t == w.tag)), F.lit(0))).alias("low"), w.high.alias("high")))
    far = _found(_routed(rest.withColumn("wants", narrowed).select(*asked.columns), top, sizes, False), chunks, space, same, k)
    out = written(_first(near.unionByName(far), k), "first")
    discard(near)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (id, label, v: array of integers) where is_anchor, a Column over id, holds."""
    spark = rows.sparkSession
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    rows = rows.select("id", "label", F.col("v").cast("array<long>").alias("v")).where(F.coalesce(usable, F.lit(False)))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    n, length, largest, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square), F.max(most)).first()
    if not n:
        return spark.createDataFrame([], f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score long, negative_score long")
    if largest >= 2.0**62:
        raise ValueError("scores do not fit a long")
    space = Space(length, longest, int(largest) if largest < 2**53 else int(largest * (1 + 2**-40)))
    sample = hash_sample(rows, "id", SAMPLE).select("v").limit(2 * SAMPLE).toArrow().column("v").to_pylist()
    tree = TopTree(space, space.unpack(space.pack(sample)), max(1, min(MAX_LEAVES, n // CHUNK)))
    top = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            packed = space.pack(b.column("v").to_pylist())
            leaf = top.value.leaf(space.unpack(packed)) if packed else []
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(packed, pa.binary()), pa.array(leaf, pa.int32())], names=["id", "label", "v", "leaf"])

    indexed = written(rows.mapInArrow(index, f"id {id_type}, label {label_type}, v binary, leaf int"), "indexed")
    first, sizes = 0, []
    for leaf, size in sorted(tuple(r) for r in indexed.groupBy("leaf").count().collect()):  # at most MAX_LEAVES
        sizes.append((leaf, first, -(-size // CHUNK)))
        first += sizes[-1][2]
    sizes = spark.createDataFrame(sizes, "leaf int, first int, chunks int")
    placed = indexed.join(F.broadcast(sizes), "leaf").withColumn("key", F.xxhash64("id", "label", "v"))
    placed = placed.select("id", "label", "v", "key", (F.col("first") + F.pmod("key", F.col("chunks"))).cast("int").alias("chunk"))
    chunks = written(_chunks(placed.drop("key"), space), "chunks")

    anchors = placed.where(is_anchor).withColumnRenamed("id", "anchor").dropDuplicates(["anchor", "key"])
    want = lambda tag, least, most: F.struct(tag.cast("int").alias("tag"), least.cast("long").alias("low"), most.cast("long").alias("high"))
    asked = anchors.withColumn("wants", F.array(want(F.lit(0), F.lit(-(2**62)), F.lit(2**62))))
    found = _search(asked, chunks, top, sizes, space, True, positives)
    # floor of high percent and ceiling of low percent, in integers
    least = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)")
    most_ = F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    windows = found.groupBy("anchor", "key").agg(F.collect_list(want(F.col("n"), least, most_)).alias("wants"))
    windows = windows.withColumn("wants", F.filter("wants", lambda w: w.low <= w.high)).where(F.size("wants") > 0)
    mined = _search(anchors.join(windows, ["anchor", "key"]), chunks, top, sizes, space, False, negatives)
    best = found.select("anchor", "key", F.col("n").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.withColumnRenamed("score", "negative_score").join(best, ["anchor", "key", "tag"])
    out = written(out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("n").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", "negative_score"), "mined")
    for used in (indexed, chunks, found, mined):
        discard(used)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return hard_negatives(rows, F.col("id") % 50 == 0)


SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
m AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""
