"""Graphs in adjacency-list columns: completion, checks, traversal, layers.

Reachability and ways are frontier loops of equi-joins; each round is written to spark.checkpoint.dir (reliable storage), so plans stay short
and a lost executor costs one round. Joins of rounds are merge joins: a broadcast a round would add up in the driver. Visited nodes leave the frontier, so cycles end them. Layers, cycles and pre-order do not
walk level by level: runs of nodes with one parent are contracted by pointer doubling, and the pre-order of a forest is the rank of its edges on an Euler tour, so a chain
of n nodes takes about log2(n) rounds. Pre-order of other graphs is sequential by nature and made inside the group of one start node, whose size the caller bounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered
from .stable import cut


# -- rows --


def parents(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


children = neighbours = parents


def is_root(parents_column: Column) -> Column:
    return F.coalesce(F.size(parents_column), F.lit(0)) <= 0


is_leaf = is_root


def edge_key(a: Column, b: Column) -> Column:
    return F.concat_ws("__", a, b)


def undirected_edge_key(a: Column, b: Column) -> Column:
    """Lower end first, by bytes."""
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def split_edge_key(c: Column) -> Column:
    """struct<a, b>, cut at the first "__"."""
    at = F.instr(c, F.lit("__"))
    return F.when(at > 0, F.struct(F.substring(c, F.lit(1), at - 1).alias("a"), F.substring(c, at + 2, F.octet_length(c)).alias("b")))


# -- edges --


def edges_of(nodes: DataFrame, key: str, links: str) -> DataFrame:
    """src, dst, pos for each entry of the list column."""
    return nodes.select(F.col(key).alias("src"), F.posexplode(links).alias("pos", "dst")).select("src", "dst", "pos")


def _appended(nodes: DataFrame, key: str, links: str, extra: DataFrame) -> DataFrame:
    """nodes with the missing entries of extra (src, dst) put at the end of the list, in byte order; unknown src are left out."""
    more = extra.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("_more"))
    out = nodes.join(more, nodes[key] == more["src"], "left")
    base = F.coalesce(F.col(links), F.array().cast(nodes.schema[links].dataType))
    full = F.concat(base, F.array_except(F.coalesce("_more", F.array().cast(nodes.schema[links].dataType)), base))
    return out.select(*[full.alias(c) if c == links else F.col(c) for c in nodes.columns])


def complete_undirected(nodes: DataFrame, key: str, links: str) -> DataFrame:
    """Each link in both ends' lists; self-loops add nothing, links to unknown nodes stay as they are."""
    e = edges_of(nodes, key, links).where("src <> dst")
    return _appended(nodes, key, links, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def complete_directed(nodes: DataFrame, key: str, children_col: str, parents_col: str) -> DataFrame:
    """Parents completed from children, then children from parents."""
    down = edges_of(nodes, key, children_col)
    up = edges_of(nodes, key, parents_col)
    nodes = _appended(nodes, key, parents_col, down.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _appended(nodes, key, children_col, up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def dangling(nodes: DataFrame, key: str, links: str) -> DataFrame:
    """src, dst of links to nodes that are not there."""
    e = edges_of(nodes, key, links)
    return e.join(nodes.select(F.col(key).alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def edge_problems(nodes: DataFrame, key: str, links: str, edges: DataFrame, edge_col: str) -> DataFrame:
    """edge, problem: edges whose end is no node, or whose first end does not list the second."""
    e = edges.select(F.col(edge_col).alias("edge"), split_edge_key(F.col(edge_col)).alias("k")).select("edge", "k.a", "k.b")
    names = nodes.select(F.col(key).alias("n"), F.coalesce(F.col(links), F.array().cast(nodes.schema[links].dataType)).alias("l"))
    first = names.select(F.col("n").alias("a"), F.col("l").alias("la"))
    second = names.select(F.col("n").alias("b"), F.col("l").alias("lb"))
    both = e.join(first, "a", "left").join(second, "b", "left")
    problem = F.when(F.col("la").isNull() | F.col("lb").isNull(), "unknown node").when(~F.array_contains("la", F.col("b")), "not linked")
    return both.select("edge", problem.alias("problem")).where("problem is not null")


def edge_for_link(edges: DataFrame, edge_col: str, links: DataFrame) -> DataFrame:
    """src, dst, edge: the edge row a__b, or b__a where that is not there."""
    e = edges.select(F.col(edge_col).alias("edge"))
    wanted = links.select("src", "dst", F.explode(F.array(F.struct(F.lit(0).alias("r"), edge_key(F.col("src"), F.col("dst")).alias("k")), F.struct(F.lit(1).alias("r"), edge_key(F.col("dst"), F.col("src")).alias("k")))).alias("w"))
    return wanted.join(e, F.col("w.k") == F.col("edge")).groupBy("src", "dst").agg(F.min_by("edge", "w.r").alias("edge"))


def tree_shape(nodes: DataFrame, parents_col: str) -> DataFrame:
    """One row: n_roots, max_parents, ok (at most one parent each, exactly one root)."""
    n = F.coalesce(F.size(parents_col), F.lit(0))
    n = F.greatest(n, F.lit(0))
    out = nodes.agg(F.count_if(n == 0).alias("n_roots"), F.coalesce(F.max(n), F.lit(0)).alias("max_parents"))
    return out.withColumn("ok", (F.col("n_roots") == 1) & (F.col("max_parents") <= 1))


# -- traversal --


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """start, node, depth: every node reachable from each start (column node of starts) and its least distance; the start has 0."""
    e = cut(edges.select("src", "dst").distinct())
    seen = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e.hint("merge"), frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return bfs(edges, starts).where("start <> node")


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return descendants(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts)


def _first_way(e: DataFrame, paths: DataFrame, goal, max_depth: int | None = None) -> DataFrame:
    """Of the ways over the distinct edges e that go on from the frontier paths (node, path), the first to come to goal, or no row."""
    seen, depth = paths.select("node"), 0
    while (max_depth is None or depth < max_depth) and paths.where(F.col("node") == F.lit(goal)).isEmpty():
        depth += 1
        step = paths.join(e.hint("merge"), paths["node"] == e["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        paths = cut(step.join(seen.hint("merge"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if paths.isEmpty():
            break
        seen = cut(seen.unionByName(paths.select("node")))
    return paths.where(F.col("node") == F.lit(goal))


def shortest_path(edges: DataFrame, start, goal, max_depth: int | None = None) -> DataFrame:
    """start, goal, path (both ends included), or no row where there is none (of at most max_depth edges, if given): one predecessor is kept for each node reached."""
    e = cut(edges.select("src", "dst").distinct())
    kind = e.schema["src"].dataType
    first = e.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    return _first_way(e, first, goal, max_depth).select(F.lit(start).alias("start"), F.lit(goal).alias("goal"), "path")


def in_cycles(edges: DataFrame) -> DataFrame:
    """src, dst of the edges on or between cycles: those whose ends can both be reached from a cycle and can both reach one."""
    e = cut(edges.select("src", "dst").distinct())
    for src, dst in (("src", "dst"), ("dst", "src")):
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        free = layers(nodes, e.select(F.col(src).alias("src"), F.col(dst).alias("dst"))).select(F.col("node").alias("src")).hint("merge")
        e = cut(e.join(free, "src", "left_anti").join(free.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    return e


def find_cycle(edges: DataFrame) -> DataFrame:
    """path of one cycle (its first node again at the end), or no row: the shortest way back to the smallest node on a cycle."""
    e = in_cycles(edges)
    node = cut(e.join(e.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").select("src").distinct())
    # one node at a time comes to the driver: those before the first on a cycle lie between two cycles
    while (least := node.agg(F.min("src").alias("src")).first()["src"]) is not None:
        first = cut(e.where(F.col("src") == F.lit(least)).select(F.col("dst").alias("node"), F.array("src", "dst").alias("path")))
        back = _first_way(e, first, least)
        if not back.isEmpty():
            return back.select("path")
        node = node.where(F.col("src") > F.lit(least))
    return e.select(F.array("src").alias("path")).limit(0)


def is_acyclic(edges: DataFrame) -> bool:
    return in_cycles(edges).isEmpty()


def _contracted(f: DataFrame) -> DataFrame:
    """f (node, up, w, c: the node's layer is max(c, up's layer + w)) with up beyond all nodes of f, by pointer doubling, and held: whether up is still in f, as it is on cycles of f and below them.

    Rows that have come to their end join no more, so that no round gathers all rows below one node."""
    n, span = f.count(), 1
    inner = f.select(F.col("node").alias("up"), F.lit(True).alias("held"))
    f = cut(f.join(inner.hint("merge"), "up", "left").select("node", "up", "w", "c", F.coalesce("held", F.lit(False)).alias("held")))
    while span <= 2 * n and not f.where("held").isEmpty():
        step = f.select(F.col("node").alias("up"), F.col("up").alias("up_up"), F.col("w").alias("up_w"), F.col("c").alias("up_c"), F.col("held").alias("up_held"))
        moved = f.where("held").join(step.hint("merge"), "up")
        moved = moved.select("node", F.col("up_up").alias("up"), (F.col("w") + F.col("up_w")).alias("w"), F.greatest("c", F.col("up_c") + F.col("w")).alias("c"), F.col("up_held").alias("held"))
        f = cut(f.where("not held").unionByName(moved))
        span *= 2
    return f


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, layer of an acyclic graph: 0 without parents, else one more than the deepest parent. Nodes on cycles, or below one, are left out.

    In turns, nodes with one parent left are set aside with their layer as a function of the first ancestor that has not just one (runs of them, however long, by doubling), and nodes without parents get
    theirs. The turns grow with the depth of the graph counted in nodes that keep several parents, and forests take one."""
    left = cut(nodes.select("node").distinct().withColumn("c", F.lit(0)))
    e = cut(edges.select("src", "dst", F.lit(1).alias("w")).distinct())
    aside, done, stuck = [], None, None
    while True:
        single = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up"), F.min("w").alias("w")).where("n = 1").drop("n").join(left.hint("merge"), "node")
        single = cut(single if stuck is None else single.join(stuck.hint("merge"), "node", "left_anti"))
        if not single.isEmpty():
            f = _contracted(single)
            more, f = f.where("held").select("node"), f.where("not held").drop("held")
            stuck = more if stuck is None else cut(stuck.union(more))
            aside.append(f)
            left = left.join(f.select("node").hint("merge"), "node", "left_anti")
            e = e.join(f.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti")
            links = e.join(f.select(F.col("node").alias("src"), "up", F.col("w").alias("up_w"), F.col("c").alias("up_c")).hint("merge"), "src", "left")
            links = cut(links.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"), (F.col("up_c") + F.col("w")).alias("least")))
            least = links.groupBy(F.col("dst").alias("node")).agg(F.max("least").alias("least"))
            left = cut(left.join(least.hint("merge"), "node", "left").select("node", F.greatest("c", F.coalesce("least", F.lit(0))).alias("c")))
            e = cut(links.groupBy("src", "dst").agg(F.max("w").alias("w")))
        ready = cut(left.join(e.select(F.col("dst").alias("node")).distinct().hint("merge"), "node", "left_anti"))
        if ready.isEmpty():
            break
        done = ready if done is None else cut(done.union(ready))
        pushed = e.join(ready.select(F.col("node").alias("src"), "c").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("c") + F.col("w")).alias("least"))
        left = left.join(ready.select("node").hint("merge"), "node", "left_anti").join(pushed.hint("merge"), "node", "left")
        left = cut(left.select("node", F.greatest("c", F.coalesce("least", F.lit(0))).alias("c")))
        e = cut(e.join(ready.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti"))
    done = left.limit(0) if done is None else done
    for f in reversed(aside):
        below = f.join(done.select(F.col("node").alias("up"), F.col("c").alias("up_c")).hint("merge"), "up")
        done = cut(done.union(below.select("node", F.greatest("c", F.col("up_c") + F.col("w")).alias("c"))))
    return done.select("node", F.col("c").cast("int").alias("layer"))


def bfs_layers(nodes: DataFrame, edges: DataFrame, component: DataFrame) -> DataFrame:
    """node, component, layer: distance from the smallest node of each component (node, component), links taken both ways."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    starts = component.groupBy("component").agg(F.min("node").alias("node"))
    reached = bfs(both, starts)
    return component.join(reached.select("node", F.col("depth").alias("layer")), "node", "left").select("node", "component", "layer")


def preorder(edges: DataFrame) -> DataFrame:
    """node, root, at, size of each node of a forest (src, dst, pos; no node has two parents, no cycles): its place in its tree's pre-order, the root's being 0, and the nodes of its subtree.

    Each edge stands twice on the tour, down and up; after the way down comes the way to the first child, else up; after the way up that to the next sibling, else up from the parent. The ways
    down that follow each step to the end of the tour are counted by pointer doubling; siblings follow each other in the numbered edges, so no node's children are gathered."""
    at = cut(numbered(edges.select("src", "dst", "pos"), ["src", "pos", "dst"], "_n"))
    following = at.select(F.col("src").alias("n_src"), F.col("dst").alias("n_dst"), (F.col("_n") - 1).alias("_n"))
    at = at.join(following.hint("merge"), "_n", "left").select("src", "dst", "_n", F.when(F.col("src") == F.col("n_src"), F.col("n_dst")).alias("sibling"))
    first = at.groupBy(F.col("src").alias("dst")).agg(F.min_by("dst", "_n").alias("child"))
    above = at.select(F.col("dst").alias("src"), F.lit(True).alias("inner"))
    tour = at.join(first.hint("merge"), "dst", "left").join(above.hint("merge"), "src", "left")
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    down = F.struct(F.col("dst").alias("node"), no.alias("up"), F.coalesce("child", "dst").alias("to"), F.col("child").isNull().alias("to_up"), F.lit(1).cast("long").alias("n"), F.lit(None).cast(at.schema["src"].dataType).alias("root"))
    last = F.col("sibling").isNull() & F.col("inner").isNull()
    onward = F.when(F.col("sibling").isNotNull(), F.col("sibling")).when(F.col("inner"), F.col("src"))
    up = F.struct(F.col("dst").alias("node"), yes.alias("up"), onward.alias("to"), F.when(~last, F.col("sibling").isNull()).otherwise(none).alias("to_up"), F.lit(0).cast("long").alias("n"), F.when(last, F.col("src")).alias("root"))
    t = cut(tour.select(F.inline(F.array(down, up))))
    while not t.where("root is null").isEmpty():
        step = t.select(F.col("node").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("next"), F.col("to_up").alias("next_up"), F.col("n").alias("more"), F.col("root").alias("end"))
        moved = t.where("root is null").join(step.hint("merge"), ["to", "to_up"])
        t = cut(t.where("root is not null").unionByName(moved.select("node", "up", F.col("next").alias("to"), F.col("next_up").alias("to_up"), (F.col("n") + F.col("more")).alias("n"), F.col("end").alias("root"))))
    ends = t.groupBy("node").agg(F.max("root").alias("root"), F.max("n").alias("left"), F.min("n").alias("after"))
    whole = cut(ends)
    trees = whole.groupBy("root").agg(F.count("*").alias("all"))
    inner = whole.join(trees, "root").select("node", "root", (F.col("all") - F.col("left") + 1).alias("at"), (F.col("left") - F.col("after")).alias("size"))
    return inner.unionByName(trees.select(F.col("root").alias("node"), "root", F.lit(0).cast("long").alias("at"), (F.col("all") + 1).alias("size")))


def dfs(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, order: pre-order from each start, first link first (by pos, then dst).

    In a forest, a start's nodes are those of its subtree, an interval of its tree's pre-order. Elsewhere pre-order is sequential by
    nature: the edges a start reaches are then walked in that start's group."""
    edges = cut(edges.select("src", "dst", "pos").where("src is not null and dst is not null"))
    once = edges.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    above = edges.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(1).alias("w"), F.lit(0).alias("c"))
    if once and not edges.isEmpty() and _contracted(above).where("held").isEmpty():
        placed = cut(preorder(edges))
        begun = starts.select(F.col("node").alias("start")).distinct()
        own = begun.join(placed, F.col("start") == F.col("node")).select("start", "root", F.col("at").alias("_from"), (F.col("at") + F.col("size")).alias("_to"))
        out = placed.join(own, "root").where((F.col("at") >= F.col("_from")) & (F.col("at") < F.col("_to"))).select("start", "node", (F.col("at") - F.col("_from")).alias("order"))
        alone = begun.join(placed, F.col("start") == F.col("node"), "left_anti")
        return out.unionByName(alone.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("order")))
    reach = bfs(edges, starts).select("start", "node")
    own = cut(reach.join(edges.select(F.col("src").alias("node"), "dst", "pos"), "node", "left").select("start", "node", "dst", "pos"))
    kind = own.schema["node"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        start, links = rows["start"].iloc[0], {}
        for r in rows.dropna(subset=["dst"]).sort_values("pos").itertuples():
            links.setdefault(r.node, []).append(r.dst)
        order, seen, stack = [], set(), [start]
        while stack:
            n = stack.pop()
            if n in seen:
                continue
            seen.add(n)
            order.append(n)
            stack.extend(reversed(links.get(n, [])))
        return pd.DataFrame({"start": start, "node": order, "order": range(len(order))})

    return own.groupBy("start").applyInPandas(walk, f"start {kind}, node {kind}, order long")
