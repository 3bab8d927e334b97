"""Graphs in adjacency lists: a binary tree over the part keys (parent k / 2), and nations under regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.operators import graph as G

from .base import query, read

c = F.col


def _nodes(spark, sf):
    """name, parents, children: the tree over keys 1..n, each link on one side only."""
    k = read(spark, sf, "part").where("p_partkey > 0").select(c("p_partkey").alias("k"))
    up = F.when(c("k") > 1, F.array(F.floor(c("k") / 2).cast("string"))).otherwise(F.array().cast("array<string>"))
    return k.select(c("k").cast("string").alias("name"), up.alias("parents"), F.array().cast("array<string>").alias("children"))


def _edges(spark, sf):
    k = read(spark, sf, "part").where("p_partkey > 1")
    return k.select(F.floor(c("p_partkey") / 2).alias("src"), c("p_partkey").alias("dst"))


_TREE = "t AS (SELECT p_partkey AS k, p_partkey // 2 AS up FROM part WHERE p_partkey > 1)"


@query("graph_complete_directed", f"WITH {_TREE} SELECT p_partkey::VARCHAR AS name, coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k::VARCHAR) FROM t WHERE up = p_partkey), '') AS children FROM part WHERE p_partkey > 0")
def graph_complete_directed(spark, sf):
    return G.complete_directed(_nodes(spark, sf), "name", "children", "parents").select("name", F.array_join("children", ",").alias("children"))


@query("graph_complete_undirected", f"WITH {_TREE}, l AS (SELECT k AS a, up AS b, 0 AS o FROM t UNION ALL SELECT up, k, 1 FROM t) SELECT a::VARCHAR AS name, string_agg(b::VARCHAR, ',' ORDER BY o, b::VARCHAR) AS links FROM l GROUP BY a")
def graph_complete_undirected(spark, sf):
    out = G.complete_undirected(_nodes(spark, sf).select("name", c("parents").alias("links")), "name", "links")
    return out.where(F.size("links") > 0).select("name", F.array_join("links", ",").alias("links"))


@query("graph_refs_exist", "SELECT p_partkey::VARCHAR AS src, (p_partkey // 2)::VARCHAR AS dst FROM part WHERE p_partkey > 1 AND (p_partkey // 2) % 10 = 4 AND p_partkey % 10 <> 4")
def graph_refs_exist(spark, sf):
    n = _nodes(spark, sf).where("cast(name as bigint) % 10 <> 4")
    return G.dangling(n, "name", "parents")


@query("graph_roots_leaves", f"WITH {_TREE} SELECT p_partkey::VARCHAR AS name, p_partkey = 1 AS root, NOT EXISTS (SELECT 1 FROM t WHERE up = p_partkey) AS leaf FROM part WHERE p_partkey > 0")
def graph_roots_leaves(spark, sf):
    n = G.complete_directed(_nodes(spark, sf), "name", "children", "parents")
    return n.select("name", G.is_root(c("parents")).alias("root"), G.is_leaf(c("children")).alias("leaf"))


@query("graph_tree_shape", "SELECT 1::BIGINT AS n_roots, 1 AS max_parents, true AS ok")
def graph_tree_shape(spark, sf):
    return G.tree_shape(_nodes(spark, sf), "parents")


@query("graph_edge_keys", "SELECT n_nationkey, r_name || '__' || n_name AS directed, least(r_name, n_name) || '__' || greatest(r_name, n_name) AS undirected, r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
def graph_edge_keys(spark, sf):
    j = read(spark, sf, "nation").join(read(spark, sf, "region"), c("n_regionkey") == c("r_regionkey"))
    k = G.split_edge_key(G.edge_key(c("r_name"), c("n_name")))
    return j.select("n_nationkey", G.edge_key(c("r_name"), c("n_name")).alias("directed"), G.undirected_edge_key(c("r_name"), c("n_name")).alias("undirected"), k["a"].alias("a"), k["b"].alias("b"))


@query("graph_edge_problems", "SELECT p_partkey::VARCHAR || '__' || (p_partkey // 2 + p_partkey % 2)::VARCHAR AS edge, 'not linked' AS problem FROM part WHERE p_partkey > 1 AND p_partkey % 2 = 1")
def graph_edge_problems(spark, sf):
    e = read(spark, sf, "part").where("p_partkey > 1").select(G.edge_key(c("p_partkey").cast("string"), (F.floor(c("p_partkey") / 2) + c("p_partkey") % 2).cast("string")).alias("edge"))
    return G.edge_problems(_nodes(spark, sf), "name", "parents", e, "edge")


@query("graph_descendants", f"WITH RECURSIVE {_TREE}, r AS (SELECT k AS node, 1 AS depth FROM t WHERE up = 5 UNION ALL SELECT t.k, depth + 1 FROM r JOIN t ON t.up = r.node) SELECT node, depth FROM r")
def graph_descendants(spark, sf):
    start = spark.range(1).select(F.lit(5).cast("long").alias("node"))
    return G.descendants(_edges(spark, sf), start).select("node", "depth")


@query("graph_ancestors", "WITH RECURSIVE r AS (SELECT p_partkey AS start, p_partkey // 2 AS node FROM part WHERE p_partkey % 100 = 7 UNION ALL SELECT start, node // 2 FROM r WHERE node > 1) SELECT start, node FROM r WHERE node >= 1")
def graph_ancestors(spark, sf):
    starts = read(spark, sf, "part").where("p_partkey % 100 = 7").select(c("p_partkey").alias("node"))
    return G.ancestors(_edges(spark, sf), starts).select("start", "node")


@query("graph_shortest_path", f"WITH RECURSIVE {_TREE}, r AS (SELECT k, up, k::VARCHAR AS path FROM t WHERE k = 150 UNION ALL SELECT t.k, t.up, t.k || ',' || path FROM r JOIN t ON t.k = r.up) SELECT 1 AS start, 150 AS goal, up || ',' || path AS path FROM r WHERE up = 1")
def graph_shortest_path(spark, sf):
    return G.shortest_path(_edges(spark, sf), 1, 150).select("start", "goal", F.array_join(c("path").cast("array<string>"), ",").alias("path"))


@query("graph_cycle", f"WITH RECURSIVE {_TREE}, r AS (SELECT k, up, k::VARCHAR AS path FROM t WHERE k = 10 UNION ALL SELECT t.k, t.up, t.k || ',' || path FROM r JOIN t ON t.k = r.up) SELECT path || ',2' AS path FROM r WHERE k = 2")
def graph_cycle(spark, sf):
    e = _edges(spark, sf).unionByName(spark.range(1).select(F.lit(10).cast("long").alias("src"), F.lit(2).cast("long").alias("dst")))
    return G.find_cycle(e).select(F.array_join(c("path").cast("array<string>"), ",").alias("path"))


@query("graph_layers", "SELECT p_partkey AS node, floor(log2(p_partkey) + 1e-12)::INT AS layer FROM part WHERE p_partkey > 0")
def graph_layers(spark, sf):
    nodes = read(spark, sf, "part").where("p_partkey > 0").select(c("p_partkey").alias("node"))
    return G.layers(nodes, _edges(spark, sf))


@query("graph_dfs", f"WITH RECURSIVE {_TREE}, r AS (SELECT 3::BIGINT AS node, '' AS path UNION ALL SELECT t.k, path || (t.k % 2)::VARCHAR FROM r JOIN t ON t.up = r.node) SELECT 3 AS start, node, row_number() OVER (ORDER BY path) - 1 AS \"order\" FROM r")
def graph_dfs(spark, sf):
    e = _edges(spark, sf).select("src", "dst", (c("dst") % 2).cast("int").alias("pos"))
    return G.dfs(e, spark.range(1).select(F.lit(3).cast("long").alias("node")))


_CHAIN = "SELECT event_id AS k FROM events"


def _chain(spark, sf):
    """Events as a tree two thirds as deep as they are many: 3k has the children 3k + 1, a leaf, and 3k + 2, which goes on to 3k + 3."""
    k = read(spark, sf, "events").where("event_id > 0").select(c("event_id").alias("dst"))
    return k.select((c("dst") - F.when(c("dst") % 3 == 2, 2).otherwise(1)).alias("src"), "dst", (-c("dst")).alias("pos"))


@query("graph_deep_layers", f"SELECT k AS node, ((k // 3) * 2 + CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END)::INTEGER AS layer FROM ({_CHAIN})")
def graph_deep_layers(spark, sf):
    """Layers of a graph as deep as the table is long; each tenth node also hangs from the root."""
    more = read(spark, sf, "events").where("event_id % 10 = 0 and event_id > 0").select(F.lit(0).cast("long").alias("src"), c("event_id").alias("dst"))
    return G.layers(read(spark, sf, "events").select(c("event_id").alias("node")), _chain(spark, sf).select("src", "dst").unionByName(more))


@query("graph_deep_dfs", f"""SELECT s AS start, k AS node, row_number() OVER (PARTITION BY s ORDER BY k % 3 = 1, CASE WHEN k % 3 = 1 THEN -k ELSE k END) - 1 AS "order" FROM ({_CHAIN}), (VALUES (0), (300), (600)) t(s) WHERE k >= s""")
def graph_deep_dfs(spark, sf):
    """Pre-order from the root and from two nodes below it: down the long way first, then the leaves from below."""
    starts = read(spark, sf, "events").where("event_id in (0, 300, 600)").select(c("event_id").alias("node"))
    return G.dfs(_chain(spark, sf), starts)


@query("graph_cut_off_cycles", f"SELECT k AS src, CASE WHEN k % 100 = 59 THEN k - 9 ELSE k + 1 END AS dst FROM ({_CHAIN}) WHERE k % 100 BETWEEN 50 AND 59")
def graph_cut_off_cycles(spark, sf):
    """Of chains of a hundred events, each with one link back over ten of them, the rings are left."""
    k = read(spark, sf, "events").select(c("event_id").alias("src"))
    on = k.where("src % 100 < 99").select("src", (c("src") + 1).alias("dst"))
    back = k.where("src % 100 = 59").select("src", (c("src") - 9).alias("dst"))
    return G.in_cycles(on.unionByName(back))
