"""Layers, cycles and pre-order against walks over random graphs, and their rounds on a long chain."""

import random

import pytest
from pyspark.sql import functions as F

from typeloom.operators import graph as G


def graph(spark, links):
    return spark.createDataFrame([(a, b, -b) for a, b in links], "src long, dst long, pos long")


def walked(nodes, links):
    """layer by node: Kahn's walk; nodes on or below cycles have none."""
    parents = {n: {a for a, b in links if b == n} for n in nodes}
    out = {}
    while ready := [n for n in nodes if n not in out and parents[n] <= set(out)]:
        out |= {n: max((out[p] + 1 for p in parents[n]), default=0) for n in ready}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_layers_and_cycles(spark, seed):
    rng = random.Random(seed)
    n = 40
    links = {(i, i + 1) for i in range(n - 1) if rng.random() < 0.7} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range([0, 3, 12, 40, 8, 8][seed])}
    if seed >= 4:  # links back, a loop and a ring of its own
        links |= {(b, a) for a, b in rng.sample(sorted(links), 2)} | {(n, n)} | {(n + 1 + i, n + 1 + (i + 1) % 5) for i in range(5)} | {(n + 2, n + 9), (n + 9, n + 8)}
    nodes = sorted({x for link in links for x in link} | {99})
    e = graph(spark, sorted(links)).select("src", "dst")
    e = e.unionByName(e.limit(3))  # repeated links add nothing
    got = {r["node"]: r["layer"] for r in G.layers(spark.createDataFrame([(x,) for x in nodes], "node long"), e).collect()}
    assert got == walked(nodes, links)
    left = set(links)
    while True:
        peeled = {(a, b) for a, b in left if any(y == a for _, y in left) and any(x == b for x, _ in left)}
        if peeled == left:
            break
        left = peeled
    assert {tuple(r) for r in G.in_cycles(e).collect()} == left


@pytest.mark.parametrize("seed", range(4))
def test_preorder(spark, seed):
    rng = random.Random(seed)
    links = [(rng.choice([i - 1, rng.randrange(max(0, i - 8), i)]), i) for i in range(1, 60) if i not in (20, 45)]  # three trees
    children = {}
    for a, b in sorted(links, key=lambda x: -x[1]):
        children.setdefault(a, []).append(b)

    def walk(n):
        return [n] + [x for child in children.get(n, []) for x in walk(child)]

    starts = [0, 3, 20, 30, 59, 500]
    got = {(r["start"], r["order"]): r["node"] for r in G.dfs(graph(spark, links), spark.createDataFrame([(s,) for s in starts], "node long")).collect()}
    assert got == {(s, i): x for s in starts for i, x in enumerate(walk(s))}
    sizes = {r["node"]: (r["at"], r["size"]) for r in G.preorder(graph(spark, links)).collect()}
    assert sizes == {x: (i, len(walk(x))) for root in (0, 20, 45) if root in children for i, x in enumerate(walk(root))}


def test_preorder_without_links(spark):
    none = graph(spark, [])
    assert [tuple(r) for r in G.dfs(none, spark.createDataFrame([(1,)], "node long")).collect()] == [(1, 1, 0)]
    assert G.layers(none.select(F.col("src").alias("node")), none).count() == 0 and G.in_cycles(none).count() == 0


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    calls, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: calls.append(1) or real(df))
    n = 3000
    k = spark.range(n).select(F.col("id").alias("node"))
    out = G.layers(k, spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")))
    assert out.where("node <> layer").isEmpty() and out.count() == n
    assert len(calls) < 30  # 12 doublings, and what comes before and after them
    calls.clear()
    links = spark.range(1, n).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("pos"))
    assert G.preorder(links).where("node <> at").isEmpty() and len(calls) < 25


def test_rounds_of_joins_keep_the_size_of_their_rows(spark):
    """Sizes estimated for plans multiply in each join; handed on, their digits double a round."""
    df = spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for _ in range(6):
        df = G.cut(df.join(df.toDF("b", "c"), "b").select("a", F.col("c").alias("b")))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**6 and df.where("a = b").count() == 10


def test_cut_keeps_repeated_names_and_columns_without_a_type(spark):
    df = spark.range(2).select("id", (F.col("id") + 1).alias("id"), (F.col("id") + 2).alias("a b.c"))
    assert G.cut(df).columns == df.columns and sorted(map(tuple, G.cut(df).collect())) == [(0, 1, 2), (1, 2, 3)]
    assert G.cut(spark.range(1).select(F.lit(None).alias("n"))).first()["n"] is None


def test_rounds_broadcast_nothing(spark, monkeypatch):
    """What each round broadcasts adds up in the driver."""
    plans, real = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    links = spark.range(1, 40).select(F.floor(F.col("id") / 2).alias("src"), F.col("id").alias("dst"), F.lit(0).cast("long").alias("pos"))
    assert G.ancestors(links, spark.createDataFrame([(39,)], "node long")).count() == 6
    assert G._contracted(links.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(1).alias("w"), F.lit(0).alias("c"))).where("not held and up = 0").count() == 39
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def test_a_cycle_is_found_without_its_nodes_in_the_driver(spark, monkeypatch):
    """2 and 3 lie between the cycles 7 > 9 and 4 > 5: only least nodes come to the driver, one by one, and nothing is broadcast."""
    plans, real, frame = [], G.cut, type(spark.range(1))
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(frame, "toLocalIterator", lambda *a, **b: pytest.fail("nodes in the driver"))
    links = [(7, 9), (9, 7), (9, 2), (2, 3), (3, 4), (4, 5), (5, 4), (6, 7)]
    assert G.find_cycle(graph(spark, links).select("src", "dst")).first()["path"] == [4, 5, 4]
    assert G.find_cycle(graph(spark, [(1, 2), (2, 3)]).select("src", "dst")).isEmpty()
    assert not any("BroadcastHashJoin" in p for p in plans)
