"""Closure, subtype tests and least upper bounds of types against walks up the hierarchy."""

import random

import pytest

from typeloom.sources import lattice as LT


@pytest.mark.parametrize("seed", range(3))
def test_hierarchies(spark, seed):
    rng = random.Random(seed)
    parent = {f"t{i}": None if i % 20 == 0 else f"t{rng.choice([i - 1, rng.randrange(max(0, i - 5), i)])}" for i in range(60)}

    def up(t):
        return [t] + (up(parent[t]) if parent.get(t) else [])

    known = LT.closure(spark.createDataFrame(list(parent.items()), "name string, parent string"))
    assert {(r["name"], r["ancestor"]): r["steps"] for r in known.collect()} == {(t, a): n for t in parent for n, a in enumerate(up(t))}
    pairs = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(60)] + [("alien", "alien"), ("alien", "t0"), (None, "t0")]
    got = LT.narrower(spark.createDataFrame(pairs, "a string, b string"), known).collect()
    assert sorted((str(r["a"]), r["b"], r["narrower"]) for r in got) == sorted((str(a), b, a == b or a in parent and b in up(a)) for a, b in pairs)
    asked = [(rng.randrange(12), rng.choice(list(parent))) for _ in range(30)] + [(50, "t3"), (51, "alien"), (51, "t3"), (None, "t5"), (None, "t5"), (52, None)]
    bounds = {r["k"]: (r["n_types"], r["type"]) for r in LT.least_upper(spark.createDataFrame(asked, "k int, type string"), known, ["k"]).collect()}
    want = {}
    for k in {k for k, t in asked if t}:
        types = {t for j, t in asked if j == k and t}
        first = next(iter(sorted(types)))
        shared = [a for a in up(first) if all(t in parent and a in up(t) for t in types)] if first in parent else []
        want[k] = (len(types), shared[0] if shared else None)
    assert bounds == want


def test_hierarchies_that_are_none(spark):
    for rows, problem in (([("a", "b"), ("b", "a")], "own ancestor"), ([("a", "b"), ("a", "c")], "two parents")):
        with pytest.raises(ValueError, match=problem):
            LT.closure(spark.createDataFrame(rows, "name string, parent string"))
    assert LT.closure(spark.createDataFrame([], "name string, parent string")).count() == 0
    built_in = LT.closure(LT.built_in(spark))
    assert [r["ancestor"] for r in built_in.where("name = 'identifier'").orderBy("steps").collect()] == ["identifier", "name", "ascii", "string"]
