"""Connected components of an edge table by smallest labels and pointer jumping.

Result: node, comp (the smallest node reachable) for each node that has an edge. Each round is a few equi-joins, written to the shared
folder, so that lineage stays short and lost executors cost one round; rounds grow with the logarithm of the
diameter. No component or edge list is ever gathered in the driver or one task. Self-loops, repeated and null edges do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, comp."""
    pairs = edges.where("a is not null and b is not null")
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        # the smallest label among the neighbours, then that label's own label
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        best = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        step = written(best.join(jump, "new", "left").select("node", F.coalesce(F.least("new", "jump"), "new").alias("comp"), "old"), "labels")
        changed = step.where("comp <> old").limit(1).count()
        discard(labels)
        labels = step.select("node", "comp")
        if not changed:
            discard(both)
            return labels
