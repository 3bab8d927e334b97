"""Types as a table of names and parents: the closure of ancestors, subtype tests and least upper bounds as joins.

closure() is made by pointer doubling, a logarithmic number of joins in the depth of the hierarchy; what asks about many types, or about columns that several
packages widen, then looks ancestors up instead of walking up one type at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators.graph import in_cycles
from typeloom.operators.stable import cut

from .typespec import PARENTS


def built_in(spark: SparkSession) -> DataFrame:
    """name, parent of the built-in types; parent is null at the top."""
    names = sorted(set(PARENTS) | set(PARENTS.values()))
    return spark.createDataFrame([(n, PARENTS.get(n)) for n in names], "name string, parent string")


def closure(types: DataFrame) -> DataFrame:
    """name, ancestor, steps for each type of types (name, parent) and each of its ancestors, itself (0 steps) included. A parent that is no type of its own is a top. Types that are their own ancestors are an error."""
    links = cut(types.select("name", "parent").where("name is not null").distinct())
    if not links.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a type has two parents")
    up = links.where("parent is not null")
    if not (ring := in_cycles(up.select(F.col("name").alias("src"), F.col("parent").alias("dst")))).isEmpty():
        raise ValueError(f"type {ring.agg(F.min('src')).first()[0]} is its own ancestor")
    names = links.select("name").union(up.select("parent")).distinct()
    out, jump, span = cut(names.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("steps"))), cut(up.select("name", F.col("parent").alias("to"))), 1
    while not jump.isEmpty():  # out knows ancestors less than span steps up, jump the one span steps up
        further = jump.join(out.withColumnRenamed("name", "to"), "to").select("name", "ancestor", (F.col("steps") + span).alias("steps"))
        out = cut(out.unionByName(further))
        jump = cut(jump.join(jump.select(F.col("name").alias("to"), F.col("to").alias("next")), "to").select("name", F.col("next").alias("to")))
        span *= 2
    return out


def narrower(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """pairs (a, b) with narrower: whether a is b or one of its subtypes. Unknown types are narrower than themselves alone."""
    known = ancestors.select(F.col("name").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("_known"))
    out = pairs.join(known, ["a", "b"], "left")
    return out.select(*pairs.columns, (F.coalesce("_known", F.lit(False)) | F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("narrower"))


def least_upper(widenings: DataFrame, ancestors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_types, type: for each column (keys) that several overlays give types (type), the narrowest type that all of them are; null where there is none or a type is not known."""
    asked = widenings.select(*keys, "type").where("type is not null").distinct()
    wanted = asked.groupBy(*keys).agg(F.count("*").alias("n_types"))
    depth = ancestors.groupBy(F.col("name").alias("ancestor")).agg(F.max("steps").alias("depth"))
    met = asked.join(ancestors.withColumnRenamed("name", "type"), "type").groupBy(*keys, "ancestor").agg(F.count("*").alias("n"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    shared = met.join(depth, "ancestor").alias("m").join(wanted.alias("w"), [*same, F.col("m.n") == F.col("w.n_types")]).select("m.*")
    best = shared.groupBy(*keys).agg(F.max_by("ancestor", "depth").alias("type")).alias("b")
    return wanted.alias("w").join(best, [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("w.*", "b.type")
