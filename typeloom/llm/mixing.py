"""Mixing sources to target weights: fixed-length blocks, multinomial counts per shard, permuted indices, a join by index.

DataFrame functions only. The words of each source, documents in hash-bucket and id order, form one stream, cut into
blocks of `block_words` words (the last one may be shorter). A source of S words with weight w gets the target
T = min(cap * S, level * w), the level being such that the targets sum to all words of all sources ("what exceeds a cap
is shared again by weight until none is above").

Counts: the output has as many slots as the targets have blocks, in shards of SHARD_SLOTS. A shard of L slots expects L * p of a source with the
share p; it gets the whole part of that, and its other slots are drawn from the multinomial distribution over what the whole parts leave.
Indices: running totals over the shards give each shard its range of a source's slot indices. Slot i of a source with b blocks stands in pass i div b,
at rank i mod b, and takes the block to which the permutation of that source and pass maps the rank (a swap-or-not shuffle:
a keyed bijection of any range). Slots past the last whole pass that the cap allows stay empty, so no block is taken more
than `cap` times. `slots()` gives that table; `mix()` joins it to the blocks by index.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources without words have
target 0; rows that repeat an id are documents of their own; other columns are ignored; an empty table gives an empty table. What a source gives
differs from its target by the multinomial part of its shards, a few blocks.

Scale: texts are read once, for their sizes, which are written as a narrow table, equal rows counted before they are spread again. Running totals use
two levels (buckets, then rows in a bucket), so no source, however large, is ordered in one task, and no id, however often it is repeated; the join
key is (source, block), even when one source holds most rows. The sources table (one row a source) is ordered in a single task and its shares go
through the driver: at most MAX_SOURCES rows, beyond which it is an error.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count, written

WEIGHTS, CAP, BLOCK_WORDS, SHARD_SLOTS, SEED = (5, 2, 1), 3, 64, 1024, 17
BUCKET_ROWS, MAX_SOURCES, ROUNDS = 4096, 100_000, 12
_CHUNK = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sid, source, source_size, weight, target for each source of sizes (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1
    per = per.withColumn("sid", rank).withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    # a source is capped when the level reaches its ratio cap * size / weight: test the sources in the order of that ratio
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("_used", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    fits = cap * F.col("source_size") * F.col("_rest") >= F.col("weight") * (F.col("_total") - F.col("_used"))
    # the first source that fits fixes the level for itself and all that follow
    per = per.withColumn("_level", F.first(F.when(fits, F.struct("_total", "_used", "_rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.col("weight") * (F.col("_level._total") - F.col("_level._used")) / F.col("_level._rest")
    return per.select("sid", "source", "source_size", "n_docs", "weight", F.coalesce(level, (cap * F.col("source_size")).cast("double")).alias("target"))


def _draw(n: Column, *key) -> Column:
    """A pseudorandom number from 0 to n - 1."""
    return F.pmod(F.xxhash64(*key), n)


def _spread(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, with a number from 0 in column name: in two steps, so that no array grows with n."""
    chunks = rows.select("*", n.alias("_n")).where("_n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_CHUNK}"))).alias("_k"))
    # a fixed number of tasks: a row stands for up to _CHUNK rows, which its size does not tell
    chunks = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns, "_k")
    return chunks.select(*rows.columns, F.explode(F.sequence(F.col("_k") * _CHUNK, F.least(F.col("_n"), (F.col("_k") + 1) * _CHUNK) - 1)).alias(name))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The swap-or-not shuffle of 0 to n - 1 that key names: in each round x and its partner, k - x mod n, change places or not."""

    def turn(at: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(F.lit(1), r, *key) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(2), r, *key, F.greatest(at, partner)), F.lit(2)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def _upto(bounds: list[float], u: Column) -> Column:
    """How many of the ascending bounds are at most u, by halving."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(at: Column, size: Column) -> Column:
        return F.when((at + size <= len(bounds)) & (F.try_element_at(F.lit(bounds), (at + size).cast("int")) <= u), at + size).otherwise(at)

    return F.aggregate(F.array(*[F.lit(x).cast("long") for x in steps]), F.lit(0).cast("long"), step)


def slots(sources: DataFrame, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix: shard, sid, slot (index within the source), block."""
    spark = sources.sparkSession
    own = sources.where("source_size > 0").select("sid", F.ceil(F.col("source_size") / block_words).cast("long").alias("b"), (F.col("target") * F.ceil(F.col("source_size") / block_words) / F.col("source_size")).alias("want"))
    shares = [tuple(r) for r in own.orderBy("sid").limit(MAX_SOURCES + 1).collect()]
    if len(shares) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(want for _, _, want in shares)
    all_slots = round(total)
    shards = -(-all_slots // SHARD_SLOTS)
    counts = None
    for first, n, size in ((0, shards - 1, SHARD_SLOTS), (shards - 1, 1, all_slots - (shards - 1) * SHARD_SLOTS)) if shards else ():
        expected = [size * want / total for _, _, want in shares]
        whole = [int(x) for x in expected]
        rest, free = list(accumulate(x - k for x, k in zip(expected, whole, strict=True))), size - sum(whole)
        if not n:
            continue
        each = spark.createDataFrame([(*r[:2], k) for r, k in zip(shares, whole, strict=True)], "sid long, b long, count long")
        made = [_spread(each.where("count > 0"), F.lit(n).cast("long"), "shard").select("sid", "count", (F.col("shard") + first).alias("shard"))]
        if free:
            drawn = _spread(spark.range(first, first + n).withColumnRenamed("id", "shard"), F.lit(free).cast("long"), "draw")
            u = F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), F.lit(1 << 52)) / (1 << 52) * rest[-1]
            at = F.least(_upto(rest, u), F.lit(len(rest) - 1).cast("long"))
            made.append(drawn.select(F.element_at(F.lit([r[0] for r in shares]), (at + 1).cast("int")).cast("long").alias("sid"), F.lit(1).cast("long").alias("count"), "shard"))
        for m in made:
            counts = m if counts is None else counts.unionByName(m)
    if counts is None:
        return spark.createDataFrame([], "shard long, sid long, slot long, block long")
    counts = counts.groupBy("sid", "shard").agg(F.sum("count").alias("count")).withColumn("part", F.expr(f"shard div {_CHUNK}"))
    begins = counts.groupBy("sid", "part").agg(F.sum("count").alias("_in")).select(
        "sid", "part", (F.sum("_in").over(Window.partitionBy("sid").orderBy("part")) - F.col("_in")).alias("_before")
    )
    inside = Window.partitionBy("sid", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.select("*", F.sum("count").over(inside).alias("_upto")).join(begins, ["sid", "part"]).join(own.select("sid", "b"), "sid")
    ranges = ranges.select("shard", "sid", "b", (F.col("_before") + F.col("_upto") - F.col("count")).alias("begin"), "count")
    # a fixed number of tasks: a row stands for up to SHARD_SLOTS slots
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid", "shard")
    indices = ranges.select("shard", "sid", "b", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("count") - 1)).alias("slot")).where(F.col("slot") < cap * F.col("b"))
    return indices.select("shard", "sid", "slot", permuted(F.expr("slot % b"), F.col("b"), F.lit(seed + 1), F.col("sid"), F.expr("slot div b")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs (doc_id, text, source)."""
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    per = written(targets(sizes, weights, cap), "sources")
    small = per.select("sid", F.col("source").alias("_source"), "source_size", "target", F.expr(f"n_docs div {BUCKET_ROWS} + 1").alias("n"))
    # equal rows are one row and a number until each gets its own copy number
    equal = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    once, more = equal.where("m = 1").select("doc_id", "source", "size", F.lit(0).cast("long").alias("copy")), equal.where("m > 1")
    more = _spread(more, F.col("m"), "copy").drop("m")
    bucket = _draw(F.col("n"), F.lit(seed), "doc_id", "size", F.expr(f"copy div {_CHUNK}")).alias("bucket")
    rows = once.unionByName(more).join(small, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "copy", "sid", "source_size", "target", bucket)
    begins = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("_in")).select(
        "sid", "bucket", (F.sum("_in").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("_in")).alias("_before")
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "copy")
    rows = rows.select("*", F.row_number().over(inside).alias("rn"), F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
    rows = rows.join(begins, ["sid", "bucket"]).withColumn("begin", F.col("_before") + F.col("_upto") - F.col("size"))
    touched = F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")))
    parts = rows.select("doc_id", "size", "sid", "source_size", "target", "bucket", "rn", "begin", F.explode_outer(touched).alias("block"))
    uses = slots(per, cap, block_words, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    # the slots come out of a table of a few rows: without the hint the planner would take them for few and broadcast them
    parts = parts.join(uses.hint("merge"), ["sid", "block"], "left")
    lo = F.greatest(F.col("begin"), F.col("block") * block_words)
    hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
    return (
        parts.select("doc_id", "size", "sid", "source_size", "target", "bucket", "rn", F.coalesce((hi - lo) * F.col("uses"), F.lit(0).cast("long")).alias("got"))
        .groupBy("sid", "bucket", "rn", "doc_id", "size", "source_size", "target")
        .agg(F.sum("got").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
