"""URL filters: association rules mined from labelled URLs with FP-growth, matched through an inverted index.

Explicit rules (verdict, host, path prefix) judge first: a rule fits its host and all subdomains when the URL's path
starts with the rule's path; the longest fitting rule wins. The URLs so judged are the labels from which FP-growth
mines combinations of the tokens that no explicit rule names (else it would find these rules again); rules "tokens -> verdict" below the support, confidence or lift bound are pruned, as are rules that a
more general one of no less confidence implies. The URLs of a third of the hosts, by hash, are kept back from mining: a rule counts only if it holds among them as well, with the same confidence bound, on at least
MIN_HELD of their rows and MIN_HOSTS of their hosts, so what merely names a labelled site goes. A URL without an explicit rule gets the verdict of its best mined
rule: highest confidence, then support, then fewest tokens, then "allow"; without any it is allowed.

Tokens: the host's last label (`h=net`), the hyphen-separated parts of its other labels (`w=casino`), each path segment
that is not a number (`p=en`), and the file extension (`x=html`).

Defined results: a null URL, or one without `://`, has empty host and path, no rule, no tokens, and is allowed; an
empty host or a path that does not start with "/" fits no rule; repeated rows give repeated rows; other columns are
ignored; an empty table gives an empty table (nothing is mined).

Scale: only the url column is read. Transactions are counted by token set before mining is weighed in; the index holds each
mined rule once, under its rarest token, so one very common host meets only the rules that have nothing rarer. The match
is an equi-join on the token, done once for each distinct token set and not once a page.
"""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, table, written

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.8, 1.05
SALTS = 16
#: One host in KEPT_BACK confirms what the others teach: least rows and hosts there on which a rule has to hold.
KEPT_BACK, MIN_HELD, MIN_HOSTS = 3, 5, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens(host: Column, path: Column) -> Column:
    last = F.array(F.concat(F.lit("h="), F.substring_index(host, ".", -1)))
    front = F.regexp_extract(host, "^(.*)\\.[^.]*$", 1)
    parts = F.transform(F.filter(F.split(front, "[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("w="), x))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+(\\.[A-Za-z0-9]+)?$"))
    extension = F.regexp_extract(path, "\\.([A-Za-z0-9]{1,8})$", 1)
    listed = F.concat(last, parts, F.transform(segments, lambda x: F.concat(F.lit("p="), x)), F.when(extension != "", F.array(F.concat(F.lit("x="), extension))).otherwise(F.array().cast("array<string>")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(listed)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support) from labelled rows (items array<string>, verdict). Each row counts, repeated ones too; no two rules have the same items and verdict."""
    spark = labelled.sparkSession
    # items too rare to be in any frequent set leave before mining; so do those that every URL has
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], "rule_id long, items array<string>, verdict string, confidence double, support double")
    counts = labelled.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= max(1, min_support * n))
    each = labelled.select(F.monotonically_increasing_id().alias("row"), "items", "verdict")
    frequent = each.select("row", "verdict", F.explode_outer("items").alias("item")).join(counts.select("item", F.lit(True).alias("often")), "item", "left")
    sets = frequent.groupBy("row", "verdict").agg(F.collect_set(F.when(F.col("often"), F.col("item"))).alias("items")).select(F.array_append("items", F.concat(F.lit("verdict="), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict=") & ~F.exists("antecedent", lambda x: x.startswith("verdict=")) & (F.col("lift") >= min_lift))
    found = written(found.select(F.array_sort("antecedent").alias("items"), F.substring(F.element_at("consequent", 1), 9, 20).alias("verdict"), "confidence", "support"), "rules")
    # a rule goes if dropping tokens gives a rule with the same verdict and no less confidence: look such rules up by their rarest item
    parts = found.select("items", "verdict", "confidence", F.explode("items").alias("item"))
    weight = parts.groupBy(F.col("item").alias("g_item")).agg(F.count("*").alias("n"))
    general = found.select(F.col("items").alias("g_items"), F.col("verdict").alias("g_verdict"), F.col("confidence").alias("g_confidence"), F.explode("items").alias("g_item")).join(weight, "g_item")
    general = general.groupBy("g_items", "g_verdict", "g_confidence").agg(F.min(F.struct("n", "g_item")).alias("p")).select("g_items", "g_verdict", "g_confidence", "p.g_item")
    implied = parts.join(
        general,
        (F.col("item") == F.col("g_item")) & (F.col("verdict") == F.col("g_verdict")) & (F.size("g_items") < F.size("items")) & (F.col("g_confidence") >= F.col("confidence")) & (F.size(F.array_except("g_items", "items")) == 0),
        "left_semi",
    ).select("items", "verdict").distinct()
    kept = found.join(implied, ["items", "verdict"], "left_anti")
    return kept.select(F.xxhash64("items", "verdict").alias("rule_id"), "items", "verdict", "confidence", "support")


def _indexed(rules: DataFrame) -> DataFrame:
    """Each rule under the one of its tokens that fewest rules have: item, rule_id, rule_items, verdict, confidence, support, ..."""
    listed = rules.select("rule_id", F.explode("items").alias("item"))
    weight = listed.groupBy("item").agg(F.count("*").alias("n"))
    posting = listed.join(weight, "item").groupBy("rule_id").agg(F.min(F.struct("n", "item")).alias("p")).select("rule_id", F.col("p.item").alias("item"))
    return rules.withColumnRenamed("items", "rule_items").join(posting, "rule_id")


def confirmed(rules: DataFrame, held: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_HELD, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """The rules that hold on rows (host, items, verdict) they were not mined from, with their share of right verdicts there (precision) and the rows it stands on (held_rows)."""
    sets = held.groupBy("host", "items", "verdict").agg(F.count("*").alias("rows")).select("host", "items", F.col("verdict").alias("true"), "rows", F.explode("items").alias("item"))
    hits = sets.join(_indexed(rules).select("item", "rule_id", "rule_items", "verdict"), "item").where(F.size(F.array_except("rule_items", "items")) == 0)
    seen = hits.groupBy("rule_id").agg(F.sum("rows").alias("held_rows"), F.sum(F.when(F.col("true") == F.col("verdict"), F.col("rows")).otherwise(0)).alias("right"), F.count_distinct("host").alias("hosts"))
    seen = seen.withColumn("precision", F.col("right") / F.col("held_rows")).where((F.col("held_rows") >= min_rows) & (F.col("hosts") >= min_hosts) & (F.col("precision") >= min_confidence))
    return rules.join(seen.select("rule_id", "precision", "held_rows"), "rule_id")


def match(items: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row of items (key, items) the best rule that its items hold: key, verdict, confidence, matched; keys without one are left out."""
    hits = items.select("key", "items", F.explode("items").alias("item")).join(_indexed(rules), "item").where(F.size(F.array_except("rule_items", "items")) == 0)
    best = F.max(F.struct("confidence", "support", (-F.size("rule_items")).alias("short"), (F.col("verdict") == "allow").alias("a"), "rule_items", "verdict"))
    return hits.groupBy("key").agg(best.alias("b")).select("key", F.col("b.verdict").alias("verdict"), F.col("b.confidence").alias("confidence"), F.col("b.rule_items").alias("matched"))


def rule_tokens(rules=RULES) -> list[str]:
    """Tokens that the explicit rules name."""
    out = set()
    for _, host, path in rules:
        front, _, last = host.rpartition(".")
        out |= {f"h={last}"} | {f"w={x}" for x in re.split("[.-]", front) if x} | {f"p={x}" for x in path.split("/") if x}
    return sorted(out)


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, matched (tokens of the mined rule, where one judged)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", explicit(F.col("host"), F.col("path"), rules).alias("x"), tokens(F.col("host"), F.col("path")).alias("items"))
    free = F.array_except("items", F.array(*[F.lit(x) for x in rule_tokens(rules)]).cast("array<string>"))
    labelled = rows.where("x is not null").select("host", free.alias("items"), F.col("x.verdict").alias("verdict"))
    back = F.pmod(F.xxhash64("host"), F.lit(KEPT_BACK)) == 0
    mined = written(confirmed(mine(labelled.where(~back), min_support, min_confidence), labelled.where(back), min_confidence), "mined")
    known = mined.select(F.explode("items").alias("item")).distinct()
    open_rows = rows.where("x is null").select("items").distinct()
    sets = open_rows.select(F.col("items").alias("key"), F.explode("items").alias("item")).join(known, "item").groupBy("key").agg(F.collect_set("item").alias("items"))
    verdicts = match(sets, mined).select(F.col("key").alias("_key"), F.col("verdict").alias("v"), "confidence", "matched")
    # a token set that very many pages have is dealt to SALTS tasks
    verdicts = verdicts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    judged = salted.join(verdicts, (F.when(F.col("x").isNull(), F.col("items")) == F.col("_key")) & (F.col("salt") == F.col("_salt")), "left")
    return judged.select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", "v", F.lit("allow")).alias("verdict"), "confidence", "matched")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
