"""Joins, aggregates, filters, order, long and wide tables, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.operators import diff as D
from typeloom.operators import relational as R

from .base import query, read


@query(
    "left_join_files",
    """SELECT coalesce(c.c_nationkey, -1) AS c_nationkey, count(*)::BIGINT AS n_orders, count(c.c_custkey)::BIGINT AS n_matched,
      count(DISTINCT c.c_mktsegment)::BIGINT AS n_segments, sum(round(o.o_totalprice * 100)::BIGINT)::BIGINT AS cents, round(avg(round(c.c_acctbal * 100)::BIGINT), 1) AS average_cents
    FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON o.o_custkey = c.c_custkey GROUP BY 1""",
)
def left_join_files(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    customer = read(spark, sf, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").withColumn("_found", F.lit(1))
    joined = R.join_files(orders, [customer], "c_custkey", order="c_nationkey").withColumn("c_nationkey", F.coalesce("c_nationkey", F.lit(-1)))
    return joined.groupBy("c_nationkey").agg(
        F.count("*").alias("n_orders"), F.count("_found").alias("n_matched"), F.count_distinct("c_mktsegment").alias("n_segments"), R.sum_of(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.round(F.avg(F.round(F.col("c_acctbal") * 100).cast("long")), 1).alias("average_cents")
    )


@query(
    "join_last_wins",
    """SELECT c.c_custkey, l.o_orderkey, l.o_orderstatus FROM customer c LEFT JOIN
      (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) l ON l.o_custkey = c.c_custkey""",
)
def join_last_wins(spark, sf):
    last = R.last_rows(read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return R.join_files(read(spark, sf, "customer").select("c_custkey"), [last.withColumnRenamed("o_custkey", "c_custkey")], "c_custkey", order="o_orderkey").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("join_unmatched_secondary", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_unmatched_secondary(spark, sf):
    return R.unmatched(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), read(spark, sf, "customer"), "c_custkey").select("c_custkey", "c_name")


@query(
    "join_multi_secondary",
    """SELECT p.p_brand, s.s_nationkey, count(*)::BIGINT AS n, sum(l.l_quantity)::BIGINT AS quantity
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY ALL""",
)
def join_multi_secondary(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    out = R.join_files(R.join_files(lines, [part], "l_partkey", order="p_brand"), [supplier], "l_suppkey", order="s_nationkey")
    return out.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("pk_lookup", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey = 17")
def pk_lookup(spark, sf):
    return R.lookup(read(spark, sf, "part"), "p_partkey", 17, "p_partkey").select("p_partkey", "p_name", "p_size")


@query("lookup_by_text_key", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 = 0")
def lookup_by_text_key(spark, sf):
    return R.lookup_by_key(read(spark, sf, "orders").where("o_orderkey % 7 = 0"), "o_custkey", read(spark, sf, "customer"), "c_custkey", ["c_name"]).select("o_orderkey", "c_name")


@query("semi_all_any", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_totalprice > 100000) AS any_big, NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o_orderstatus <> 'F') AS all_final FROM customer")
def semi_all_any(spark, sf):
    per = read(spark, sf, "orders").groupBy("o_custkey").agg(R.any_of(F.col("o_totalprice") > 100000).alias("any_big"), R.all_of(F.col("o_orderstatus") == "F").alias("all_final"))
    out = read(spark, sf, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("any_big", F.lit(False)).alias("any_big"), F.coalesce("all_final", F.lit(True)).alias("all_final"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, sf):
    urgent = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.exists_in(read(spark, sf, "customer").select("c_custkey"), urgent, "c_custkey")


@query("resume_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return R.exists_in(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels").select("doc_id"), "doc_id", negate=True)


@query("agg_sum_min_max_avg", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS s, min(l_linenumber) AS lo, max(l_linenumber) AS hi, round(avg(l_discount), 8) AS a FROM lineitem GROUP BY ALL")
def agg_sum_min_max_avg(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(R.sum_of("l_quantity").cast("long").alias("s"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.round(F.avg("l_discount"), 8).alias("a"))


@query("agg_empty_defaults", "SELECT 0::BIGINT AS s, 0::BIGINT AS n, true AS every, false AS some, true AS none_of, NULL::DOUBLE AS least FROM region LIMIT 1")
def agg_empty_defaults(spark, sf):
    none = read(spark, sf, "orders").where("o_orderkey < 0")
    big = F.col("o_totalprice") > 1
    return none.agg(R.sum_of("o_custkey").alias("s"), R.count_of(big).alias("n"), R.all_of(big).alias("every"), R.any_of(big).alias("some"), R.none_of(big).alias("none_of"), F.min("o_totalprice").alias("least"))


@query("agg_count_if", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 50000)::BIGINT AS n FROM orders GROUP BY ALL")
def agg_count_if(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(R.count_of(F.col("o_totalprice") > 50000).alias("n"))


@query("agg_unique", "SELECT count(o_orderkey) = count(DISTINCT o_orderkey) AS by_key, count(o_custkey) = count(DISTINCT o_custkey) AS by_customer FROM orders")
def agg_unique(spark, sf):
    return read(spark, sf, "orders").agg(R.unique("o_orderkey").alias("by_key"), R.unique("o_custkey").alias("by_customer"))


@query("agg_all_any_none", "SELECT l_shipdate::DATE::VARCHAR AS day, bool_and(l_quantity > 5) AS every, bool_or(l_discount > 0.09) AS some, NOT bool_or(l_tax > 0.07) AS none_taxed FROM lineitem GROUP BY ALL")
def agg_all_any_none(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(R.all_of(F.col("l_quantity") > 5).alias("every"), R.any_of(F.col("l_discount") > 0.09).alias("some"), R.none_of(F.col("l_tax") > 0.07).alias("none_taxed"))


@query("group_by_rows", "SELECT o_custkey, count(*)::BIGINT AS n, string_agg(o_orderkey::VARCHAR || ':' || o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS listed FROM orders GROUP BY o_custkey")
def group_by_rows(spark, sf):
    g = R.group_rows(read(spark, sf, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    listed = F.array_join(F.transform("rows", lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"])), ",")
    return g.select("o_custkey", F.size("rows").cast("long").alias("n"), listed.alias("listed"))


@query("filter_truthy", "SELECT event_id, user_id FROM events WHERE value > 50")
def filter_truthy(spark, sf):
    return R.where_truthy(read(spark, sf, "events"), F.col("value") > 50).select("event_id", "user_id")


@query("find_first", "SELECT p_partkey, p_size FROM part WHERE p_size > 45 ORDER BY p_partkey LIMIT 1")
def find_first(spark, sf):
    return R.find_first(read(spark, sf, "part"), F.col("p_size") > 45, "p_partkey").select("p_partkey", "p_size")


@query("first_seen_distinct", "SELECT event_type, min(event_id) AS first_line FROM events GROUP BY event_type")
def first_seen_distinct(spark, sf):
    return R.first_seen(read(spark, sf, "events"), "event_type", "event_id")


@query("pk_duplicates", "SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def pk_duplicates(spark, sf):
    return R.duplicate_keys(read(spark, sf, "lineitem"), "l_orderkey")


@query("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_index FROM orders")
def row_index(spark, sf):
    return R.numbered(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query("running_state", "SELECT event_id, count(event_id) OVER w AS n_so_far, min(event_id) OVER w AS first_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_state(spark, sf):
    e = R.running(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_id", "count", "n_so_far")
    return R.running(e, ["user_id"], ["ts", "event_id"], "event_id", "min", "first_event").select("event_id", "n_so_far", "first_event")


@query("order_case_insensitive", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS place FROM part")
def order_case_insensitive(spark, sf):
    df = read(spark, sf, "part").withColumn("k", R.ci_key(F.col("p_name")))
    return R.numbered(df, ["k", "p_partkey"], "place", "p_brand").select("p_partkey", "place")


@query("top_n_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_n_per_group(spark, sf):
    df = read(spark, sf, "orders").withColumn("neg", -F.col("o_totalprice"))
    return R.numbered(df, ["neg", "o_orderkey"], "place", "o_custkey").where("place <= 2").select("o_custkey", "o_orderkey")


@query("eav_unpivot", "SELECT p_partkey::VARCHAR AS entity, attribute, value FROM (UNPIVOT (SELECT p_partkey, p_name, p_brand, p_type, p_size::VARCHAR AS p_size FROM part) ON p_name, p_brand, p_type, p_size INTO NAME attribute VALUE value) WHERE value <> ''")
def eav_unpivot(spark, sf):
    return R.unpivot(read(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


@query("eav_pivot", "SELECT p_partkey::VARCHAR AS entity, p_name AS p_name, CASE WHEN p_size > 10 THEN p_size::VARCHAR ELSE '' END AS p_size FROM part")
def eav_pivot(spark, sf):
    t = R.unpivot(read(spark, sf, "part"), "p_partkey", ["p_name", "p_size"])
    return R.pivot(t.where("attribute <> 'p_size' or cast(value as int) > 10").withColumn("_line", F.lit(1)), "_line", ["p_name", "p_size"])


@query("eav_conflict_first_last", "SELECT user_id::VARCHAR AS entity, coalesce(max(f) FILTER (WHERE event_type = 'click'), '') AS first_click, coalesce(max(l) FILTER (WHERE event_type = 'click'), '') AS last_click FROM (SELECT user_id, event_type, arg_min(event_id, event_id)::VARCHAR AS f, arg_max(event_id, event_id)::VARCHAR AS l FROM events GROUP BY ALL) GROUP BY 1")
def eav_conflict_first_last(spark, sf):
    t = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("attribute"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("_line"))
    a = R.pivot(t, "_line", ["click"], "first").withColumnRenamed("click", "first_click")
    return a.join(R.pivot(t, "_line", ["click"], "last").withColumnRenamed("click", "last_click"), "entity")


@query("eav_conflicts", "SELECT user_id::VARCHAR AS entity, event_type AS attribute, count(*)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def eav_conflicts(spark, sf):
    return R.conflicts(read(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("attribute")))


@query("transpose_small", "SELECT 'r_name' AS key, " + ", ".join(f"max(CASE WHEN r_regionkey = {k} THEN r_name END) AS \"{k}\"" for k in range(5)) + " FROM region")
def transpose_small(spark, sf):
    return R.transpose(read(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey")


@query("implode_record", "SELECT c_custkey, to_json({'balance': round(c_acctbal, 2), 'nation': c_nationkey})::VARCHAR AS info FROM customer WHERE c_acctbal = floor(c_acctbal) + 0.5 OR c_custkey % 3 = 0 AND c_acctbal > 1")
def implode_record(spark, sf):
    df = read(spark, sf, "customer").where("c_acctbal = floor(c_acctbal) + 0.5 OR c_custkey % 3 = 0 AND c_acctbal > 1").select("c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("b"))
    return R.implode(df, "info", {"nation": "c_nationkey", "balance": "b"}).select("c_custkey", F.to_json("info").alias("info"))


@query("implode_array", "SELECT l_orderkey, l_linenumber, array_to_string([l_partkey, l_suppkey, l_linenumber], '/') AS ids FROM lineitem")
def implode_array(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", "l_linenumber")
    return R.implode(df, "ids", {"a": "l_partkey", "b": "l_suppkey", "c": "l_linenumber"}, "array").select("l_orderkey", F.col("n").alias("l_linenumber"), F.array_join(F.col("ids").cast("array<string>"), "/").alias("ids"))


@query("implode_map", "SELECT p_partkey, p_brand || '=' || CASE WHEN p_brand = p_type THEN p_size::VARCHAR ELSE 'x;' || p_type || '=' || p_size::VARCHAR END AS m FROM part")
def implode_map(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("k1"), F.lit("x").alias("v1"), F.col("p_type").alias("k2"), F.col("p_size").cast("string").alias("v2"))
    out = R.implode_map(df, "m", [("k1", "v1"), ("k2", "v2")])
    return out.select("p_partkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("m"))


@query("explode_struct", "SELECT n_nationkey AS \"s.n_nationkey\", n_name AS \"s.n_name\" FROM nation")
def explode_struct(spark, sf):
    return R.explode_struct(read(spark, sf, "nation").select(F.struct("n_nationkey", "n_name").alias("s")), "s")


@query("union_rows", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def union_rows(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return R.union_all([s, R.exists_in(c, s.select("k"), "k", negate=True)])


def _new_parts(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    new = part.where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat("p_name", F.lit(" X"))).otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.upper("p_brand").alias("p_brand"))
    return part, new.unionByName(part.where("p_partkey <= 5").withColumn("p_partkey", -F.col("p_partkey")))


_NEW = """n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' X' ELSE p_name END AS p_name, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0
  UNION ALL SELECT -p_partkey, p_name, p_size FROM part WHERE p_partkey <= 5)"""


@query(
    "diff_keyed",
    f"""WITH {_NEW} SELECT coalesce(o.p_partkey, n.p_partkey)::VARCHAR AS key, CASE WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_partkey IS NULL THEN 'added' ELSE 'changed' END AS kind,
      CASE WHEN n.p_partkey IS NULL OR o.p_partkey IS NULL THEN 0 ELSE (o.p_name <> n.p_name)::INT + (o.p_size <> n.p_size)::INT END::BIGINT AS n_changes
    FROM part o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_name <> n.p_name OR o.p_size <> n.p_size""",
)
def diff_keyed(spark, sf):
    d = D.keyed(*_new_parts(spark, sf), o=D.Options(ignore_case=True))
    return d.select("key", "kind", F.coalesce(F.size("changes"), F.lit(0)).cast("long").alias("n_changes"))


@query("diff_cells", f"""WITH {_NEW} SELECT o.p_partkey::VARCHAR AS key, 'p_size' AS "column", o.p_size::VARCHAR AS "old", n.p_size::VARCHAR AS "new" FROM part o JOIN n USING (p_partkey) WHERE o.p_size <> n.p_size""")
def diff_cells(spark, sf):
    return D.cells(D.keyed(*_new_parts(spark, sf), o=D.Options(only=("p_partkey", "p_size"))))


@query("diff_epsilon", "SELECT s_suppkey::VARCHAR AS key FROM supplier WHERE s_suppkey % 3 = 0")
def diff_epsilon(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return D.keyed(s, s.withColumn("s_acctbal", F.col("s_acctbal") + F.when(F.col("s_suppkey") % 3 == 0, 0.5).otherwise(0.001)), o=D.Options(epsilon=0.01)).select("key")


@query("diff_column_map", "SELECT n_nationkey::VARCHAR AS key FROM nation WHERE n_nationkey % 4 = 0")
def diff_column_map(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    other = n.select("n_nationkey", (F.col("n_regionkey") + (F.col("n_nationkey") % 4 == 0).cast("int")).alias("region"))
    return D.keyed(n, other, o=D.Options(mapping={"n_regionkey": "region"})).select("key")


@query(
    "diff_positional",
    """WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderstatus AS s FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderstatus AS s FROM orders WHERE o_orderkey > 3)
    SELECT coalesce(a.i, b.i) AS row_index, CASE WHEN b.i IS NULL THEN 'removed' WHEN a.i IS NULL THEN 'added' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.i = b.i WHERE a.i IS NULL OR b.i IS NULL OR a.s <> b.s""",
)
def diff_positional(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return D.positional(o, o.where("o_orderkey > 3"), "o_orderkey").select("row_index", "kind")


@query(
    "diff_context",
    """WITH d AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_nationkey % 10 = 5 AS c FROM nation)
    SELECT i AS row_index, CASE WHEN c THEN 'changed' ELSE 'same' END AS kind FROM d WHERE EXISTS (SELECT 1 FROM d e WHERE e.c AND abs(e.i - d.i) <= 2)""",
)
def diff_context(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    other = n.withColumn("n_name", F.when(F.col("n_nationkey") % 10 == 5, "other").otherwise(F.col("n_name")))
    return D.positional(n, other, "n_nationkey", D.Options(context=2)).select("row_index", "kind")


@query("diff_summary", f"""WITH {_NEW} SELECT CASE WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_partkey IS NULL THEN 'added' ELSE 'changed' END AS kind, count(*)::BIGINT AS n FROM part o FULL JOIN n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_name <> n.p_name OR o.p_size <> n.p_size GROUP BY 1""")
def diff_summary(spark, sf):
    return D.summary(D.keyed(*_new_parts(spark, sf), o=D.Options(exclude=("p_brand",))))


@query("diff_max", f"""WITH {_NEW} SELECT key FROM (SELECT p_partkey::VARCHAR AS key FROM part WHERE p_partkey % 11 = 0 AND p_partkey > 0 UNION ALL SELECT p_partkey::VARCHAR FROM part o JOIN n USING (p_partkey) WHERE o.p_name <> n.p_name OR o.p_size <> n.p_size) ORDER BY key LIMIT 10""")
def diff_max(spark, sf):
    return D.keyed(*_new_parts(spark, sf), o=D.Options(max_diffs=10, exclude=("p_brand",))).select("key")


@query("diff_tables", "SELECT 'a' AS name, 'compared' AS state, (SELECT count(*) FROM region WHERE r_regionkey = 2)::BIGINT AS changed, 0::BIGINT AS removed, 0::BIGINT AS added UNION ALL SELECT 'b', 'only_left', 0, 0, 0")
def diff_tables(spark, sf):
    r = read(spark, sf, "region")
    return D.tables({"a": r, "b": r}, {"a": r.withColumn("r_name", F.when(F.col("r_regionkey") == 2, "x").otherwise(F.col("r_name")))})
