"""Patches, bulk rules, lineage and single-table mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.operators import mutate as M
from typeloom.operators import patch as P
from typeloom.operators import plan as L

from .base import query, read

c = F.col


def _part(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_name", "p_size")


def _patch(spark, sf):
    p = _part(spark, sf)
    op = F.when(c("p_partkey") % 9 == 0, "remove").when(c("p_partkey") % 9 == 1, "update").otherwise("replace")
    rows = p.where("p_partkey % 9 < 3 and p_partkey > 0").select("p_partkey", op.alias("patchOp"), F.when(c("p_partkey") % 2 == 0, F.lit("new")).alias("p_name"), F.lit("5").alias("p_size"))
    add = p.where("p_partkey between 1 and 4").select((-c("p_partkey")).alias("p_partkey"), F.lit("add").alias("patchOp"), F.lit("added").alias("p_name"), F.lit(None).cast("string").alias("p_size"))
    return rows.unionByName(add)


@query(
    "patch_add_remove_update_replace",
    """SELECT p_partkey, CASE WHEN p_partkey = 0 OR p_partkey % 9 > 2 THEN p_name WHEN p_partkey % 2 = 0 THEN 'new' WHEN p_partkey % 9 = 1 THEN p_name END AS p_name, CASE WHEN p_partkey > 0 AND p_partkey % 9 < 3 THEN '5' ELSE p_size::VARCHAR END AS p_size FROM part WHERE p_partkey % 9 <> 0 OR p_partkey = 0
    UNION ALL SELECT -p_partkey, 'added', 'none' FROM part WHERE p_partkey BETWEEN 1 AND 4""",
)
def patch_rows(spark, sf):
    return P.row_patch(_part(spark, sf), _patch(spark, sf)).withColumn("p_size", F.coalesce(c("p_size").cast("string"), F.lit("none")))


@query("patch_problems", "SELECT -p_partkey AS key, 'update' AS op, 'error' AS level FROM part WHERE p_partkey BETWEEN 1 AND 3 UNION ALL SELECT p_partkey, 'add', 'error' FROM part WHERE p_partkey = 7 UNION ALL SELECT -99, 'remove', 'warn'")
def patch_problems(spark, sf):
    p = _part(spark, sf)
    bad = p.where("p_partkey between 1 and 3").select((-c("p_partkey")).alias("p_partkey"), F.lit("update").alias("patchOp")).unionByName(p.where("p_partkey = 7").select("p_partkey", F.lit("add").alias("patchOp")))
    bad = bad.unionByName(p.limit(1).select(F.lit(-99).cast("long").alias("p_partkey"), F.lit("remove").alias("patchOp")))
    return P.patch_problems(p, bad).select("key", "op", "level")


@query("patch_list_delta", "SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN [p_brand, p_type, 'end'] WHEN 1 THEN [p_type] WHEN 2 THEN ['start', p_brand, p_type] ELSE [p_brand, 'swap'] END, '|') AS tags FROM part WHERE p_brand <> p_type")
def patch_list_delta(spark, sf):
    base = read(spark, sf, "part").where("p_brand <> p_type")
    t = base.select("p_partkey", F.array("p_brand", "p_type").alias("tags"))
    k = c("p_partkey") % 4
    patch = base.select(
        "p_partkey", F.when(k == 0, F.array(F.lit("end"))).alias("append_tags"), F.when(k == 1, F.array("p_brand")).alias("remove_tags"), F.when(k == 2, F.array(F.lit("start"))).alias("prepend_tags"), F.when(k == 3, c("p_type")).alias("replace_oldvalue_tags"), F.lit("swap").alias("replace_newvalue_tags")
    )
    return P.row_patch(t, patch).select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query("patch_map_delta", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a=9;b=2' ELSE 'b=2' END AS m FROM nation")
def patch_map_delta(spark, sf):
    n = read(spark, sf, "nation")
    t = n.select("n_nationkey", F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)).alias("m"))
    patch = n.select("n_nationkey", F.when(c("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.lit(9))).alias("append_m"), F.when(c("n_nationkey") % 2 == 1, F.create_map(F.lit("a"), F.lit(0))).alias("remove_m"))
    from typeloom.functions.collections import entries

    return P.row_patch(t, patch).select("n_nationkey", F.array_join(F.transform(entries(c("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("m"))


@query(
    "patch_bulk_rules",
    """WITH a AS (SELECT p_partkey, p_size * 2 AS p_size, p_retailprice FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 30)
    SELECT p_partkey, CASE WHEN p_size > 80 THEN p_size + 1 ELSE p_size END AS p_size FROM a WHERE p_partkey % 10 <> 3""",
)
def patch_bulk_rules(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    rules = [P.Rule(c("p_size") > 30, {"p_size": c("p_size") * 2}), P.Rule(c("p_partkey") % 10 == 3, remove=True), P.Rule(c("p_size") > 80, {"p_size": c("p_size") + 1})]
    return P.bulk_patch(p, rules).select("p_partkey", "p_size")


@query("patch_last_writer", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS value FROM orders GROUP BY 1")
def patch_last_writer(spark, sf):
    return P.last_writer(read(spark, sf, "orders").select("o_custkey", "o_orderdate", c("o_orderkey").alias("value")), ["o_custkey"], ["o_orderdate", "value"])


@query("recompute_dirty", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_partkey + l_suppkey ELSE -1 END AS a, CASE WHEN l_linenumber = 1 THEN (l_partkey + l_suppkey) * 2 ELSE -1 END AS b FROM lineitem")
def recompute_dirty(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    return P.recompute(df, {"a": c("l_partkey") + c("l_suppkey"), "b": c("a") * 2}, c("l_linenumber") == 1).select("l_orderkey", "l_linenumber", "a", "b")


def _events(spark, sf):
    e = read(spark, sf, "events")
    kind = F.when(c("event_id") % 50 == 7, "row").otherwise("cell")
    action = F.when(kind == "row", "remove").when(c("event_id") % 3 == 0, "= 1").otherwise("append x")
    return e.select(c("event_id").alias("seq"), kind.alias("kind"), F.lit("t").alias("target"), (c("user_id") % 97).cast("string").alias("pk"), F.when(kind == "cell", c("event_type")).alias("col"), action.alias("action"), (c("event_id") % 4).cast("string").alias("source"))


_EV = """e AS (SELECT event_id AS seq, event_id % 50 = 7 AS isrow, (user_id % 97)::VARCHAR AS pk, event_type AS col, event_id % 3 = 0 AS whole, event_id % 4 AS source FROM events)"""


@query(
    "lineage_conflicts",
    f"""WITH {_EV}, r AS (SELECT pk FROM e GROUP BY pk HAVING bool_or(isrow) AND count(DISTINCT source) >= 2),
    s AS (SELECT DISTINCT a.pk, a.col FROM e a JOIN e b ON a.pk = b.pk AND a.col = b.col AND NOT a.isrow AND NOT b.isrow AND a.whole AND b.seq < a.seq AND a.source <> b.source WHERE a.pk NOT IN (SELECT pk FROM r))
    SELECT 't' AS target, pk, NULL::VARCHAR AS col, 'row' AS kind FROM r UNION ALL SELECT 't', pk, col, 'cell' FROM s""",
)
def lineage_conflicts(spark, sf):
    return P.conflict_report(_events(spark, sf))


@query("lineage_report", f"WITH {_EV} SELECT seq, col FROM (SELECT seq, CASE WHEN NOT isrow THEN col END AS col, isrow FROM e WHERE pk = '5') WHERE isrow OR col = 'click'")
def lineage_report(spark, sf):
    return P.report(_events(spark, sf), target="t", pk="5", col="click").select("seq", "col")


@query("dirty_cells", f"WITH {_EV} SELECT DISTINCT 't' AS target, pk, col FROM e WHERE NOT isrow")
def dirty_cells(spark, sf):
    return P.dirty_cells(_events(spark, sf))


@query("lineage_of_patch", """SELECT p_partkey::VARCHAR AS pk, 'remove' AS action FROM part WHERE p_partkey > 0 AND p_partkey % 9 = 0 UNION ALL SELECT (-p_partkey)::VARCHAR, 'add' FROM part WHERE p_partkey BETWEEN 1 AND 4""")
def lineage_of_patch(spark, sf):
    before = _part(spark, sf)
    return P.events_of(before, P.row_patch(before, _patch(spark, sf)), "p_partkey", "part", "mod", 1).where("kind = 'row'").select("pk", "action")


@query("overlay_collect", "SELECT n_regionkey::VARCHAR AS target, 'c' AS \"column\", arg_max(n_name, n_nationkey) AS new_default, count(DISTINCT left(n_name, 1))::BIGINT AS n_types, CASE WHEN bool_or(n_nationkey % 3 = 1) THEN 'warn' ELSE 'error' END AS level FROM nation GROUP BY n_regionkey")
def overlay_collect(spark, sf):
    n = read(spark, sf, "nation").select(c("n_regionkey").cast("string").alias("target"), F.lit("c").alias("column"), c("n_name").alias("new_default"), F.left("n_name", F.lit(1)).alias("widen_to"), F.when(c("n_nationkey") % 3 == 1, "warn").otherwise("error").alias("level"), c("n_nationkey").alias("load_order"))
    return P.collect_overlays(n).select("target", "column", "new_default", F.size("widen_to").cast("long").alias("n_types"), "level")


@query("set_cells_where", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'special' ELSE p_type END AS p_type FROM part")
def set_cells_where(spark, sf):
    return M.set_cells_where(read(spark, sf, "part"), "p_type", "special", "p_brand", "Brand#11").select("p_partkey", "p_type")


@query("move_cells_matching", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|^S') THEN p_type ELSE p_brand END AS p_brand, CASE WHEN regexp_matches(p_type, 'STEEL|^S') THEN '' ELSE p_type END AS p_type FROM part")
def move_cells_matching(spark, sf):
    return M.move_cells_matching(read(spark, sf, "part"), "p_type", "p_brand", "STEEL|^S").select("p_partkey", "p_brand", "p_type")


@query("transform_cells", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_suppkey * 10 ELSE l_suppkey END AS l_suppkey FROM lineitem")
def transform_cells(spark, sf):
    return M.transform_cells(read(spark, sf, "lineitem"), "l_suppkey", F.when(c("l_linenumber") > 2, c("l_suppkey") * 10)).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("mutate_rows", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'HERE' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, n_name FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 101, 'NEW'")
def mutate_rows(spark, sf):
    t = read(spark, sf, "nation").select("n_nationkey", "n_name")
    t = M.remove_row(M.copy_row(t, 5, 100), 4)
    return M.add_row(M.set_cell(t, 3, "n_name", "HERE"), {"n_nationkey": 101, "n_name": "NEW"})


@query("mutate_columns", "SELECT n_nationkey, n_name AS label, n_name AS copied, 'x' AS flag FROM nation")
def mutate_columns(spark, sf):
    t = read(spark, sf, "nation")
    t = M.copy_column(M.rename_column(t, "n_name", "label"), "label", "copied")
    return M.remove_column(M.add_column(M.move_column(t, "label", 0), "flag", F.lit("x")), "n_regionkey")


@query("expr_dependency", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross, l_quantity > 25 AS bulky FROM lineitem")
def expr_dependency(spark, sf):
    from typeloom.operators.expression import derive

    out = derive(read(spark, sf, "lineitem"), {"gross0": "=self.net0 * (1 + self.l_tax)", "net0": "=self.l_extendedprice * (1 - self.l_discount)", "bulky": "=self.l_quantity > 25"})
    return out.select("l_orderkey", "l_linenumber", F.round("net0", 4).alias("net"), F.round("gross0", 6).alias("gross"), "bulky")


@query(
    "patch_plan",
    """WITH a AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 7 <> 3),
    b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'renamed ' || s_suppkey ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN 500.0 ELSE s_acctbal END AS s_acctbal FROM a)
    SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal + 1 END AS s_acctbal FROM b""",
)
def patch_plan(spark, sf):
    """Patches of three packages to one table in load order: removals, updates of what is left, a rule over all; one is gated, one has no target."""
    s = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    late = L.Patch("z rule", "Supplier", rules=(P.Rule(F.col("s_acctbal") < 0, {"s_acctbal": F.lit(-1.0)}), P.Rule(F.lit(True), {"s_acctbal": F.col("s_acctbal") + 1})), package="last")
    early = L.Patch("drop", "base:supplier", rows=s.where("s_suppkey % 7 = 3").select("s_suppkey", F.lit("remove").alias("patchOp")), package="first", order=1)
    update = L.Patch("names", "data/SUPPLIER", rows=s.where("s_suppkey % 5 = 0").select("s_suppkey", F.concat(F.lit("renamed "), k.cast("string")).alias("s_name"), F.lit("500.0").alias("s_acctbal")), package="second")
    gated = L.Patch("gated", "supplier", rules=(P.Rule(F.lit(True), remove=True),), if_packages=("absent",))
    lost = L.Patch("lost", "nowhere", rules=(P.Rule(F.lit(True), remove=True),))
    out, _ = L.apply_plan({"base/supplier": s}, [late, lost, update, gated, early], ["first", "second", "last"], {"base/supplier": "base"})
    return out["base/supplier"]


@query(
    "patch_plan_problems",
    """SELECT 'names' AS patch, s_suppkey::VARCHAR AS key, 'error' AS level, 'no such key' AS message FROM supplier WHERE s_suppkey % 7 = 3 AND s_suppkey % 5 = 0
    UNION ALL VALUES ('gated', NULL, 'info', 'needs absent'), ('lost', NULL, 'error', 'no such table'), ('drop', NULL, 'warn', 'one of 2 tables of that name'), ('foreign', NULL, 'error', 'not in package other')""",
)
def patch_plan_problems(spark, sf):
    s = read(spark, sf, "supplier").select("s_suppkey", "s_name")
    everything = (P.Rule(F.lit(False), remove=True),)
    plan = [
        L.Patch("drop", "supplier", rows=s.where("s_suppkey % 7 = 3").select("s_suppkey", F.lit("remove").alias("patchOp"))),
        L.Patch("names", "base:supplier", rows=s.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit("x").alias("s_name")), order=1),
        L.Patch("gated", "supplier", rules=everything, if_packages=("absent",)),
        L.Patch("lost", "nowhere", rules=everything),
        L.Patch("foreign", "other:supplier", rules=everything),
    ]
    _, problems = L.apply_plan({"base/supplier": s, "more/supplier": s}, plan, [], {"base/supplier": "base", "more/supplier": "more"})
    return problems.select("patch", "key", "level", "message")
