"""Types, casts, constraints, validators and table formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.operators import relational as R
from typeloom.operators import validate as V
from typeloom.sources import tables as T
from typeloom.sources import typespec as S

from .base import query, read

c = F.col


@query("range_checks", "SELECT p_partkey, p_size * 10 BETWEEN 0 AND 255 AS fits, CASE WHEN p_size * 10 <= 255 THEN (p_size * 10)::VARCHAR ELSE 'none' END AS ubyte FROM part")
def range_checks(spark, sf):
    text = (c("p_size") * 10).cast("string")
    return read(spark, sf, "part").select("p_partkey", V.in_range(c("p_size") * 10, 0, 255).alias("fits"), F.coalesce(V.to_sized(text, "ubyte").cast("string"), F.lit("none")).alias("ubyte"))


@query("enum_check", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(left(event_type, 1)) || substr(event_type, 2) END AS label FROM events")
def enum_check(spark, sf):
    return read(spark, sf, "events").select("event_id", V.to_enum(c("event_type"), ["Click", "View"]).alias("label"))


@query("union_cast", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'boolean' ELSE 'string' END AS kind FROM events")
def union_cast(spark, sf):
    text = F.element_at(F.array(F.lit("42"), F.lit("yes"), F.lit("word")), (c("event_id") % 3 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", V.to_union(text, ["integer", "boolean", "string"])["type"].alias("kind"))


@query("type_casts", "SELECT pk, \"column\", type FROM (SELECT event_id::VARCHAR AS pk, 'value' AS \"column\", 'ubyte' AS type FROM events WHERE value <> floor(value) OR value > 255 OR value < 0 UNION ALL SELECT event_id::VARCHAR, 'flag', 'boolean' FROM events WHERE event_id % 4 = 0)")
def type_casts(spark, sf):
    e = read(spark, sf, "events")
    text = F.when(c("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(c("value").cast("string"))
    df = e.select("event_id", text.alias("value"), F.when(c("event_id") % 4 == 0, "maybe").otherwise("yes").alias("flag"))
    return V.cast_violations(df, {"value": "ubyte", "flag": "boolean"}, "event_id", "events").select("pk", "column", "type")


@query("validate_row", "SELECT o_orderkey::VARCHAR AS pk, CASE WHEN o_totalprice < 1000 THEN 'price' ELSE 'status' END AS \"column\", CASE WHEN o_totalprice < 1000 THEN 'error' ELSE 'warn' END AS level, CASE WHEN o_totalprice < 1000 THEN 'too cheap' ELSE 'open: O' END AS message FROM orders WHERE o_totalprice < 1000 OR o_orderstatus = 'O'")
def validate_row(spark, sf):
    checks = [V.Validator("price", c("o_totalprice") >= 1000, "error", "too cheap"), V.Validator("status", F.when(c("o_orderstatus") == "O", F.concat(F.lit("open: "), c("o_orderstatus"))).otherwise(""), "warn")]
    return V.row_violations(read(spark, sf, "orders"), checks, "o_orderkey", "orders").select("pk", "column", "level", "message")


@query("validate_file", "SELECT 'orders' AS source, 'unique customers' AS \"column\", 'warn' AS level WHERE (SELECT count(*) > count(DISTINCT o_custkey) FROM orders)")
def validate_file(spark, sf):
    checks = [V.Validator("unique customers", R.unique("o_custkey"), "warn"), V.Validator("all priced", R.all_of(c("o_totalprice") > 0))]
    return V.file_violations(read(spark, sf, "orders"), checks, "orders").select("source", "column", "level")


@query("validate_level", "SELECT s_suppkey::VARCHAR AS pk, 'warn' AS level FROM supplier WHERE s_acctbal < 0")
def validate_level(spark, sf):
    checks = V.override_levels([V.Validator("balance", c("s_acctbal") >= 0), V.Validator("name", F.lit(False))], {"balance": "warn", "name": "none"})
    return V.row_violations(read(spark, sf, "supplier"), checks, "s_suppkey").select("pk", "level")


@query("key_violations", "SELECT l_orderkey::VARCHAR AS pk, 'duplicate key, rows: ' || count(*)::VARCHAR AS message FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def key_violations(spark, sf):
    return V.key_violations(read(spark, sf, "lineitem"), "l_orderkey", "lineitem").select("pk", "message")


@query("default_coalesce", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN 14 ELSE user_id * 2 END AS doubled FROM events")
def default_coalesce(spark, sf):
    e = read(spark, sf, "events")
    raw = e.select(c("event_id").alias("_line"), F.array(c("event_id").cast("string"), F.when(c("event_id") % 3 == 0, "").otherwise(c("user_id").cast("string")), F.lit("")).alias("cells"))
    columns = S.header(["event_id:long", "user_id:long:7", "doubled:long:=self.user_id * 2"])
    return T.typed(raw, columns).select("event_id", "user_id", "doubled")


@query("typed_json_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def typed_json_round_trip(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return T.read_typed_json(T.typed_json(df), df.schema)


@query("sql_insert_lines", "SELECT 'INSERT INTO \"nation\" VALUES (' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ');' AS value FROM nation")
def sql_insert_lines(spark, sf):
    return T.insert_lines(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


@query("tsv_lines", "SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS value FROM nation")
def tsv_lines(spark, sf):
    return T.tsv_lines(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("order_files_priority", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, lower(p_name || p_partkey)) AS place FROM part")
def order_files_priority(spark, sf):
    f = read(spark, sf, "part").select("p_partkey", F.concat("p_name", c("p_partkey").cast("string")).alias("path"), c("p_size").alias("load_order"))
    return T.load_order(f).select("p_partkey", c("place").cast("long").alias("place"))


@query("glob_match", r"SELECT page_id, regexp_matches(lower(url), '^(?:.*/)?[^/]*\.html$') AS hit FROM pages")
def glob_match(spark, sf):
    return read(spark, sf, "pages").select("page_id", c("url").rlike(T.glob_regex("*.html")).alias("hit"))
