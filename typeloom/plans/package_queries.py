"""Orders of typed values, custom types, package catalogs, table reads and round trips through cells and files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import codecs as K
from typeloom.functions import predicates as P
from typeloom.functions import strings as S
from typeloom.operators import ordering as O
from typeloom.operators import relational as R
from typeloom.operators.stable import place
from typeloom.sources import customtypes as CT
from typeloom.sources import files as FL
from typeloom.sources import formats as FM
from typeloom.sources import jsondocs as JD
from typeloom.sources import lattice as LT
from typeloom.sources import packages as PK
from typeloom.sources import tables as TB
from typeloom.sources import typespec as TS

from .base import query, read

c = F.col


# -- orders --


@query("compare_sequences", "SELECT event_id, CASE WHEN [user_id, event_id % 3] < [event_id % 7, 1, 2] THEN -1 WHEN [user_id, event_id % 3] > [event_id % 7, 1, 2] THEN 1 ELSE 0 END AS cmp FROM events")
def compare_sequences(spark, sf):
    a = F.array(c("user_id").cast("long"), (c("event_id") % 3).cast("long"))
    b = F.array((c("event_id") % 7).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long"))
    return read(spark, sf, "events").select("event_id", O.compare(a, b, T.ArrayType(T.LongType())).alias("cmp"))


@query(
    "compare_tuples",
    "SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN -1 WHEN b IS NULL THEN 1 WHEN lower(a) < lower(b) THEN -1 WHEN lower(a) > lower(b) THEN 1 WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END AS cmp FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN upper(event_type) END AS a, CASE WHEN event_id % 3 > 0 THEN lead(event_type) OVER (ORDER BY event_id) END AS b, value AS x, user_id::DOUBLE AS y FROM events)",
)
def compare_tuples(spark, sf):
    kind = T.StructType([T.StructField("_1", T.StringType()), T.StructField("_2", T.DoubleType())])
    df = R.beside(read(spark, sf, "events").select("event_id", "event_type", "value", "user_id"), "event_id", "event_type", "next")
    a = F.struct(F.when(c("event_id") % 5 > 0, F.upper("event_type")).alias("_1"), c("value").cast("double").alias("_2"))
    b = F.struct(F.when(c("event_id") % 3 > 0, c("next")).alias("_1"), c("user_id").cast("double").alias("_2"))
    both_null = a["_1"].isNull() & b["_1"].isNull()
    # the oracle stops at two absent first elements
    return df.select("event_id", F.when(both_null, 0).otherwise(O.compare(a, b, kind)).alias("cmp"))


@query("compare_maps", "SELECT p_partkey, CASE WHEN p_size % 4 < p_partkey % 4 THEN -1 WHEN p_size % 4 > p_partkey % 4 THEN 1 WHEN p_size < 20 THEN -1 WHEN p_size > 20 THEN 1 ELSE 0 END AS cmp, p_size % 4 = p_partkey % 4 AND p_size = 20 AS same FROM part")
def compare_maps(spark, sf):
    kind = T.MapType(T.StringType(), T.LongType())
    a = F.create_map(F.lit("z"), c("p_size").cast("long"), F.lit("a"), (c("p_size") % 4).cast("long"))
    b = F.create_map(F.lit("a"), (c("p_partkey") % 4).cast("long"), F.lit("z"), F.lit(20).cast("long"))
    return read(spark, sf, "part").select("p_partkey", O.compare(a, b, kind).alias("cmp"), O.same(a, b, kind).alias("same"))


@query("order_typed", "SELECT s_suppkey, row_number() OVER (ORDER BY lower(CASE WHEN s_suppkey % 4 > 0 THEN upper(n_name) ELSE n_name END), s_acctbal > 0, s_suppkey) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def order_typed(spark, sf):
    df = read(spark, sf, "supplier").join(read(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey"))
    df = df.select("s_suppkey", F.when(c("s_suppkey") % 4 > 0, F.upper("n_name")).otherwise(c("n_name")).alias("name"), (c("s_acctbal") > 0).alias("rich"))
    keyed = df.select("s_suppkey", O.sort_key(c("name"), T.StringType()).alias("k1"), O.sort_key(c("rich"), T.BooleanType()).alias("k2"))
    return R.numbered(keyed, ["k1", "k2", "s_suppkey"], "place").select("s_suppkey", "place")


# -- custom types --


TYPES = [
    CT.Declared("size", "ubyte", least=5, most=40),
    CT.Declared("evensize", "size", expression="=value % 2 == 0"),
    CT.Declared("shortname", "string", min_bytes=8, max_bytes=11),
    CT.Declared("ringname", "shortname", pattern="ring$|^red"),
    CT.Declared("kind", "{enum:ECONOMY|PROMO|STANDARD|LARGE|MEDIUM|SMALL}", labels=("PROMO", "ECONOMY")),
    CT.Declared("codeorflag", "integer|boolean|string", members=("integer", "boolean")),
    CT.Declared("point", "string", shape="{number,number}"),
    CT.Declared("measures", "number", tagged=("ubyte", "float")),
]


@query(
    "custom_type_violations",
    """SELECT p_partkey::VARCHAR AS pk, 'p_size' AS "column", p_size::VARCHAR AS value, CASE WHEN p_size < 5 THEN 'below 5' WHEN p_size > 40 THEN 'above 40' ELSE 'not value % 2 == 0' END AS message FROM part WHERE p_size < 5 OR p_size > 40 OR p_size % 2 = 1
    UNION ALL SELECT p_partkey::VARCHAR, 'p_name', p_name, CASE WHEN strlen(p_name) < 8 THEN 'under 8 bytes' WHEN strlen(p_name) > 11 THEN 'over 11 bytes' ELSE 'does not match ring$|^red' END FROM part WHERE strlen(p_name) < 8 OR strlen(p_name) > 11 OR NOT regexp_matches(p_name, 'ring$|^red')
    UNION ALL SELECT p_partkey::VARCHAR, 'p_type', p_type, 'no kind' FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY')""",
)
def custom_type_violations(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", c("p_size").cast("string").alias("p_size"), "p_name", "p_type")
    return CT.CustomTypes(TYPES).violations(df, {"p_size": "evensize", "p_name": "ringname", "p_type": "kind"}, "p_partkey", "part").select("pk", "column", "value", "message")


@query("custom_type_values", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 40 AND p_size % 2 = 0 THEN p_size::BIGINT END AS size, CASE p_partkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'boolean' END AS tag, CASE WHEN p_partkey % 2 = 0 THEN '{\"_1\":' || p_size || '.0,\"_2\":0.5}' END AS point FROM part")
def custom_type_values(spark, sf):
    t = CT.CustomTypes(TYPES)
    union = F.when(c("p_partkey") % 3 == 0, F.lit("17")).when(c("p_partkey") % 3 == 1, F.lit("yes")).otherwise(F.lit("word"))
    pair = F.concat(F.lit("{"), c("p_size").cast("string"), F.when(c("p_partkey") % 2 == 0, F.lit(",0.5}")).otherwise(F.lit("}")))
    return read(spark, sf, "part").select("p_partkey", t.value(c("p_size").cast("string"), "evensize").alias("size"), t.value(union, "codeorflag")["type"].alias("tag"), t.value(pair, "point").alias("point"))


# -- packages --


def _files(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand", F.concat("p_name", F.lit("_"), c("p_partkey").cast("string"))).alias("path"))


@query("package_owners", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'brand two' WHEN p_type = 'PROMO' THEN 'promo' END AS package FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, NULL FROM part WHERE p_type <> 'PROMO'")
def package_owners(spark, sf):
    packages = spark.createDataFrame([("promo", "promo/"), ("brand two", "PROMO/Brand#2")], "id string, path string")
    return PK.owners(_files(spark, sf), packages).select("p_partkey", "package")


@query("package_overlaps", "SELECT DISTINCT p_type || '/' || p_brand AS subject, 'lies inside ' || p_type AS problem FROM part")
def package_overlaps(spark, sf):
    p = read(spark, sf, "part")
    packages = p.select(c("p_type").alias("id"), c("p_type").alias("path")).distinct().unionByName(p.select(F.concat_ws("/", "p_type", "p_brand").alias("id"), F.concat_ws("/", "p_type", "p_brand").alias("path")).distinct())
    return PK.overlap_problems(packages)


@query("package_dependencies", "SELECT 'p' || n_nationkey AS subject, CASE WHEN n_nationkey + 7 > (SELECT max(n_nationkey) FROM nation) THEN 'needs p' || (n_nationkey + 7) ELSE 'needs p' || (n_nationkey + 7) || ' ^ 1.2.0' END AS problem FROM nation WHERE n_nationkey + 7 > (SELECT max(n_nationkey) FROM nation) OR n_nationkey % 3 < 2 UNION ALL SELECT 'p' || n_nationkey, 'conflicts with p' || n_nationkey // 2 FROM nation WHERE n_regionkey = 0")
def package_dependencies(spark, sf):
    k = c("n_nationkey")
    # a package p(n) of version 1.(n + 2) % 3.0 needs p(n + 7) ^1.2.0
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    m = read(spark, sf, "nation").select(
        name(k).alias("id"),
        F.concat(F.lit("1."), ((k + 2) % 3).cast("string"), F.lit(".0")).alias("version"),
        F.array(F.struct(name(k + 7).alias("id"), F.lit("^").alias("op"), F.lit("1.2.0").alias("version"))).alias("dependencies"),
        F.when(c("n_regionkey") == 0, F.array(name(F.floor(k / 2)))).alias("conflicts"),
    )
    return PK.dependency_problems(m)


@query("join_targets", "SELECT p_type || '/' || p_partkey AS subject, CASE WHEN p_partkey % 4 = 1 THEN 'joins into an unknown file' WHEN p_partkey % 4 = 2 THEN 'joins into itself' ELSE 'joins into a joined file' END AS problem FROM part WHERE p_partkey % 4 IN (1, 2) OR p_partkey % 4 = 3")
def join_targets(spark, sf):
    k = c("p_partkey")
    path = lambda t, x: F.concat(t, F.lit("/"), x.cast("string"))
    own = F.when(k % 4 == 1, F.lit("nowhere")).when(k % 4 == 2, F.upper(path(c("p_type"), k))).when(k % 4 == 3, c("before"))
    named = R.beside(read(spark, sf, "part").select(k, "p_type", path(c("p_type"), k).alias("path")), "p_partkey", "path", "before", before=True)
    return PK.join_target_problems(named.select("path", own.alias("join_into")))


@query("path_suffixes", "SELECT upper(p_name) || '_' || p_partkey AS name, p_type || '/' || p_brand || '/' || p_name || '_' || p_partkey AS path FROM part")
def path_suffixes(spark, sf):
    wanted = read(spark, sf, "part").select(F.concat(F.upper("p_name"), F.lit("_"), c("p_partkey").cast("string")).alias("name"))
    return PK.resolve_paths(wanted, _files(spark, sf))


@query("join_grouping", "SELECT lower(p_type) AS primary, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS secondaries FROM part WHERE p_size < 10 GROUP BY 1".replace("AS primary", 'AS "primary"'))
def join_grouping(spark, sf):
    catalog = read(spark, sf, "part").select(c("p_partkey").cast("string").alias("path"), F.when(c("p_size") < 10, c("p_type")).otherwise("").alias("join_into"))
    return PK.join_groups(catalog).select("primary", F.array_join("secondaries", ",").alias("secondaries"))


@query("catalog_edits", "SELECT p_partkey, CASE p_partkey WHEN 3 THEN 99 ELSE p_size END AS load_order, p_size < 10 AND p_partkey % 2 = 0 OR p_size >= 10 AS exported FROM part WHERE p_partkey <> 5")
def catalog_edits(spark, sf):
    files = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("F"), c("p_partkey").cast("string")).alias("path"), c("p_size").cast("int").alias("load_order"), F.when(c("p_size") < 10, "x").otherwise("").alias("join_into"), F.when((c("p_size") < 10) & (c("p_partkey") % 2 == 0), True).alias("export"))
    out = PK.remove_entry(PK.set_entry(files, "f3", "load_order", 99), "f5")
    kept = PK.exported(out).select("p_partkey", F.lit(True).alias("exported"))
    return out.join(kept, "p_partkey", "left").select("p_partkey", "load_order", F.coalesce("exported", F.lit(False)).alias("exported"))


@query("undeclared_files", "SELECT p_type || '/' || p_brand || '/' || p_name || '_' || p_partkey AS subject, 'not declared' AS problem FROM part WHERE p_size >= 10")
def undeclared_files(spark, sf):
    f = _files(spark, sf)
    declared = f.join(read(spark, sf, "part").where("p_size < 10").select("p_partkey"), "p_partkey").select(F.upper("path").alias("path"))
    return PK.undeclared(f, declared)


@query("variant_choices", "SELECT p_type AS \"group\", CASE WHEN count(*) FILTER (WHERE p_brand = 'Brand#2') > 0 THEN 'Brand#2' WHEN min(p_brand) FILTER (WHERE p_size = 1) = max(p_brand) FILTER (WHERE p_size = 1) THEN min(p_brand) FILTER (WHERE p_size = 1) END AS variant FROM part GROUP BY 1")
def variant_choices(spark, sf):
    return PK.variant_choices(read(spark, sf, "part").select(c("p_type").alias("group"), c("p_brand").alias("variant"), (c("p_size") == 1).alias("is_default")), ["Brand#2"])


@query("package_validators", "SELECT 'orders have lines' AS \"column\", 'error' AS level, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) || ' orders without lines' AS message WHERE (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) > 0 UNION ALL SELECT 'rich', 'warn', 'no rich customer' WHERE (SELECT max(c_acctbal) FROM customer) < 1e9")
def package_validators(spark, sf):
    def lines(t):
        bad = R.exists_in(t["orders"], t["lineitem"].select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", negate=True).agg(F.count("*").alias("n"))
        return bad.select(F.when(c("n") > 0, F.concat(c("n").cast("string"), F.lit(" orders without lines"))).otherwise("").alias("verdict"))

    def rich(t):
        return t["customer"].agg((F.max("c_acctbal") >= 1e9).alias("verdict"))

    tables = {n: read(spark, sf, n) for n in ("orders", "lineitem", "customer")}
    return PK.package_violations(tables, [("orders have lines", lines, "error", ""), ("rich", rich, "warn", "no rich customer")]).select("column", "level", "message")


@query("processors_in_order", "SELECT s_suppkey, (s_acctbal + 1) * 2 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def processors_in_order(spark, sf):
    steps = [
        ("double", 20, "supplier", lambda df: df.withColumn("s_acctbal", c("s_acctbal") * 2)),
        ("broken", 15, "supplier", lambda df: df.select("no such column")),
        ("add", 10, "supplier", lambda df: df.withColumn("s_acctbal", c("s_acctbal") + 1)),
        ("even", 20, "supplier", lambda df: df.where("s_suppkey % 2 = 0")),
        ("foreign", 5, "nation", lambda df: df.limit(0)),
    ]
    out, problems = PK.run_processors({"supplier": read(spark, sf, "supplier"), "nation": read(spark, sf, "nation")}, steps, {"supplier"})
    assert [p[0] for p in problems] == ["foreign", "broken"]
    return out["supplier"].select("s_suppkey", "s_acctbal")


@query("batch_results", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10 ELSE n_nationkey * 10 + 1 END::BIGINT AS score FROM nation")
def batch_results(spark, sf):
    n = read(spark, sf, "nation")
    # results without a name hold another score at the row's place
    named = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("n_name")).alias("n_name"), (c("n_nationkey") + 1000).alias("_pos"), (c("n_nationkey") * 10).cast("long").alias("score"))
    placed = n.select(F.concat(F.lit("?"), "n_name").alias("n_name"), c("n_nationkey").alias("_pos"), (c("n_nationkey") * 10 + 1).cast("long").alias("score"))
    return PK.match_results(n.select("n_nationkey", "n_name", c("n_nationkey").alias("_pos")), named.unionByName(placed), "n_name").select("n_nationkey", "score")


# -- cells and files --


@query("literal_cells", "SELECT l_orderkey, l_linenumber, l_partkey || ',' || l_suppkey AS ids, l_returnflag AS flag, l_quantity AS qty FROM lineitem")
def literal_cells(spark, sf):
    """Containers written as table literals, then read back through typed cells."""
    kinds = TS.header(["key", "ids:{long}", "info:{flag:string,qty:number}"])
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_partkey", "l_suppkey").alias("ids"), F.struct(c("l_returnflag").alias("flag"), c("l_quantity").alias("qty")).alias("info"))
    raw = df.select(c("l_orderkey").cast("long").alias("_line"), F.array(c("l_linenumber").cast("string"), TB.cell_text(c("ids"), df.schema["ids"].dataType, "literal"), TB.cell_text(c("info"), df.schema["info"].dataType, "literal")).alias("cells"))
    back = TB.typed(raw, kinds)
    return back.select(c("_line").alias("l_orderkey"), c("key").cast("int").alias("l_linenumber"), F.array_join(c("ids").cast("array<string>"), ",").alias("ids"), "info.flag", "info.qty")


@query("msgpack_round_trip", "SELECT event_id, event_type, user_id, hex_ok FROM (SELECT event_id, event_type, user_id, true AS hex_ok FROM events)")
def msgpack_round_trip(spark, sf):
    packed = K.to_msgpack(F.struct("event_type", "user_id"))
    sql = K.sql_blob(packed)
    df = read(spark, sf, "events").select("event_id", packed.alias("m"), sql.alias("s"))
    back = F.from_json(K.from_msgpack(K.from_sql_blob(c("s"))), "event_type string, user_id bigint")
    return df.select("event_id", back.alias("b"), (F.upper(F.hex("m")) == F.upper(F.regexp_extract("s", "'(.*)'", 1))).alias("hex_ok")).select("event_id", "b.event_type", "b.user_id", "hex_ok")


@query("natural_json_rows", """SELECT '[' || c_custkey || ',"' || c_name || '",' || c_nationkey || ',' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'null' END || ']' AS value FROM customer""")
def natural_json_rows(spark, sf):
    return TB.natural_json(read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(c("c_acctbal") > 0, True).alias("rich")))


@query("raw_line_reads", "SELECT (SELECT count(*) FROM nation) AS n_rows, (SELECT count(*) FROM nation) + 1 AS n_lines, n_name AS cell FROM nation WHERE n_nationkey = 4")
def raw_line_reads(spark, sf):
    n = read(spark, sf, "nation").select(c("n_nationkey").cast("string").alias("k"), "n_name")
    lines = n.select((c("k").cast("long") + 2).alias("_line"), F.concat_ws("\t", "k", "n_name").alias("value")).unionByName(spark.range(1).select(F.lit(1).cast("long").alias("_line"), F.lit("# a comment").alias("value")))
    raw = TB.raw_rows(lines)
    total = lines.agg(F.count("*").alias("n_lines")).join(F.broadcast(raw.agg(F.count("*").alias("n_rows"))))
    return total.join(F.broadcast(TB.row_at(raw, 5).select(c("cells")[1].alias("cell")))).select("n_rows", "n_lines", "cell")


@query("escapes_and_classes", r"SELECT p_partkey, p_name || chr(10) || 'x' AS text, regexp_matches(p_name, '[w[:^alpha:]]') AS hit, NOT regexp_matches(p_name, '[w[:^alpha:]]') AS none FROM part")
def escapes_and_classes(spark, sf):
    text = S.unescape_text(F.concat("p_name", F.lit("\\n\\x")))
    return read(spark, sf, "part").select("p_partkey", text.alias("text"), S.matches_any(c("p_name"), "[w%A]").alias("hit"), (~S.matches_any(c("p_name"), "[w%A]")).alias("none"))


@query("predicates_more", r"SELECT event_id, event_id % 4 = 0 AS percent, event_id % 3 = 1 AS pattern, value = floor(value) AND value > 0 AS positive_integer, coalesce(nullif(event_type, 'click'), '') <> '' AS non_default FROM events")
def predicates_more(spark, sf):
    k = c("event_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (k % len(x) + 1).cast("int"))
    kind = F.when(c("event_type") == "click", "").otherwise(c("event_type"))
    return read(spark, sf, "events").select("event_id", P.is_percent(pick("12.5%", "5%\n", "1/-2", "3/00")).alias("percent"), P.is_pattern(pick("[a-z", "^%d+[%]]$", "a%")).alias("pattern"), P.is_positive_integer(c("value")).alias("positive_integer"), P.is_non_default(kind, T.StringType()).alias("non_default"))


@query("expressions_by_operand", "SELECT event_id, coalesce(CASE WHEN event_id % 4 > 0 THEN value END, 5) AS v, CASE WHEN event_id % 4 > 0 THEN 'set' ELSE 'unset' END AS word, event_id % 4 = 0 AS absent, strlen(event_type)::BIGINT + 1 AS size FROM events")
def expressions_by_operand(spark, sf):
    from typeloom.operators.expression import derive

    e = read(spark, sf, "events").select("event_id", F.when(c("event_id") % 4 > 0, c("value")).alias("raw"), "event_type")
    out = derive(e, {"v": "=self.raw or 5", "word": "=self.raw and 'set' or 'unset'", "absent": "=not self.raw", "size": "=#self.event_type + 1"})
    return out.select("event_id", "v", "word", "absent", c("size").cast("long").alias("size"))


@query("expressions_mixed", """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN (event_id % 3 - 1)::BIGINT END AS n, CASE WHEN event_id % 5 > 0 THEN event_id % 2 = 0 END AS b,
  CASE WHEN event_id % 7 > 0 THEN value END AS v, event_type AS t, CASE WHEN event_id % 2 = 0 THEN (event_id % 100)::VARCHAR ELSE event_type END AS digits FROM events)
SELECT event_id, CASE WHEN b THEN 'true' ELSE t END AS flag_or_text, CASE WHEN n = 0 THEN 'zero' ELSE n::VARCHAR END AS zero_or_n, typeof_ AS kind,
  floor(n / 2)::BIGINT AS halves, upper(t) || ((n + 2)::VARCHAR) AS loud, CASE WHEN b IS NULL THEN false ELSE b = coalesce(n = 0, false) END AS chained,
  CASE WHEN coalesce(b, false) THEN NULL ELSE n + 1 END::DOUBLE AS sum, TRY_CAST(digits AS DOUBLE) * 2 AS doubled, coalesce(n = TRY_CAST(digits AS BIGINT), false) AND false AS never,
  substr(t, length(t) - 1) AS tail, n * 2 AS by_place, 10 + coalesce(v, 0.5) * 2 AS published
FROM (SELECT *, CASE WHEN coalesce(b, false) THEN 'boolean' WHEN v IS NOT NULL THEN 'number' ELSE 'string' END AS typeof_ FROM e)""")
def expressions_mixed(spark, sf):
    """Operands of several kinds: what each row holds decides, and what the language refuses is null in that row."""
    from typeloom.operators.expression import derive

    k = c("event_id")
    e = read(spark, sf, "events").select(
        F.when(k % 4 > 0, (k % 3 - 1).cast("long")).alias("n"), F.when(k % 5 > 0, k % 2 == 0).alias("b"), F.when(k % 7 > 0, c("value")).alias("v"),
        c("event_type").alias("t"), F.when(k % 2 == 0, (k % 100).cast("string")).otherwise(c("event_type")).alias("digits"), k.alias("event_id"),
    )
    made = {
        "flag_or_text": "=self.b or self.t", "zero_or_n": "=self.n == 0 and 'zero' or self.n", "kind": "=type(self.b or self.v or self.t)", "halves": "=self.n // 2",
        "loud": "=string.upper(self.t) .. self.n + 2", "chained": "=self.b ~= nil and self.b == (self.n == 0)", "sum": "=(self.b or self.n) + 1", "doubled": "=self.digits * 2",
        "never": "=self.n == self.digits", "tail": "=self.t:sub(-2)", "by_place": "=self[1] * 2", "published": "=Base.Level.start + (self.v or 0.5) * 2",
    }
    out = derive(e, made, {"Base.Level.start": F.lit(10)})
    return out.select("event_id", c("flag_or_text").cast("string").alias("flag_or_text"), c("zero_or_n").cast("string").alias("zero_or_n"), *[n for n in made if n not in ("flag_or_text", "zero_or_n")])


@query("tsv_gzip_round_trip", "SELECT s_suppkey + 1 AS _line, s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def tsv_gzip_round_trip(spark, sf):
    """A typed table written as compressed lines, and read back with its types."""
    df = read(spark, sf, "supplier").select("s_suppkey", "s_name", F.when(c("s_acctbal") > 0, c("s_acctbal")).alias("s_acctbal"))
    path = place(spark, "tsv")
    TB.write_tsv(df.orderBy("s_suppkey").coalesce(1), path, "gzip")
    back = TB.typed(TB.raw_rows(TB.lines(spark, path)), TS.header(["s_suppkey:long", "s_name:string", "s_acctbal:float|nil"]))
    return back


@query("triples_file", "SELECT p_partkey::VARCHAR AS entity, p_type AS kind, CASE WHEN p_size > 9 THEN p_size::VARCHAR ELSE '' END AS size FROM part")
def triples_file(spark, sf):
    """A wide table as triples in a file, and wide again."""
    p = read(spark, sf, "part").select("p_partkey", c("p_type").alias("kind"), F.when(c("p_size") > 9, c("p_size").cast("string")).alias("size"))
    path = place(spark, "eav")
    long = R.unpivot(p, "p_partkey")
    long.select(F.concat_ws("\t", "entity", "attribute", "value").alias("value")).orderBy("value").coalesce(1).write.text(path)
    return TB.read_triples(spark, path).select("entity", "kind", "size")


@query("xml_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def xml_round_trip(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = place(spark, "xml")
    TB.write_xml(df, path)
    return TB.read_xml(spark, path, df.schema)


@query("sql_text_round_trip", "SELECT doc_id, concat(chr(39), text, chr(10), ', ', source, chr(39)) AS text, lang, n_chars FROM documents")
def sql_text_round_trip(spark, sf):
    """Texts with line ends, commas and quotes as statements that span lines, and back."""
    df = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("'"), F.coalesce("text", F.lit("")), F.lit("\n, "), F.coalesce("source", F.lit("")), F.lit("'")).alias("text"), "lang", "n_chars")
    path = place(spark, "sql")
    TB.insert_lines(df, "documents").write.text(path)
    return FL.read_inserts(FL.statements(spark, path), "documents", df.schema)


@query("json_layouts", "SELECT o_orderkey, o_orderstatus || '[' || chr(34) || '}' AS word, o_orderkey AS in_rows, o_totalprice AS price, o_orderstatus || '[' || chr(34) || '}' AS in_columns FROM orders")
def json_layouts(spark, sf):
    """One table as a JSON document of objects, of rows and of columns, each written from ordered parts and read back in splits."""
    columns = TS.header(["o_orderkey:long", "word:string", "price:float"])
    o = read(spark, sf, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit('["}')).alias("word"), (c("o_totalprice") * 1.0).alias("price"))
    back = {}
    for layout in ("objects", "rows", "columns"):
        path = place(spark, "json")
        JD.write_json(o, path, layout, "o_orderkey")
        back[layout] = TB.parse_json(spark, path, layout, columns)
    out = back["objects"].select("_line", "o_orderkey", "word")
    out = out.join(back["rows"].select("_line", c("o_orderkey").alias("in_rows"), "price"), "_line")
    return out.join(back["columns"].select("_line", c("word").alias("in_columns")), "_line").drop("_line")


_PART_TYPES = """p AS (SELECT p_partkey, p_type AS t1, p_type || '.' || p_brand AS t2, p_type || '.' || p_brand || '.' || p_size AS t3 FROM part),
t AS (SELECT DISTINCT t3 AS name, t2 AS parent FROM p UNION SELECT DISTINCT t2, t1 FROM p UNION SELECT DISTINCT t1, 'name' FROM p UNION SELECT 'name', 'ascii' UNION SELECT 'ascii', 'string'),
c AS (SELECT name, name AS ancestor, 0 AS steps FROM t UNION ALL SELECT c.name, t.parent, steps + 1 FROM c JOIN t ON t.name = c.ancestor)"""


def _part_types(spark, sf):
    """The parts' types (kind, brand and size), and all types: a kind is a name, a brand's kind is narrower than the kind, and so on."""
    names = [F.concat_ws(".", *[c(x).cast("string") for x in ("p_type", "p_brand", "p_size")[:n]]) for n in (1, 2, 3)]
    parts = read(spark, sf, "part").select("p_partkey", *[x.alias(f"t{n}") for n, x in enumerate(names, 1)])
    links = F.array(F.struct(c("t3").alias("name"), c("t2").alias("parent")), F.struct(c("t2").alias("name"), c("t1").alias("parent")), F.struct(c("t1").alias("name"), F.lit("name").alias("parent")))
    return parts, parts.select(F.inline(links)).distinct().unionByName(LT.built_in(spark))


@query("type_lattice", f"""WITH RECURSIVE {_PART_TYPES}, d AS (SELECT name, max(steps) AS depth FROM c GROUP BY name),
w AS (SELECT DISTINCT p_partkey // 3 AS col, t3 FROM p), n AS (SELECT col, count(*) AS n_types FROM w GROUP BY col),
m AS (SELECT col, ancestor, count(*) AS hits FROM w JOIN c ON c.name = t3 GROUP BY ALL)
SELECT col, any_value(n_types) AS n_types, max_by(ancestor, coalesce(depth, 0)) AS type FROM m JOIN n USING (col) LEFT JOIN d ON d.name = ancestor WHERE hits = n_types GROUP BY col""")
def type_lattice(spark, sf):
    """Columns that three parts each widen to their own type: the narrowest type for all of them."""
    parts, types = _part_types(spark, sf)
    return LT.least_upper(parts.select(F.floor(c("p_partkey") / 3).alias("col"), c("t3").alias("type")), LT.closure(types), ["col"])


@query("type_narrower", f"""WITH RECURSIVE {_PART_TYPES}, q AS (SELECT DISTINCT p.t3 AS a, list_element(['ascii', 'integer', p.t1, q.t1, p.t2, q.t2], (p.p_partkey % 6 + 1)::INTEGER) AS b FROM p JOIN p q ON q.p_partkey = p.p_partkey + 1)
SELECT a, b, EXISTS (SELECT 1 FROM c WHERE c.name = a AND c.ancestor = b) AS narrower FROM q""")
def type_narrower(spark, sf):
    """Subtype tests of a table of pairs, built-in and derived types mixed."""
    parts, types = _part_types(spark, sf)
    other = parts.select((c("p_partkey") - 1).alias("p_partkey"), c("t1").alias("n1"), c("t2").alias("n2"))
    b = F.element_at(F.array(F.lit("ascii"), F.lit("integer"), "t1", "n1", "t2", "n2"), (c("p_partkey") % 6 + 1).cast("int"))
    pairs = parts.join(other, "p_partkey").select(c("t3").alias("a"), b.alias("b")).distinct()
    return LT.narrower(pairs, LT.closure(types))


@query("exploded_columns", "SELECT c_custkey, c_nationkey AS level, c_acctbal AS x, c_custkey % 7 AS y FROM customer")
def exploded_columns(spark, sf):
    """Columns spelled out in a header, put together as one nested value and taken apart again."""
    df = read(spark, sf, "customer").select("c_custkey", c("c_nationkey").alias("at.level"), c("c_acctbal").alias("pos._1"), (c("c_custkey") % 7).alias("pos._2"))
    found = TS.exploded(df.columns)
    made = df.toDF("c_custkey", "level", "x", "y")
    out = R.implode(made, "pos", {"_1": "x", "_2": "y"}, found["pos"]["kind"])
    out = R.implode(out, "at", {"level": "level"}, found["at"]["kind"])
    return out.select("c_custkey", "at.level", c("pos._1").alias("x"), c("pos._2").alias("y"))


_PLANTED = r"""CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('  ', chr(9), text, chr(10), chr(92), 't', chr(92), 'N', chr(39), '); -- ', chr(13), ' ')
  WHEN 3 THEN concat(chr(39), chr(10), text, chr(39), chr(39), ',', chr(10), chr(92), chr(92), 'n <b>&', chr(34), chr(11)) ELSE text END"""


@query("format_round_trips", f"""WITH d AS (SELECT doc_id, {_PLANTED} AS text FROM documents),
t AS (SELECT count(*) AS n, count(*) - count(text) AS nulls, count(*) FILTER (WHERE text = '') AS empty, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS line_ends FROM d)
SELECT f AS format, n, nulls, empty, chars, line_ends, 0 AS problems FROM t, (VALUES ('tsv'), ('literal_tsv'), ('eav'), ('jsonl'), ('typed_jsonl'), ('xml'), ('sql')) v(f)""")
def format_round_trips(spark, sf):
    """The documents, with tabs, line ends, quotes, backslashes, blanks, empty and null texts planted, through every format and back: what was read, and cells that changed."""
    df = read(spark, sf, "documents").select("doc_id", F.expr(_PLANTED.replace("chr(92)", "char(92)")).alias("text"), "n_chars", (c("n_chars") / 7).alias("share"))
    columns = TS.header(["doc_id:long", "text:string", "n_chars:long", "share:float"])
    out = None
    for kind in FM.FORMATS:
        path = place(spark, kind)
        FM.write(df, path, kind, compression="gzip")
        back = FM.read(spark, path, columns, kind)
        problems = FM.round_trip_problems(df, back, "doc_id").agg(F.count("*").alias("problems"))
        text = c("text")
        seen = back.agg(
            F.count("*").alias("n"), F.count_if(text.isNull()).alias("nulls"), F.count_if(text == "").alias("empty"), F.sum(F.char_length(text)).alias("chars"),
            F.sum(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).alias("line_ends"),
        )
        row = seen.join(F.broadcast(problems)).select(F.lit(kind).alias("format"), *seen.columns, "problems")
        out = row if out is None else out.unionByName(row)
    return out


@query("round_trip_compare", "SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 10 <> 0 THEN 's_acctbal' END AS \"column\" FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 4 = 1")
def round_trip_compare(spark, sf):
    s = read(spark, sf, "supplier")
    changed = s.where("s_suppkey % 10 <> 0").withColumn("s_acctbal", F.when(c("s_suppkey") % 4 == 1, c("s_acctbal") + 1).otherwise(c("s_acctbal")))
    return FM.round_trip_problems(s, changed, "s_suppkey")


@query("typed_json_check", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c_nationkey' ELSE 'c_name' END AS \"column\" FROM customer WHERE c_custkey % 3 < 2")
def typed_json_check(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", "c_name", c("c_nationkey").cast("long").alias("c_nationkey"))
    good = TB.typed_json(df)
    k = F.regexp_extract("value", "^\\[\\{\"integer\":\"([0-9]+)\"", 1).cast("long")
    # every third customer's nation is written as a bare number, every third one's name as a number
    broken = good.select(F.when(k % 3 == 0, F.regexp_replace("value", "\\{\"integer\":\"([0-9]+)\"\\}\\]$", "$1]")).when(k % 3 == 1, F.regexp_replace("value", ",\"[^\"]*\",", ",5,")).otherwise(c("value")).alias("value"))
    out = FM.typed_json_problems(broken, df.schema)
    return out.select(F.regexp_extract("value", "^\\[\\{\"integer\":\"([0-9]+)\"", 1).cast("long").alias("c_custkey"), "column")
