"""Scalar functions over text, numbers, arrays and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeloom.functions import collections as C
from typeloom.functions import numbers as N
from typeloom.functions import predicates as P
from typeloom.functions import strings as S
from typeloom.operators import validate as V
from typeloom.sources import tables as T
from typeloom.sources import typespec as TS

from .base import query, read

c = F.col


@query("string_trim_split", r"SELECT doc_id, length(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)))::BIGINT AS n, len(string_split(text, ', '))::BIGINT AS parts FROM documents")
def string_trim_split(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.char_length(S.trim(c("text"))).cast("long").alias("n"), F.size(S.split(c("text"), ", ")).cast("long").alias("parts"))


@query("string_escape", r"SELECT doc_id, md5(replace(replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\', '\\'), chr(9), '\t'), chr(10), '\n')) AS escaped, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS back FROM documents")
def string_escape(spark, sf):
    e = S.escape_text(c("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(e).alias("escaped"), F.md5(S.unescape_text(e)).alias("back"))


@query("string_identifier", r"SELECT p_partkey, '_' || replace(replace(p_name, ' ', '0x20'), '-', '0x2D') AS id FROM part WHERE regexp_full_match(p_name, '[A-Za-z0-9_ -]*')")
def string_identifier(spark, sf):
    return read(spark, sf, "part").where(c("p_name").rlike("^[A-Za-z0-9_ -]*$")).select("p_partkey", S.string_to_identifier(c("p_name")).alias("id"))


@query("number_identifier", "SELECT l_orderkey, l_linenumber, '_I' || l_quantity::BIGINT::VARCHAR AS id, l_quantity AS back FROM lineitem")
def number_identifier(spark, sf):
    i = S.number_to_identifier(c("l_quantity"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", i.alias("id"), S.identifier_to_number(i).alias("back"))


@query("longest_prefix", "SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'STANDARD' WHEN p_type LIKE 'S%' THEN 'S' WHEN p_type LIKE 'PROMO%' THEN 'PROMO' ELSE '' END AS prefix FROM part")
def longest_prefix(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.longest_matching_prefix(F.array(*map(F.lit, ("S", "STANDARD", "PROMO"))), c("p_type")).alias("prefix"))


@query("version_ops", """WITH v AS (SELECT p_partkey, p_size // 10 AS a, p_size % 10 AS b, p_partkey % 5 AS p FROM part) SELECT p_partkey, a::INT AS major, b::INT AS minor, p::INT AS patch,
  (a, b, p) >= (2, 3, 1) AS ge, a = 2 AND b = 3 AND p >= 1 AS tilde, a = 2 AND (a, b, p) >= (2, 3, 1) AS caret FROM v""")
def version_ops(spark, sf):
    text = F.concat_ws(".", F.floor(c("p_size") / 10).cast("string"), (c("p_size") % 10).cast("string"), (c("p_partkey") % 5).cast("string"))
    df = read(spark, sf, "part").select("p_partkey", S.parse_version(text).alias("v"))
    need = S.parse_version(F.lit("2.3.1"))
    return df.select("p_partkey", "v.major", "v.minor", "v.patch", *[S.version_satisfies(op, need, c("v")).alias(n) for op, n in ((">=", "ge"), ("~", "tilde"), ("^", "caret"))])


@query("pattern_match", r"SELECT page_id, regexp_matches(url, '[0-9]+\.html|/$') AS hit FROM pages")
def pattern_match(spark, sf):
    return read(spark, sf, "pages").select("page_id", S.matches_any(c("url"), "%d+%.html|/$").alias("hit"))


@query("unix_eol", r"SELECT doc_id, length(regexp_replace(text, '\r\n?', chr(10), 'g'))::BIGINT AS n FROM documents")
def unix_eol(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.char_length(S.unix_eol(c("text"))).cast("long").alias("n"))


@query("strip_fences", "SELECT event_id, props AS body FROM events")
def strip_fences(spark, sf):
    fenced = F.when(c("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(c("event_id") % 3 == 1, F.concat(F.lit("  ```\n"), "props", F.lit("```\n"))).otherwise(c("props"))
    return read(spark, sf, "events").select("event_id", S.strip_fences(fenced).alias("body"))


@query("edit_distance_osa", "SELECT a.n_name AS a, b.n_name AS b, damerau_levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_nationkey % 2 = b.n_nationkey // 3 % 2")
def edit_distance_osa(spark, sf):
    n = read(spark, sf, "nation").select((c("n_nationkey") % 2).alias("k"), c("n_name").alias("a"))
    m = read(spark, sf, "nation").select((F.floor(c("n_nationkey") / 3) % 2).alias("k"), c("n_name").alias("b"))
    return n.join(m, "k").select("a", "b", S.edit_distance("a", "b").alias("distance"))


@query(
    "closest_name",
    """WITH w AS (SELECT n_name, substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3) AS bad FROM nation),
    d AS (SELECT w.n_name, k.n_name AS x, damerau_levenshtein(bad, k.n_name) AS d, least(3, strlen(bad) // 4 + 1) AS most FROM w, nation k),
    f AS (SELECT n_name, arg_min(x, (d, x)) FILTER (WHERE d <= most) AS found FROM d GROUP BY n_name)
    SELECT n_name, found, coalesce(' (did you mean ' || chr(39) || found || chr(39) || '?)', '') AS hint FROM f""",
)
def closest_name(spark, sf):
    names = [r["n_name"] for r in read(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]
    bad = F.concat(F.substring("n_name", 2, 1), F.substring("n_name", 1, 1), F.substring("n_name", 3, 100))
    return read(spark, sf, "nation").select("n_name", S.closest_match(bad, names).alias("found"), S.did_you_mean(bad, names).alias("hint"))


@query("percent_parse", "SELECT l_orderkey, l_linenumber, round((l_discount * 100)::BIGINT / 100.0, 6) AS p, round(l_linenumber::DOUBLE / 7, 6) AS q FROM lineitem")
def percent_parse(spark, sf):
    text = F.concat(F.round(c("l_discount") * 100).cast("long").cast("string"), F.lit("%"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.percent(text), 6).alias("p"), F.round(N.percent(F.concat(c("l_linenumber").cast("string"), F.lit("/7"))), 6).alias("q"))


@query("int64_ops", "SELECT o_orderkey, o_orderkey + o_custkey AS s, o_orderkey - o_custkey AS d, -o_orderkey AS neg, abs(o_custkey - o_orderkey) AS absolute, sign(o_custkey - o_orderkey)::INT AS sg, CASE WHEN o_orderkey < o_custkey THEN -1 WHEN o_orderkey > o_custkey THEN 1 ELSE 0 END AS cmp, 'none' AS overflow FROM orders")
def int64_ops(spark, sf):
    a, b = c("o_orderkey"), c("o_custkey")
    return read(spark, sf, "orders").select(a, N.add(a, b).alias("s"), N.subtract(a, b).alias("d"), N.negate(a).alias("neg"), N.absolute(b - a).alias("absolute"), N.sign(b - a).alias("sg"), N.compare(a, b).alias("cmp"), F.coalesce(N.add(F.lit(2**63 - 1), F.abs(a) + 1).cast("string"), F.lit("none")).alias("overflow"))


@query("int64_bytes", "SELECT o_orderkey, lpad(to_hex(o_orderkey), 16, '0') AS hexed, o_orderkey AS back FROM orders")
def int64_bytes(spark, sf):
    b = N.to_bytes(c("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", F.hex(b).alias("hexed"), N.from_bytes(b).alias("back"))


@query("floored_mod", "SELECT l_orderkey, l_linenumber, (((l_partkey - 500) % 7) + 7) % 7 AS m, round((l_partkey - 500)::DOUBLE / l_linenumber, 6) AS q FROM lineitem")
def floored_mod(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.floored_mod(c("l_partkey") - 500, F.lit(7)).cast("long").alias("m"), F.round(N.float_divide(c("l_partkey") - 500, c("l_linenumber")), 6).alias("q"))


@query("plain_number", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS q, l_quantity::BIGINT::VARCHAR AS f FROM lineitem")
def plain_number(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.plain_number(c("l_quantity")).alias("q"), N.format_integer(c("l_quantity")).alias("f"))


@query("unsafe_integers", "SELECT o_orderkey, o_orderkey % 3 = 0 AS unsafe FROM orders")
def unsafe_integers(spark, sf):
    text = F.concat(F.lit("{1,"), F.when(c("o_orderkey") % 3 == 0, F.lit("9007199254740993")).otherwise(c("o_orderkey").cast("string")), F.lit("}"))
    return read(spark, sf, "orders").select("o_orderkey", N.unsafe_integer(text).alias("unsafe"))


@query(
    "predicates_strings",
    r"""SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z_][A-Za-z0-9_]*') AS identifier, c_name <> '' AS filled, true AS utf8, NOT regexp_matches(c_name, '[/\\<>:"|?*]') AND NOT regexp_matches(c_name, '[. ]$') AS file_name, length(c_name) = strlen(c_name) AS ascii FROM customer""",
)
def predicates_strings(spark, sf):
    n = c("c_name")
    return read(spark, sf, "customer").select("c_custkey", P.is_identifier(n).alias("identifier"), P.is_non_empty(n).alias("filled"), P.is_utf8(n).alias("utf8"), P.is_file_name(n).alias("file_name"), P.is_ascii(n).alias("ascii"))


@query("predicates_urls", r"SELECT page_id, starts_with(url, 'http') AND url NOT LIKE '% %' AND split_part(split_part(url, '://', 2), '/', 1) LIKE '%.%' AND translate(split_part(url, '://', 2), './?=&_#-:', '') = regexp_replace(split_part(url, '://', 2), '[^A-Za-z0-9]', '', 'g') AS url_ok, split_part(url, '://', 2) NOT LIKE '%//%' AND split_part(url, '://', 2) NOT LIKE '%?%' AS path_ok FROM pages")
def predicates_urls(spark, sf):
    return read(spark, sf, "pages").select("page_id", P.is_http_url(c("url")).alias("url_ok"), P.is_path(F.substring_index("url", "://", -1)).alias("path_ok"))


@query("predicates_numbers", "SELECT c_custkey, c_acctbal <> 0 AS non_zero, c_acctbal > 0 AS positive, c_acctbal = floor(c_acctbal) AS whole, c_nationkey = 0 AS is_default FROM customer")
def predicates_numbers(spark, sf):
    df = read(spark, sf, "customer")
    b = c("c_acctbal")
    return df.select("c_custkey", P.is_non_zero(b).alias("non_zero"), P.is_positive(b).alias("positive"), P.is_integer_value(b).alias("whole"), P.is_default(c("c_nationkey"), df.schema["c_nationkey"].dataType).alias("is_default"))


@query("base64_hex", "SELECT r_regionkey, base64(r_name::BLOB) AS b64, true AS valid, hex(r_name) AS hexed, r_name AS back FROM region")
def base64_hex(spark, sf):
    b = C.base64_encode(F.encode("r_name", "UTF-8"))
    return read(spark, sf, "region").select("r_regionkey", b.alias("b64"), (C.base64_valid(b) & C.hex_valid(F.hex("r_name"))).alias("valid"), F.hex("r_name").alias("hexed"), F.decode(C.base64_decode(b), "UTF-8").alias("back"))


@query("array_ops", "SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN l_linenumber = 2 THEN [1, 3, 9] ELSE [1, 2, 3, 9] END, ',') AS removed, array_to_string([1, CASE WHEN l_linenumber = 2 THEN 7 ELSE 2 END, 3, 9], ',') AS swapped, l_linenumber IN (1, 2, 3, 9) AS sub FROM lineitem")
def array_ops(spark, sf):
    a, n = F.array(*map(F.lit, (1, 2, 3, 9))), F.when(c("l_linenumber") == 2, 2).otherwise(0)
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text(C.remove_first(a, n)).alias("removed"), text(C.replace_last(a, n, F.lit(7))).alias("swapped"), C.is_subset(a, F.array(c("l_linenumber"))).alias("sub"))


@query("array_partition", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS yes, len(list_filter(embedding, lambda x: NOT x > 0))::BIGINT AS no FROM embeddings")
def array_partition(spark, sf):
    p = C.partition(c("embedding"), lambda x: x > 0)
    return read(spark, sf, "embeddings").select("vec_id", F.size(p["yes"]).cast("long").alias("yes"), F.size(p["no"]).cast("long").alias("no"))


@query("map_ops", "SELECT event_id, 'a=' || user_id || ';t=' || event_type AS merged, 't=' || event_type AS dropped, true AS same FROM events")
def map_ops(spark, sf):
    m = F.create_map(F.lit("a"), F.lit("0"), F.lit("t"), c("event_type"))
    new = F.create_map(F.lit("a"), c("user_id").cast("string"))
    text = lambda x: F.array_join(F.transform(C.entries(x), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    merged = C.merge(m, new)
    return read(spark, sf, "events").select("event_id", text(merged).alias("merged"), text(C.drop_keys(m, F.array(F.lit("a")))).alias("dropped"), C.map_equal(merged, merged).alias("same"))


@query("ratio_total", "SELECT l_orderkey, l_linenumber, abs(l_discount + l_tax + round(1 - l_discount - l_tax, 2) + (l_linenumber % 2) * 0.05 - 1) < 1e-4 AS ok FROM lineitem")
def ratio_total(spark, sf):
    rest = F.round(1 - c("l_discount") - c("l_tax"), 2) + (c("l_linenumber") % 2) * 0.05
    m = F.create_map(F.lit("discount"), c("l_discount"), F.lit("tax"), c("l_tax"), F.lit("rest"), rest)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.ratio_total_ok(m).alias("ok"))


@query("sql_literals", "SELECT c_custkey, '''' || replace(c_name, '''', '''''') || '''' AS t, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS b, c_nationkey::VARCHAR AS n, 'NULL' AS nothing FROM customer")
def sql_literals(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", C.sql_literal(c("c_name"), "string").alias("t"), C.sql_literal(c("c_acctbal") > 0, "boolean").alias("b"), C.sql_literal(c("c_nationkey"), "number").alias("n"), C.sql_literal(F.lit(None).cast("string"), "string").alias("nothing"))


@query("json_natural", """SELECT n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS j FROM nation""")
def json_natural(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", T.object_json(c("n_nationkey").alias("key"), c("n_name").alias("name")).alias("j"))


@query("json_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def json_parse(spark, sf):
    """A JSON object in a cell of a record type."""
    raw = read(spark, sf, "events").select(c("event_id").cast("long").alias("_line"), F.array(c("event_id").cast("string"), "props").alias("cells"))
    out = T.typed(raw, TS.header(["id:long", "props:{k:long,rest:string}"]))
    return out.select(c("id").alias("event_id"), "props.k", (c("props.k") % 2 == 0).alias("even"))


@query("boolean_cast", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE 'none' END AS b FROM events")
def boolean_cast(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ("Yes", "NO", "1", "t", "maybe"))), (c("event_id") % 5 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", F.coalesce(V.to_boolean(text).cast("string"), F.lit("none")).alias("b"))


@query("number_cast", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 16.0 WHEN 1 THEN 2.5 WHEN 2 THEN NULL ELSE -3.0 END::DOUBLE AS n FROM events")
def number_cast(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ("0x10", " 2.5 ", "x", "-3"))), (c("event_id") % 4 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", V.to_number(text).alias("n"))
