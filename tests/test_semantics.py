"""The rules that differ from SQL's, and small fixtures of each operator family."""

import inspect

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import collections as C
from typeloom.functions import numbers as N
from typeloom.functions import predicates as P
from typeloom.functions import strings as S
from typeloom.operators import diff as D
from typeloom.operators import expression as E
from typeloom.operators import graph as G
from typeloom.operators import mutate as M
from typeloom.operators import patch as PT
from typeloom.operators import relational as R
from typeloom.operators import validate as V
from typeloom.sources import tables as TB
from typeloom.sources import typespec as TS


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_join_keeps_the_last_row_and_drops_empty_keys(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("", 3)], "id string, value int")
    b = spark.createDataFrame([("x", "old", 1), ("x", "new", 2), ("", "e", 3), (None, "n", 4), ("z", "un", 5)], "id string, d string, _line int")
    out = {r["id"]: r["d"] for r in R.join_files(a, [b]).collect()}
    assert out == {"x": "new", "y": None, "": None}
    assert [r["id"] for r in R.unmatched(a, b, "id").collect()] == ["z"]
    with pytest.raises(ValueError):
        R.join_files(a, [b.withColumnRenamed("d", "value")])


def test_aggregates_of_nothing(spark):
    none = spark.range(0)
    r = none.agg(R.sum_of("id").alias("s"), R.all_of(F.col("id") > 1).alias("a"), R.any_of(F.col("id") > 1).alias("o"), R.none_of(F.col("id") > 1).alias("n"), R.unique("id").alias("u")).first()
    assert tuple(r) == (0, True, False, True, True)


def test_truth_and_defaults(spark):
    r = one(spark, P.truthy(F.lit(0), T.IntegerType()), P.truthy(F.lit(""), T.StringType()), P.truthy(F.lit(None).cast("int"), T.IntegerType()), P.truthy(F.lit(False), T.BooleanType()), P.is_default(F.lit(""), T.StringType()), P.is_default(F.array().cast("array<int>"), T.ArrayType(T.IntegerType())))
    assert tuple(r) == (True, True, False, False, True, True)


def test_names_and_paths(spark):
    r = one(spark, *[f(F.lit(x)) for f, x in ((P.is_name, "a.b_1"), (P.is_name, "a._.b"), (P.is_identifier, "_"), (P.is_file_name, "con.txt"), (P.is_path, "a/b.txt/"), (P.is_path, "a//b"), (P.is_qualified_path, "p:a/b"), (P.is_percent, "1/0"), (P.is_percent, "12.5%"), (P.is_version, "1.2.3"), (P.is_blank, " \t"), (P.is_http_url, "https://a.b/c?d"))])
    assert tuple(r) == (True, False, False, False, True, False, True, False, True, True, True, True)


@pytest.mark.parametrize("text", ["", "a\\tb", "tab\there", "a\\\\tb\nc", "\\", "\\\\", "x\\ny\n"])
def test_escape_is_reversible(spark, text):
    assert one(spark, S.unescape_text(S.escape_text(F.lit(text))))[0] == text


def test_identifiers(spark):
    r = one(spark, S.string_to_identifier(F.lit("a b-é")), S.number_to_identifier(F.lit(-1.5)), S.identifier_to_number(F.lit("_I_5")), S.identifier_to_number(F.lit("junk")))
    assert tuple(r) == ("_a0x20b0x2D0xC30xA9", "_F_1_5", -5.0, None)


def test_edit_distance_counts_a_swap_once(spark):
    assert S.osa("ab", "ba") == 1 and S.osa("ca", "abc") == 3 and S.osa("", "xy") == 2 and S.osa("é", "e") == 2
    df = spark.createDataFrame([("recieve",), ("zzzzzz",), (None,)], "w string").select(S.closest_match(F.col("w"), ["receive", "relieve"]).alias("m"), S.did_you_mean(F.col("w"), ["receive"]).alias("d"))
    assert [tuple(r) for r in df.collect()] == [("receive", " (did you mean 'receive'?)"), (None, ""), (None, "")]


def test_versions(spark):
    v = lambda x: S.parse_version(F.lit(x))
    r = one(spark, v("1.2"), S.version_satisfies("^", v("0.2.1"), v("0.2.9")), S.version_satisfies("^", v("0.2.1"), v("0.3.0")), S.version_satisfies("^", v("1.2.0"), v("1.9.0")), S.version_satisfies("~", v("1.2.3"), v("1.2.2")), S.version_satisfies("<=", v("1.2.3"), v("1.2.3")))
    assert tuple(r) == (None, True, False, True, False, True)


def test_patterns():
    assert S.pattern_parts("a%|b|c") == ["a%|b", "c"]
    assert S.pattern_to_regex("%d+%.x") == "(?s)[0-9]+\\.x"
    for bad in ("%b()", "%f[a]", "%1"):
        with pytest.raises(ValueError):
            S.pattern_to_regex(bad)
    with pytest.raises(ValueError):
        S.pattern_parts("a||b")


def test_numbers(spark):
    r = one(spark, N.floored_mod(F.lit(-7), F.lit(3)), N.floored_mod(F.lit(7), F.lit(-3)), N.floored_mod(F.lit(1), F.lit(0)), N.float_divide(F.lit(1), F.lit(0)), N.percent(F.lit("150%")), N.percent(F.lit("12")), N.percent_error(F.lit("12")), N.percent_error(F.lit("1/4")), N.plain_number(F.lit(1e20)), N.plain_number(F.lit(1.50)), N.negate(F.lit(-(2**63))), N.add(F.lit(2**63 - 1), F.lit(1)), N.unsafe_integer(F.lit("{9007199254740993}")))
    assert tuple(r) == (2, -2, None, float("inf"), 1.5, 0.12, True, False, "100000000000000000000", "1.5", None, None, True)


def test_collections(spark):
    a = F.array(*map(F.lit, "abab"))
    r = one(spark, C.remove_first(a, F.lit("b")), C.remove_last(a, F.lit("a")), C.replace_last(a, F.lit("z"), F.lit("y")), C.is_subset(a, F.array(F.lit("b"), F.lit("b")), True), C.is_subset(a, F.array(F.lit("c"))), C.insert_nulls(a, F.lit(2), 1), C.insert_nulls(a, F.lit(2), -2))
    assert tuple(r) == (["a", "a", "b"], ["a", "b", "b"], list("abab"), True, False, ["a", None, "b", "a", "b"], ["a", "b"])
    m = F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))
    r = one(spark, C.keys(m), C.values(m), C.map_equal(m, F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1))), C.merge(m, F.create_map(F.lit("a"), F.lit(9)))["a"], C.hex_valid(F.lit("abc")), C.base64_valid(F.lit("YQ=")))
    assert tuple(r) == (["a", "b"], [2, 1], True, 9, False, False)


def test_casts(spark):
    r = one(spark, V.to_boolean(F.lit("YES")), V.to_boolean(F.lit("t")), V.to_number(F.lit(" 0x10 ")), V.to_number(F.lit("1d")), V.to_sized(F.lit("256"), "ubyte"), V.to_sized(F.lit("-1"), "byte"), V.to_enum(F.lit("FIRE"), ["Fire"]), V.to_union(F.lit("no"), ["integer", "boolean"])["type"])
    assert tuple(r) == (True, None, 16.0, None, None, -1, "Fire", "boolean")


def test_violations(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1), ("a", None)], "id string, n int")
    rows = V.row_violations(df, [V.Validator("n", F.col("n") > 0), V.Validator("later", F.lit(False), "warn")], "id").collect()
    assert sorted((r["pk"], r["column"]) for r in rows) == [("a", "later"), ("a", "n"), ("b", "n")]
    assert [r["pk"] for r in V.key_violations(df, "id").collect()] == ["a"]
    assert [r["column"] for r in V.file_violations(df, [V.Validator("all", R.all_of(F.col("n") > 0)), V.Validator("not reached", F.bool_and(F.lit(False)))]).collect()] == ["all"]


def test_long_and_wide(spark):
    rows = [("quay", "depth", "7.5", 10), ("lock", "gates", "2", 20), ("quay", "lamp", "green", 30), ("lock", "lamp", "red", 40), ("quay", "depth", "8.1", 50), ("weir", "gates", "", 60)]
    t = spark.createDataFrame(rows, "entity string, attribute string, value string, _line int")
    names = R.attributes_in_order(t, "_line")
    assert names == ["depth", "gates", "lamp"]
    first, last = ({r["entity"]: tuple(r)[1:] for r in R.pivot(t, "_line", names, how).collect()} for how in ("first", "last"))
    assert first == {"quay": ("7.5", "", "green"), "lock": ("", "2", "red"), "weir": ("", "", "")}
    assert last == first | {"quay": ("8.1", "", "green")}
    assert [tuple(r) for r in R.conflicts(t).collect()] == [("quay", "depth", 2)]


def test_nested_columns(spark):
    df = spark.createDataFrame([(1, "k", "a", "k", "b"), (2, None, "x", "z", "y")], "id int, k1 string, v1 string, k2 string, v2 string")
    assert [r["m"] for r in R.implode_map(df, "m", [("k1", "v1"), ("k2", "v2")]).orderBy("id").collect()] == [{"k": "b"}, {"z": "y"}]
    assert R.implode(df, "r", {"b": "v1", "a": "k1"}).schema["r"].dataType.fieldNames() == ["a", "b"]


def test_row_numbers_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert R.numbered(df, "k").where("k + 1 <> row_index").count() == 0


def test_diffs(spark):
    old = spark.createDataFrame([("ferry 4", 6.25, "open"), ("ferry 9", 7.0, "open"), ("tram 2", 5.5, None)], "line string, fare double, state string")
    new = spark.createDataFrame([("tram 2", 5.5, ""), ("bus 77", 3.0, "open"), ("ferry 4", 6.3, "shut")], "line string, fare double, state string")
    got = {r["key"]: (r["kind"], r["changes"] and [x["column"] for x in r["changes"]]) for r in D.keyed(old, new).collect()}
    assert got == {"ferry 4": ("changed", ["fare", "state"]), "ferry 9": ("removed", None), "bus 77": ("added", None)}
    near = D.keyed(old, new, o=D.Options(epsilon=0.1, only=("line", "fare"))).collect()
    assert sorted((r["key"], r["kind"]) for r in near) == [("bus 77", "added"), ("ferry 9", "removed")]
    p = D.positional(old.withColumn("i", F.col("fare")), new.withColumn("i", F.col("fare")), "i").collect()
    assert len(p) == 3 and {r["kind"] for r in p} == {"changed"}


def test_keyed_diffs_of_null_and_repeated_keys(spark):
    left = spark.createDataFrame([(None, 1)] * 30 + [("b", 2), ("B ", 2), ("c", 1), ("c", 1)], "k string, v int")
    right = spark.createDataFrame([(None, 1, i) for i in range(39)] + [(None, 5, 40), ("b", 2, 50), (" B", 3, 60), ("d", 1, 70), ("d", 2, 80)], "k string, v int, n int")
    got = [(r["key"], r["kind"]) for r in D.keyed(left, right, order="n").collect()]
    assert sorted(got) == sorted([("", "changed")] * 30 + [("B ", "removed")] + [("c", "removed")] * 2 + [(" B", "added")] + [("d", "added")] * 2)
    folded = [(r["key"], r["kind"], r["changes"] and r["changes"][0]["new"]) for r in D.keyed(left, right, o=D.Options(trim=True, ignore_case=True), order="n").where("key = 'b'").collect()]
    assert folded == [("b", "changed", "3")] * 2  # both first rows against the last second one
    assert D.keyed(left.limit(0), right, order="n").count() == len(right.collect())


def test_patches(spark):
    t = spark.createDataFrame([("oak", 140, ["shade", "old"]), ("elm", 60, []), ("fir", 85, None), ("yew", 900, ["rare"])], "tree string, age int, notes array<string>")
    rows = [("oak", None, "=nil", ["struck"]), ("elm", "remove", None, None), ("ash", "add", "12", ["young"]), ("fir", "add", "1", None), ("yew", "replace", "901", None)]
    p = spark.createDataFrame(rows, "tree string, patchOp string, age string, append_notes array<string>")
    out = {r["tree"]: (r["age"], r["notes"]) for r in PT.row_patch(t, p).collect()}
    assert out["oak"] == (None, ["shade", "old", "struck"]) and "elm" not in out and out["ash"][0] == 12 and out["fir"] == (85, None) and out["yew"][0] == 901
    assert ("fir", "error") in [(r["key"], r["level"]) for r in PT.patch_problems(t, p).collect()]
    assert PT.classify(["append_sap", "append_append_sap", "sap"], ["sap", "append_sap"]) == {"append_sap": ("set", "append_sap"), "append_append_sap": ("append", "append_sap"), "sap": ("set", "sap")}
    with pytest.raises(ValueError):
        PT.classify(["prepend_bark"], ["sap"])


def test_bulk_rules_see_earlier_writes(spark):
    t = spark.createDataFrame([(1, 10), (2, 30)], "k int, n int")
    out = PT.bulk_patch(t, [PT.Rule(F.col("n") > 20, {"n": F.col("n") * 2}), PT.Rule(F.col("n") > 50, remove=True), PT.Rule(F.col("n") < 20, {"n": F.lit(None)})])
    assert [tuple(r) for r in out.collect()] == [(1, 10)]


def test_conflicts(spark):
    e = [(1, "cell", "t", "a", "x", "= 1", "m1"), (2, "cell", "t", "a", "x", "= 2", "m2"), (3, "cell", "t", "b", "x", "append 1", "m1"), (4, "cell", "t", "b", "x", "append 2", "m2"), (5, "row", "t", "c", None, "remove", "m1"), (6, "cell", "t", "c", "x", "= 3", "m2"), (7, "schema", "t", None, "y", "newDefault 1", "m1"), (8, "schema", "t", None, "y", "newDefault 2", "m2")]
    df = spark.createDataFrame(e, "seq long, kind string, target string, pk string, col string, action string, source string")
    assert sorted((r["pk"] or "", r["col"] or "", r["kind"]) for r in PT.conflict_report(df).collect()) == [("", "y", "default"), ("a", "x", "cell"), ("c", "", "row")]


def test_graphs(spark):
    n = spark.createDataFrame([("A", ["B", "C"], []), ("B", ["D"], []), ("C", ["D", "X"], []), ("D", [], [])], "name string, children array<string>, parents array<string>")
    out = {r["name"]: r["parents"] for r in G.complete_directed(n, "name", "children", "parents").collect()}
    assert out == {"A": [], "B": ["A"], "C": ["A"], "D": ["B", "C"]}
    assert [tuple(r) for r in G.dangling(n, "name", "children").collect()] == [("C", "X")]
    e = G.edges_of(n, "name", "children").where("dst <> 'X'")
    start = spark.createDataFrame([("A",)], "node string")
    assert sorted((r["node"], r["depth"]) for r in G.bfs(e, start).collect()) == [("A", 0), ("B", 1), ("C", 1), ("D", 2)]
    assert G.shortest_path(e, "A", "D").first()["path"] == ["A", "B", "D"] and G.shortest_path(e, "D", "A").isEmpty()
    assert [r["node"] for r in G.dfs(e, start).orderBy("order").collect()] == ["A", "B", "D", "C"]
    assert G.is_acyclic(e.select("src", "dst"))
    loop = e.select("src", "dst").unionByName(spark.createDataFrame([("D", "A")], "src string, dst string"))
    assert G.find_cycle(loop).first()["path"][0] == "A" and not G.is_acyclic(loop)
    assert {r["node"]: r["layer"] for r in G.layers(n.select(F.col("name").alias("node")), e).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2}


def test_ways_have_no_cap(spark, monkeypatch):
    chain = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert inspect.signature(G.shortest_path).parameters["max_depth"].default is None  # a thousand rounds would take minutes
    assert G.shortest_path(chain, 0, 12, max_depth=11).isEmpty() and G.shortest_path(chain, 0, 12, max_depth=12).first()["path"] == list(range(13))
    monkeypatch.setattr(G, "range", lambda n: range(min(n, 5)), raising=False)  # counted rounds end early
    assert G.shortest_path(chain, 0, 12).first()["path"] == list(range(13))


def test_cycle_behind_any_successor(spark):
    # 0 has 1100 successors; all but the last lead only to the cycle 5000, 5001
    hub = spark.range(1, 1101).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    on = spark.range(1, 1101).select(F.col("id").alias("src"), F.when(F.col("id") == 1100, 0).otherwise(5000).cast("long").alias("dst"))
    far = spark.createDataFrame([(5000, 5001), (5001, 5000)], "src long, dst long")
    assert G.find_cycle(hub.unionByName(on).unionByName(far)).first()["path"] == [0, 1100, 0]
    assert G.find_cycle(spark.createDataFrame([(2, 2), (1, 2)], "src long, dst long")).first()["path"] == [2, 2]
    assert G.find_cycle(hub).isEmpty()


def test_expressions(spark):
    df = spark.createDataFrame([(3, 4.0, "x")], "a int, b double, s string")
    out = E.derive(df, {"d": "=self.c + 1", "c": "=self.a * self['b']", "t": "=self.s .. '!'", "k": "=self.a % 2 == 1 and not (self.b > 5)"}).first()
    assert (out["c"], out["d"], out["t"], out["k"]) == (12.0, 13.0, "x!", True)
    for bad in ("=__import__('os')", "=self.a.b.c", "=[1 for x in self]"):
        with pytest.raises((ValueError, SyntaxError)):
            E.compile_expression(bad)
    with pytest.raises(ValueError):
        E.in_order({"a": "=self.b", "b": "=self.a"})


def test_mutations(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    out = M.run_script({"t": t}, [("setCell", "t", "a", "v", 9), ("#", "t"), ("copyRow", "t", "b", "c"), ("renameColumn", "t", "v", "w"), ("copyFile", "t", "u"), ("removeRow", "u", "a")])
    assert sorted(tuple(r) for r in out["t"].collect()) == [("a", 9), ("b", 2), ("c", 2)] and out["u"].count() == 2
    with pytest.raises(ValueError):
        M.run_script({"t": t}, [("setCell", "t", "a", "nope", 9)])


def test_type_language():
    t = TS.Types({"Item": "{name:string,price:uint|nil}", "Cheap": "{extends:Item,price:ubyte}", "Kind": "{enum:a|b}"}, {"numeric": {"integer", "float"}})
    assert t.spark("{string}").simpleString() == "array<string>" and t.spark("{string:int}").simpleString() == "map<string,int>"
    assert t.spark("{int,string}").simpleString() == "struct<_1:int,_2:string>" and t.spark("Cheap").simpleString() == "struct<name:string,price:smallint>"
    assert t.nullable("int|nil") and not t.nullable("int")
    assert t.narrower("ubyte", "integer") and not t.narrower("integer", "ubyte") and t.narrower("ushort", "numeric") and t.narrower("Cheap", "Item") and t.narrower("{enum:a}", "Kind")
    assert str(TS.parse("{b:int,a:{string}|nil}")) == "{a:{string}|nil,b:int}"
    for bad in ("{", "a b|", "{a:int,b}", "{a:int,a:int}"):
        with pytest.raises(ValueError):
            TS.parse(bad)
    c = TS.header_column("cooldown!:{a:int,b:int}|nil:=self.x:1")
    assert c.published and c.default == "=self.x:1"
    assert TS.exploded(["a.b", "a.c", "p._1", "p._2", "m[1]", "m[1]=", "x[1]", "x[2]"]).keys() == {"a", "p", "m", "x"}
    with pytest.raises(ValueError):
        TS.exploded(["x[1]", "x[3]"])


def test_tsv(spark, tmp_path):
    f = tmp_path / "Item.tsv"
    f.write_text("# a comment\nname:name\tprice:uint|nil\ttier:integer:1\ttotal:float:=self.tier * 2\tnote:text\nsword\t100\t\t\ta\\tb\n\nshield\tx\t3\t1.5\t\n")
    df, columns = TB.read_tsv(spark, str(f))
    assert [tuple(r)[1:] for r in df.orderBy("_line").collect()] == [("sword", 100, 1, 2.0, "a\tb"), ("shield", None, 3, 1.5, None)]
    assert TB.schema_line(columns).startswith("name:name\tprice:uint|nil\ttier:integer:1")
    raw = TB.raw_rows(TB.lines(spark, str(f)))
    assert raw.count() == 3 and not TB.is_triples(raw)
    out = tmp_path / "out"
    TB.write_tsv(df.orderBy("_line").coalesce(1), str(out), "gzip")
    assert [r["value"] for r in spark.read.text(str(out)).collect()][0] == "sword\t100\t1\t2.0\ta\\tb"


def test_other_formats(spark, tmp_path):
    columns = TS.header(["a:integer", "b:string"])
    for layout, text in (("objects", '[{"a":1,"b":"x"},{"b":"y"}]'), ("rows", '[[1,"x"],[null,"y"]]'), ("columns", '[[1],["x","y"]]')):
        f = tmp_path / f"{layout}.json"
        f.write_text(text)
        assert [(r["a"], r["b"]) for r in TB.parse_json(spark, str(f), layout, columns).orderBy("_line").collect()] == [(1, "x"), (None, "y")], layout
    t = tmp_path / "t.eav"
    t.write_text("e1\tzeta\t1\ne1\talpha\t2\ne2\tzeta\t3\n")
    wide = TB.read_triples(spark, str(t))
    assert wide.columns == ["entity", "zeta", "alpha"] and sorted(tuple(r) for r in wide.collect()) == [("e1", "1", "2"), ("e2", "3", "")]
    x = tmp_path / "w.tsv"
    x.write_text("name:string\ta\tb\nprice:uint\t1\t2\n")
    assert sorted((r["name"], r["price"]) for r in TB.read_transposed(spark, str(x)).collect()) == [("a", 1), ("b", 2)]
    df = spark.createDataFrame([(1, "it's", 0.5, None)], "id int, s string, d double, n string")
    assert TB.insert_lines(df, "t").first()[0] == "INSERT INTO \"t\" VALUES (1, 'it''s', 0.5, NULL);"
    assert TB.create_table("t", df.schema) == 'CREATE TABLE "t" ("id" BIGINT PRIMARY KEY, "s" TEXT, "d" REAL, "n" TEXT);'
    TB.write_xml(df, str(tmp_path / "xml"))
    assert TB.read_xml(spark, str(tmp_path / "xml"), df.schema).first()["s"] == "it's"


def test_packages(spark):
    assert TB.topological({"b": {"a"}, "a": set(), "c": {"a", "missing"}}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        TB.topological({"a": {"b"}, "b": {"a"}})
    f = spark.createDataFrame([("x", "de", None), ("y", "", ["p"]), ("z", None, ["q"])], "path string, variant string, only_if_packages array<string>")
    assert sorted(r["path"] for r in TB.active(f, {"de"}, {"p"}).collect()) == ["x", "y"]


def test_streams(spark, tmp_path):
    from typeloom.streaming import patched, violations

    src = tmp_path / "in"
    spark.createDataFrame([(1, 5), (2, -5)], "id int, n int").write.parquet(str(src))
    stream = spark.readStream.schema("id int, n int").parquet(str(src))
    out = violations(patched(stream, [PT.Rule(F.col("n") > 0, {"n": F.col("n") + 1})]), [V.Validator("n", F.col("n") > 0)], "id")
    q = out.writeStream.format("memory").queryName("bad_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["pk"] for r in spark.sql("select * from bad_rows").collect()] == ["2"]


def test_line_ends_do_not_pass_predicates(spark):
    from typeloom.functions import predicates as P
    from typeloom.functions import strings as S

    def truth(f, *texts):
        return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]

    assert truth(P.is_identifier, "abc", "abc\n", "_", None) == [True, False, False, False]
    assert truth(P.is_version, "1.2.3", "1.2.3\n") == [True, False] and truth(P.is_name, "a.b", "a.b\n", "a._") == [True, False, False]
    assert truth(P.is_percent, "5%", "5%\n", "-1.5%", "1/2", "1/-2", "1/00", "-3/4") == [True, False, True, True, False, False, True]
    assert truth(P.is_http_url, "http://a.b", "http://localhost", "https://a_b.example.org:80/x?y=1#z", "http://a.b/(x)", "http://a.b:", "ftp://a.b") == [True, False, True, False, False, False]
    assert truth(P.is_pattern, "[a-z]+", "[a", "%d(", "x%", "%%", "(a)", ")a(") == [True, False, False, False, True, True, False]
    seq = lambda c: P.is_full_sequence(F.from_json(c, "array<int>"))
    assert truth(seq, "[]", "[1,2,3]", "[2,1]", "[1,3]", "[0,1]", "[1,1]") == [True, True, True, False, False, False]
    mixed = lambda c: P.is_mixed(F.from_json(c, "array<string>"))
    assert truth(mixed, '["1","2"]', '["1","a"]', '["a"]', '["2","a"]') == [False, True, False, False]
    assert truth(S.unescape_text, "a\\tb", "a\\\\tb", "a\\\nb", "a\r\nb", "x\\q", "plain") == ["a\tb", "a\\tb", "a\nb", "a\nb", "xq", "plain"]
    assert truth(lambda c: S.matches_any(c, "^[a%D]$"), "a", "7", "z") == [True, False, True]
    assert truth(lambda c: S.matches_any(c, "^[^a%D]$"), "a", "7", "z") == [False, True, False]


def test_operands_of_and_or_not(spark):
    from typeloom.operators.expression import derive

    df = spark.createDataFrame([(1, 3, "x", True, [1, 2]), (2, None, None, False, []), (3, 0, "", None, None)], "k int, v int, t string, b boolean, a array<int>")
    out = derive(df, {"o": "=self.v or 5", "n": "=not self.v", "w": "=self.v and 'some' or 'none'", "both": "=self.b and self.v > 1", "len": "=#self.a", "size": "=#self.t + 1"}).orderBy("k").collect()
    assert [tuple(r)[5:] for r in out] == [(3, False, "some", True, 2, 2), (5, True, "none", False, 0, None), (0, False, "some", False, None, 1)]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("=self.b or 'x'", ["true", "x", "x"]), ("=self.n == 0 and 'zero' or self.n", ["zero", "7", "-5"]), ("=self.v or self.b", ["4.0", "false", "-2.5"]), ("=self.n // 2", ["0", "3", "-3"]),
        ("=string.upper(self.t)", ["X", None, "12"]), ("=self.t:upper() .. 1 + 2", ["X3", None, "123"]), ("=not self.b == true", ["false", "true", "true"]), ("=#self.a + #self.t", ["3", None, "2"]),
        ("=(self.b or self.t) == true", ["true", "false", "false"]), ("=(self.b or self.t) .. '!'", [None, None, "12!"]), ("=(self.b or self.n) + 1", [None, "8.0", "-4.0"]), ("=self.t + 1", [None, None, "13.0"]),
        ("=self.t < self.n", [None] * 3), ("=self[1] * 2", ["0", "14", "-10"]), ("=self.n // 0", [None] * 3), ("=self.n / 0", ["NaN", "Infinity", "-Infinity"]), ("=type(self.b or self.t)", ["boolean", "nil", "string"]),
        ("=(self.b and self.n) == false", ["false", "true", "false"]), ("=self.v and self.b and 'w' or nil", ["w", None, None]), ("=-self.n ^ 2", ["-0.0", "-49.0", "-25.0"]), ("=self.n == 0 == true", ["true", "false", "false"]),
        ("=nil == self.v", ["false", "true", "false"]), ("=self.t == self.n", ["false"] * 3), ("=math.max(self.n, self.v or 0)", ["4.0", "7.0", "-2.5"]), ("=self.n + 9223372036854775807", ["9223372036854775807", None, "9223372036854775802"]),
        ("=tostring(self.v or nil)", ["4.0", "nil", "-2.5"]), ("=(self.v or self.t) < 0", ["false", None, "true"]), ("='a.. b' .. \"not\"", ["a.. bnot"] * 3), ("=P.q * self.n", ["0", "21", "-15"]),
    ],
)
def test_operands_of_several_kinds(spark, expression, expected):
    df = spark.createDataFrame([(0, 4.0, "x", True, [1, 2]), (7, None, None, False, None), (-5, -2.5, "12", None, [])], "n int, v double, t string, b boolean, a array<int>").coalesce(1)
    out = E.derive(df, {"o": expression}, {"P.q": F.lit(3)})
    assert [r[0] for r in out.select(F.col("o").cast("string")).collect()] == expected


def test_values_that_do_not_fit_a_column(spark):
    df = spark.createDataFrame([(1, None, None), (0, None, None), (2, 5, "kept")], "n int, whole int, word string").coalesce(1)
    out = E.derive(df, {"whole": "=self.n == 1 and 'text' or self.n / 4", "word": "=self.n == 1 or self.n"}).collect()
    assert [tuple(r) for r in out] == [(1, None, "true"), (0, 0, "0"), (2, 5, "kept")]
    for bad in ("=self.a & 1", "=self.a = 1", "={a=1}", "=self.x:rep(9)", "=self[9]", "=~self.a", "=+self.a.b"):
        with pytest.raises((ValueError, SyntaxError)):
            E.compile_expression(bad, None, {"a": T.IntegerType(), "x": T.StringType()})


def test_custom_types(spark):
    from typeloom.sources.customtypes import CustomTypes, Declared

    t = CustomTypes([Declared("percentile", "ubyte", most=100), Declared("upper", "percentile", least=50), Declared("code", "ascii", min_bytes=2, max_bytes=3, pattern="^Z|%d$"), Declared("shape", "string", shape="{long}"), Declared("sizes", "number", tagged=("percentile", "float"))])
    df = spark.createDataFrame([(0, "50", "Z1", "{3,4}"), (1, "49", "abc", "{3,x}"), (2, "101", "Zxyz", "nothing"), (3, "x", "a7", "[5]")], "i int, u string, c string, s string").orderBy("i")
    rows = df.select(t.problem(F.col("u"), "upper"), t.problem(F.col("c"), "code"), t.value(F.col("s"), "shape")).collect()
    assert [r[0] for r in rows] == ["", "below 50", "above 100", "no upper"]
    assert [r[1] for r in rows] == ["", "does not match ^Z|%d$", "over 3 bytes", ""] and [r[2] for r in rows] == ["[3,4]", None, None, "[5]"]
    assert t.tag_members("sizes") == ["float", "percentile"] and t.in_tag("upper", "sizes") and not t.in_tag("code", "sizes") and t.narrower("upper", "percentile")
    for bad in (Declared("x", "int64", least=1), Declared("x", "string", least=1), Declared("x", "ubyte", least=3, most=2), Declared("x", "string", min_bytes=1, labels=("a",)), Declared("x", "{enum:a|b}", labels=("c",)), Declared("x", "nowhere"), Declared("x", "number", tagged=("string",)), Declared("code", "string")):
        with pytest.raises(ValueError):
            t.add(bad)
    listed = spark.createDataFrame([("low", "ubyte", 3.0, 1), ("lower", "low", 2.0, 2)], "name string, parent string, most double, _line int")
    assert CustomTypes.from_rows(listed).lineage("lower")[:3] == ["lower", "low", "ubyte"]


def test_nested_cells(spark):
    from typeloom.sources import tables as TB
    from typeloom.sources import typespec as TS

    columns = TS.header(["k", "list:{long}", "pair:{string,number}", "map:{string:long}", "rec:{a:long,b:string}"])
    rows = [(1, ["x", "{1,2}", '{"p",2.5}', "{u=1,v=2}", "{a=7,b='q'}"]), (2, ["y", "[3]", '["p",1]', '{"u":3}', '{"a":1}']), (3, ["z", "4,5", "'r',2", "u=9", "b='s'"]), (4, ["w", "", "{oops", "", "{"])]
    out = TB.typed(spark.createDataFrame(rows, "_line long, cells array<string>"), columns).orderBy("_line").collect()
    assert [r["list"] for r in out] == [[1, 2], [3], [4, 5], None]
    assert [r["pair"] and tuple(r["pair"]) for r in out] == [("p", 2.5), ("p", 1.0), ("r", 2.0), None]
    assert [r["map"] for r in out] == [{"u": 1, "v": 2}, {"u": 3}, {"u": 9}, None]
    assert [r["rec"] and tuple(r["rec"]) for r in out] == [(7, "q"), (1, None), (None, "s"), None]


def test_transposed_tables(spark, tmp_path):
    from typeloom.sources import tables as TB

    lines = ["id:long\t1\t2\t3", "# note", "name\ta\tb", "size:long:9\t\t5\t6"]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    out = TB.read_transposed(spark, str(tmp_path / "t.tsv")).orderBy("_line").collect()
    assert [(r["id"], r["name"], r["size"]) for r in out] == [(1, "a", 9), (2, "b", 5), (3, "", 6)]


def test_catalog_checks(spark):
    from typeloom.sources import packages as PK

    files = spark.createDataFrame([("b/z",), ("a",), ("b/c/d",), ("b/a",)], "path string")
    assert [r["path"] for r in PK.breadth_first(files).orderBy("place").collect()] == ["a", "b/a", "b/z", "b/c/d"]
    gates = spark.createDataFrame([("winter",), ("wintr",), (None,), ("winter",)], "gate string")
    assert [tuple(r) for r in PK.unknown_names(gates, "gate", ["winter", "summer"]).collect()] == [("wintr", "unknown (did you mean 'winter'?)")]
    wanted = spark.createDataFrame([("D",), ("c/d",), ("nothing",)], "name string")
    assert {r["name"]: r["path"] for r in PK.resolve_paths(wanted, files).collect()} == {"D": "b/c/d", "c/d": "b/c/d", "nothing": None}
    owned = PK.owners(files, spark.createDataFrame([("outer", "B/"), ("inner", "b/c")], "id string, path string"))
    assert {r["path"]: r["package"] for r in owned.collect()} == {"a": None, "b/z": "outer", "b/a": "outer", "b/c/d": "inner"}


def test_values_in_order(spark):
    from pyspark.sql import types as T

    from typeloom.operators import ordering as O

    kind = T.StructType([T.StructField("a", T.StringType()), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    rows = [(1, ("b", {"x": 1})), (2, ("B", {"x": 1, "a": 9})), (3, (None, {"z": 1})), (4, None), (5, ("b", None)), (6, ("a", {"q": 5}))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.LongType()), T.StructField("v", kind)]))
    assert [r["i"] for r in df.orderBy(*O.sort_keys(df, ["v"]), "i").collect()] == [4, 3, 6, 5, 2, 1]
    same = df.select(O.same(F.col("v"), F.col("v"), kind), O.compare(F.col("v"), F.lit(None).cast(kind), kind)).collect()
    assert all(r[0] for r in same) and [r[1] for r in same] == [1, 1, 1, 0, 1, 1]


def test_patch_targets():
    from typeloom.operators.plan import resolve

    tables, packages = ["x/Item.tsv", "y/item.tsv", "y/Place.tsv"], {"x/Item.tsv": "X", "y/item.tsv": "Y", "y/Place.tsv": "Y"}
    assert resolve("place.tsv", tables) == ("y/Place.tsv", "") and resolve("none", tables)[0] is None
    assert resolve("item.tsv", tables) == ("x/Item.tsv", "one of 2 tables of that name") and resolve("y:ITEM.tsv", tables, packages) == ("y/item.tsv", "")
    assert resolve("z:item.tsv", tables, packages)[0] is None and resolve("y:item.tsv", tables)[0] is None


def test_rows_beside_are_found_across_ranges(spark):
    """Next and last row by order, nulls among the values and gaps between ranges included; no task gathers all rows."""
    rows = [(3 * i, None if i % 7 == 0 else f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(5)
    for before, step in ((False, 1), (True, -1)):
        out = R.beside(df, "k", "v", "other", before)
        want = {k: rows[i + step][1] if 0 <= i + step < len(rows) else None for i, (k, _) in enumerate(rows)}
        assert {r["k"]: r["other"] for r in out.collect()} == want and out.columns == ["k", "v", "other"]
    assert R.beside(df.limit(0), "k", "v", "other").count() == 0
    assert R.beside(df.limit(1), "k", "v", "other").first()["other"] is None


@pytest.mark.parametrize("name", ["compare_tuples", "join_targets"])
def test_no_window_gathers_a_table(spark, sf, name):
    from typeloom.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_part" in x for x in windows)
