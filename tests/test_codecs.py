"""Codecs and archives: exact round trips."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeloom.functions import codecs as K
from typeloom.sources import files as S
from typeloom.sources import tables as TB

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=40), lambda v: st.lists(v, max_size=20) | st.dictionaries(st.text(max_size=8), v, max_size=20), max_leaves=30
)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_msgpack_round_trip(v):
    assert K.unpack(K.pack(v)) == v


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.booleans() | st.integers() | st.text(max_size=20), lambda v: st.lists(v, min_size=1, max_size=4) | st.dictionaries(st.text(max_size=6), v, min_size=1, max_size=4), max_leaves=8))
def test_literal_round_trip(v):
    try:
        text = K.literal(v)
    except ValueError:
        return
    assert K.parse_literal(text) == v


def test_known_encodings():
    assert K.pack({"b": 1, "a": [True, None, -1, 300, "x"]}) == bytes.fromhex("82a16195c3c0ffcd012ca178a16201")
    assert K.literal({"b": 1, "a b": ["x", 2]}) == '{["a b"]={"x",2},b=1}'
    assert K.parse_literal('{1, 2; key = "v", ["k2"] = 0x10}') == {"1": 1, "2": 2, "key": "v", "k2": 16}
    for bad in ("{", "{1 2}", "os.exit()", "{a=}", "{[{}]=1}", "1 2"):
        with pytest.raises(ValueError):
            K.parse_literal(bad)
    for bad in (b"", b"\xc1", b"\xa5ab", b"\x01\x02"):
        with pytest.raises(Exception):
            K.unpack(bad)


def test_codec_columns(spark):
    df = spark.createDataFrame([(2**60 + 1, "é", [1, None]), (None, None, None)], "n long, s string, a array<int>")
    out = df.select(K.from_msgpack(K.to_msgpack(F.struct("n", "s", "a"))).alias("m"), K.from_literal(K.to_literal(F.struct("n", "s"))).alias("l"), K.from_msgpack(F.lit(b"\xc1")).alias("bad"), K.from_sql_blob(K.sql_blob(F.encode("s", "UTF-8"))).alias("blob")).collect()
    assert json.loads(out[0]["m"]) == {"n": 2**60 + 1, "s": "é", "a": [1, None]} and json.loads(out[0]["l"]) == {"n": 2**60 + 1, "s": "é"}
    assert out[0]["bad"] is None and bytes(out[0]["blob"]) == "é".encode() and json.loads(out[1]["m"]) == {}


def test_inserts_round_trip(spark):
    df = spark.createDataFrame([(2**62 + 1, "it's, (a) 'test'", 0.5, True, b"\x00\xff", [1, 2]), (2, "", None, False, None, None), (3, None, -1.5, None, b"", [])], "id long, s string, d double, b boolean, x binary, a array<int>")
    back = S.read_inserts(TB.insert_lines(df, "t"), "t", df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("a/x.tsv", "../evil.tsv", "/abs.tsv", "big.bin"):
            z.writestr(name, "1234567890" if name == "big.bin" else "id:int\n1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.zip").write_bytes(buffer.getvalue())
    (tmp_path / "note.txt").write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in S.scan(spark, str(tmp_path), ["*.zip"]).collect()] == ["p.zip"]
    rows = {r["member"]: r["content"] for r in S.zip_members(spark, str(tmp_path / "sub"), max_bytes=9).collect()}
    assert rows == {"a/x.tsv": b"id:int\n1\n", "big.bin": None}


ODD_VALUES = [
    ([1, -2, None], "x", 17.0, True), ([], "", -0.0, False), (None, None, None, None), ([2**62], 'q"\\\n\r\t\x01é', 1e7, None), ([0], ",b=", 1e-5, True), ([5], "}", 0.1 + 0.2, True), ([7], "{", float("nan"), True), ([8], "nil", 123456.789, False), ([9], "x" * 2000, 1e-4, True),
]


def test_literals_by_spark_are_those_by_python(spark):
    df = spark.createDataFrame(ODD_VALUES, "a array<long>, s string, d double, b boolean").select(F.struct("a", "s", "d", "b", F.array("s", "s").alias("a b"), F.array("d").alias("a1"), F.struct("b", "a").alias("z")).alias("v"), "a", "s", "d")
    kinds = df.schema
    for name in ("v", "a"):
        got = df.select(K.to_literal(F.col(name), kinds[name].dataType).alias("x"), K._literal_json(F.to_json(name)).alias("y")).collect()
        assert [r["x"] for r in got] == [r["y"] for r in got]
    assert "Python" not in df.select(K.to_literal(F.col("a"), kinds["a"].dataType))._jdf.queryExecution().executedPlan().toString()


def test_plain_literals_are_read_by_spark(spark):
    plain = ["{1,2}", "{-5}", "{0,17.0,0.25,-0.5}", '{"a","b,c=}"}', "{true,false}", '{flag="R",qty=17.0}', '{a=",b=1",c=2}', '{a="{}"}', "{true=1}", "{_x1=-0.0}"]
    others = ["{}", "{1, 2}", "{nil}", "{a=1,a=2}", '{a="x,a=",b=1}', '{a=1,b=2,a="x"}', "{007}", "{1.50}", "{-0}", "{0.00001}", "{1e3}", "{1,a=2}", "{{1}}", '{"\\n"}', "{'x'}", "{1,}", "{1}\n", "{x}", "{", "1", '{["a"]=1}', "{é=1}", "{12345678901234567890}", "{" + ",".join("1" * 2000) + "}", '{"' + "y" * 5000 + '"}', None]
    rows = spark.createDataFrame([(t,) for t in plain + others], "t string").select("t", K.plain_json(F.col("t")).alias("p"), K.from_literal(F.col("t")).alias("j"), K.literal_json("t").alias("y")).collect()
    assert [r["t"] for r in rows if r["j"] != r["y"]] == []
    assert [r["p"] is not None for r in rows] == [True] * len(plain) + [False] * len(others)


def test_cells_made_on_the_spot_compile(spark):
    """Code of cells that are never null was not compiled, and what made a cell was put in wherever it was read."""
    from typeloom.sources import typespec as TS

    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        raw = spark.range(3).select(F.col("id").alias("_line"), F.array(F.col("id").cast("string"), F.concat(F.lit("{"), F.col("id") + 1, F.lit(",5}")), F.concat(F.lit('{a="'), F.col("id"), F.lit('"}'))).alias("cells"))
        out = TB.typed(raw, TS.header(["key", "ids:{long}", "info:{a:string,b:number}", "none:string|nil"]))
        assert out._jdf.queryExecution().executedPlan().toString().count("concat(") < 9
        assert [(r["ids"], r["info"]["a"], r["info"]["b"]) for r in out.orderBy("_line").collect()] == [([i + 1, 5], str(i), None) for i in range(3)]
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
