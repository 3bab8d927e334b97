"""Formats: texts come back to the character from all of them, statements that span lines and splits, malformed JSON."""

import random

import pytest
from pyspark.sql import functions as F

from typeloom.sources import files as FL
from typeloom.sources import formats as FM
from typeloom.sources import jsondocs as JD
from typeloom.sources import packages as PK
from typeloom.sources import tables as TB
from typeloom.sources import typespec as TS

ODD = [
    None, "", " ", "\\N", "\\", "\\\\N", "\\t", "a\tb", "a\\\tb", "line\nline", "line\r\nline\r", "\n", "'", "''", "it''s', 'x", "'); -- ", "X'41'", "NULL", "  both ends  ", "#no comment", "-- none", "<a>&amp;</a>",
    '"', '{"a":1}', "[1]", "null", "0x", "\x0b\x00\x1f", "é日本\U0001f600", "\\u000b", "a,b)", "'\n'\n''", "a b\u0085c",
]


@pytest.mark.parametrize("kind", FM.FORMATS)
def test_odd_texts_come_back(spark, tmp_path, kind):
    rng = random.Random(4)
    rows = [(i, t, ODD[-i], i * 10**15 if i % 3 else None, i / 7 if i % 4 else None, bool(i % 2) if i % 5 else None) for i, t in enumerate(ODD)]
    rows += [(100 + i, "".join(rng.choice("ab '\\\t\n\r,)-NX") for _ in range(rng.randrange(40))), "".join(rng.choice("'\n-") for _ in range(5)), i, 0.1, True) for i in range(200)]
    rows += [(1000, "'\n" * 20_000, None, None, None, None), (1001, None, None, None, None, None), (1002, "", "", None, None, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string, n long, d double, ok boolean").repartition(3)
    columns = TS.header(["id:long", "a:string", "b:string|nil", "n:long|nil", "d:float|nil", "ok:boolean|nil"])
    path = str(tmp_path / kind)
    FM.write(df, path, kind)
    back = FM.read(spark, path, columns, kind)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert FM.round_trip_problems(df, back, "id").isEmpty()


@pytest.mark.parametrize("kind", FM.FORMATS)
def test_compressed_files_come_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(i, t, "'\n" * i) for i, t in enumerate(ODD)], "id long, a string, b string").repartition(3)
    path = str(tmp_path / kind)
    FM.write(df, path, kind, compression="gzip")
    assert all(p.name.endswith(".gz") for p in (tmp_path / kind).glob("part-*"))
    back = FM.read(spark, path, TS.header(["id:long", "a:string", "b:string"]), kind)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_long_texts_are_compared_but_not_shuffled(spark):
    long = "x" * 100_000
    before = [(1, long, b"a" * 65, 1.0), (2, long, b"a" * 64, 1.0), (3, "é" * 32, b"", 1.0), (4, "", None, 1.0), (5, None, None, None), (6, "y" * 65, b"b", 1.0), (7, "same" * 50, b"c" * 99, 0.5), (8, "gone", None, 1.0)]
    after = [(1, long[:-1] + "y", b"a" * 65, 1.0), (2, long, b"a" * 63 + b"b", 1.0), (3, "é" * 32 + "x", b"", 1.0), (4, None, b"", 1.0), (5, "", None, None), (6, "y" * 64, b"b", 2.0), (7, "same" * 50, b"c" * 99, 0.5), (9, "new", None, 1.0)]
    schema = "id long, t string, b binary, d double"
    out = FM.round_trip_problems(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), "id")
    assert sorted((r["key"], r["column"] or "") for r in out.collect()) == [("1", "t"), ("2", "b"), ("3", "t"), ("4", "b"), ("4", "t"), ("5", "t"), ("6", "d"), ("6", "t"), ("8", ""), ("9", "")]
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    for i in (0, 1):
        output = node.children().apply(i).output()
        assert {"string", "binary"}.isdisjoint(output.apply(k).dataType().simpleString() for k in range(output.size()))


def test_one_column_of_texts(spark, tmp_path):
    df = spark.createDataFrame([("",), (None,), ("x",), ("",)], "a string")
    for kind in ("tsv", "jsonl", "typed_jsonl", "sql"):
        FM.write(df, str(tmp_path / kind), kind)
        assert sorted(str(r[0]) for r in FM.read(spark, str(tmp_path / kind), TS.header(["a:string"]), kind).collect()) == ["", "", "None", "x"], kind


def scanned(text):
    """Statements by a walk over the characters: a line end outside of quotes ends one; comments hold no quotes."""
    out, held, quoted, comment = [], "", False, False
    for i, ch in enumerate(text):
        if ch == "\n" and not quoted:
            out.append(held)
            held, comment = "", False
            continue
        held += ch
        if not quoted and text[i : i + 2] == "--":
            comment = True
        if ch == "'" and not comment:
            quoted = not quoted
    return out + [held] * bool(held)


@pytest.mark.parametrize("size", [64, 256, 1 << 20])
def test_statements_over_splits(spark, tmp_path, size):
    rng = random.Random(size)
    files = []
    for n in range(3):
        parts = []
        for i in range(60):
            quoted = "'" + "".join(rng.choice(["a", "''", "\n", "\n\n", "-- ", ", ", "long line of text "]) for _ in range(rng.randrange(12))) + "'"
            parts.append(rng.choice([f"INSERT INTO \"t\" VALUES ({n}, {i}, {quoted});", "-- it's a comment", f"-- don't {quoted[1:-1].replace(chr(10), ' ')}", "", f"SELECT {quoted}, {quoted}; -- isn't it"]))
        files.append("\n".join(parts) + "\n")
        (tmp_path / f"{n}.sql").write_text(files[-1])
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = FL.statements(spark, str(tmp_path))
        assert size > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted(r["value"] for r in got.collect()) == sorted(s for text in files for s in scanned(text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_binary_and_nested_literals(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\x00'\n"), ["a'b", "c\nd"], True), (2, None, None, None)], "id int, raw binary, names array<string>, ok boolean")
    TB.insert_lines(df, "t").write.text(str(tmp_path / "t"))
    assert sorted(map(tuple, FL.read_inserts(FL.statements(spark, str(tmp_path / "t")), "t", df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_json_that_is_none(spark, tmp_path):
    columns = TS.header(["a:integer", "b:string"])
    for layout, text, problem in (("rows", '[[1,"x",3]]', "more values than the header"), ("rows", '[[1,"x"],[2', "cut off"), ("rows", '[[1,"x"],[2 3]]', "MALFORMED"), ("columns", "[[1]]", "not as many columns"), ("objects", '[{"a":1', "cut off"), ("objects", '[{"a":1}] x', "behind its end"), ("objects", '{"a":1}', "behind its end|no array")):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception, match=problem):
            TB.parse_json(spark, str(tmp_path / "x.json"), layout, columns).collect()


def test_triples_that_are_none(spark, tmp_path):
    (tmp_path / "x.eav").write_text("e\ta\t1\ne\tb\n")
    with pytest.raises(ValueError, match="no triple"):
        FM.read(spark, str(tmp_path / "x.eav"), TS.header(["e:string", "a:string", "b:string"]))


def test_ties_have_one_answer(spark):
    files, packages = spark.createDataFrame([("a/b/c.tsv",)], "path string"), spark.createDataFrame([("q", "a/b"), ("p", "a/b/"), ("r", "a")], "id string, path string")
    assert PK.owners(files, packages).first()["package"] == "q"
    asked, results = spark.createDataFrame([("x", 1)], "k string, _pos int"), spark.createDataFrame([("u", 1, 9), ("v", 1, 4)], "k string, _pos int, score int")
    assert PK.match_results(asked, results, "k").first()["score"] == 4


def test_empty_plan(spark):
    from typeloom.operators.plan import Patch, apply_plan

    assert apply_plan({}, []) == ({}, None)
    out, problems = apply_plan({}, [Patch(name="p", target="t", package="a")])
    assert out == {} and problems.first()["level"] == "error"


@pytest.mark.parametrize("size", [32, 1 << 20])
@pytest.mark.parametrize("layout", ["objects", "rows", "columns"])
def test_json_documents_over_splits(spark, tmp_path, layout, size):
    """Records of documents of any spacing, with brackets, quotes and backslashes in strings, against Python's parser; and the writer's documents, put together, are JSON."""
    import json

    rng = random.Random(size)
    text = lambda: "".join(rng.choice(["a", "]", "}", "[", "{", '"', "\\", "\\\"", ",", "é", " "]) for _ in range(rng.randrange(8)))
    table = [{"a": i, "b": text(), "c": [text(), {"d": text()}]} for i in range(80)]
    whole = {"objects": table, "rows": [list(r.values()) for r in table], "columns": [[r[k] for r in table] for k in "abc"]}[layout]
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=False) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = JD.records(spark, str(tmp_path / "one.json"), layout).orderBy("_line").collect()
        assert [json.loads(r["value"]) for r in got] == whole and [r["_line"] for r in got] == list(range(1, len(whole) + 1)) and not any(r["problem"] for r in got)
        df = spark.createDataFrame([(i, None if i % 7 == 0 else text(), i / 3) for i in range(50)], "a long, b string, c double").repartition(4)
        path = tmp_path / "made"
        JD.write_json(df, str(path), layout, "a")
        made = json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))
        rows = [tuple(r) for r in df.orderBy("a").collect()]
        assert made == {"objects": [{k: v for k, v in zip("abc", r, strict=True) if v is not None} for r in rows], "rows": [list(r) for r in rows], "columns": [list(x) for x in zip(*rows, strict=True)]}[layout]
        back = TB.parse_json(spark, str(path), layout, TS.header(["a:long", "b:text|nil", "c:float"])).orderBy("_line")
        assert [(r["a"], r["c"]) for r in back.collect()] == [(a, c) for a, _, c in rows] and [r["_line"] for r in back.collect()] == list(range(1, 51))
        JD.write_json(df.limit(0), str(tmp_path / "none"), layout, "a")
        assert TB.parse_json(spark, str(tmp_path / "none"), layout, TS.header(["a:long", "b:text|nil", "c:float"])).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_columns_are_read_by_cells(spark, tmp_path):
    """No column is read or put together as one text, over splits and blocks: a column is far longer than the longest piece that may be read. Columns may be shorter than others, or empty."""
    import json

    rng = random.Random(5)
    odd = lambda: "".join(rng.choice(["a", "]", "}", "[", "{", '"', "\\", ",", "é", " "]) for _ in range(rng.randrange(8)))
    whole = [list(range(5000)), [odd() for _ in range(3000)], [], [{"a": [i, odd()]} if i % 3 else None for i in range(130)]]
    (tmp_path / "x.json").write_text(json.dumps(whole, ensure_ascii=False))
    longest = "mapreduce.input.linerecordreader.line.maxlength"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    spark.conf.set("spark.sql.files.maxPartitionBytes", 10_000)
    hadoop.set(longest, "1000")
    try:
        back = TB.parse_json(spark, str(tmp_path / "x.json"), "columns", TS.header(["a:long", "b:text|nil", "c:long|nil", "d:raw|nil"]))
        assert sorted((r["_line"], r["a"]) for r in back.select("_line", "a").collect()) == [(i + 1, i) for i in range(5000)]
        cells = {r["_line"]: r["cells"] for r in JD.column_rows(spark, str(tmp_path / "x.json"), 4).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        hadoop.unset(longest)
    assert sorted(cells) == list(range(1, 5001))
    for i in range(5000):
        a, b, c, d = cells[i + 1]
        assert (a, b, c) == (str(i), whole[1][i] if i < 3000 else None, None), i
        assert (json.loads(d) if d else d) == (whole[3][i] if i < 130 else None), i


def test_columns_that_are_none(spark, tmp_path):
    columns = TS.header(["a:integer|nil", "b:integer|nil"])
    for text, problem in (("[[1,2],[3]", "cut off"), ("[[1],[2]] [[3]]", "behind its end"), ("[[1],5,[2]]", "no array of arrays"), ('[[1],{"a":2}]', "no array of arrays|not as many"), ("[[1,,2],[3]]", "MALFORMED"), ("[[1,],[3]]", "MALFORMED")):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(Exception, match=problem):
            TB.parse_json(spark, str(tmp_path / "x.json"), "columns", columns).collect()
