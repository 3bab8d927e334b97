"""JSON documents that hold one table: written from ordered parts, read in splits.

A document is an array of objects, of rows, or of columns. The writer gives each row (or cell, by column) its number and what stands before and behind it, so that the part
files, one after the other, are one document; none gathers it. The reader cuts the text at a separator, wherever it stands, and walks over each split three times, a batch of pieces at a time, none of them
shuffled: what the split does to the state at its begin (in a string or not, how deep), how many elements end in it, and the elements. Prefix sums over one row a split lie in between; only what stands
before a split's first end and behind its last one is grouped to be put together. Columns are read by cells, so that no column is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.operators import relational as R
from typeloom.operators.stable import cut

CLOSING = {"objects": "}", "rows": "]", "columns": "]"}
#: Rows of which the cells of all columns meet in one group.
BLOCK = 64
#: Bytes of text that a task looks at at once.
PART = 1 << 20
SPACE = " \n\r\t"

_QUOTE, _OPEN, _CLOSE, _COMMA, _BACKSLASH = 1, 2, 3, 4, 5
_KIND, _SOLID = np.zeros(256, np.uint8), np.ones(256, np.uint8)
for _chars, _kind in (('"', _QUOTE), ("[{", _OPEN), ("]}", _CLOSE), (",", _COMMA), ("\\", _BACKSLASH)):
    _KIND[[ord(x) for x in _chars]] = _kind
_SOLID[[ord(x) for x in SPACE]] = 0


def _value(c: str) -> Column:
    text = F.to_json(F.array(F.col(f"`{c}`")))
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def write_json(df: DataFrame, path: str, layout: str, order: str | list[str]) -> None:
    """df as one document in a folder of part files, rows in the given order. objects leave nulls out; the other layouts write them."""
    if layout not in CLOSING:
        raise ValueError(f"unknown layout {layout}")
    rows = R.numbered(df, order, "_n")
    total = rows.count()
    if layout == "columns":
        cells = F.array(*[F.struct(F.lit(i).alias("_c"), _value(c).alias("value")) for i, c in enumerate(df.columns)])
        rows = rows.select("_n", F.inline(cells))
        before = F.when(F.col("_n") > 1, ",").when(F.col("_c") > 0, ",[").otherwise("[[")
        after = F.when(F.col("_n") < total, "").when(F.col("_c") < len(df.columns) - 1, "]").otherwise("]]")
    else:
        plain = F.concat(F.lit("["), F.concat_ws(",", *map(_value, df.columns)), F.lit("]"))
        rows = rows.select("_n", F.lit(0).alias("_c"), (F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if layout == "objects" else plain).alias("value"))
        before, after = F.when(F.col("_n") > 1, ",").otherwise("["), F.when(F.col("_n") < total, "").otherwise("]")
    if not total:
        empty = f"[{','.join(['[]'] * len(df.columns))}]" if layout == "columns" else "[]"
        df.sparkSession.createDataFrame([(empty,)], "value string").coalesce(1).write.text(path)
        return
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("_c", "_n", F.concat(before, "value", after).alias("value"))
    rows.repartitionByRange(tasks, "_c", "_n").sortWithinPartitions("_c", "_n").select("value").write.text(path)


# -- one split, a batch of pieces at a time --


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches in parts that belong to one split and are no longer than PART (or one piece), each with its text."""
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        change = np.zeros(n - 1, bool)
        for k in keys:
            values = batch.column(k)
            change |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        value = batch.column("value")
        offsets = np.frombuffer(value.buffers()[1], np.int32)[value.offset : value.offset + n + 1]
        data = np.frombuffer(value.buffers()[2], np.uint8)
        change |= np.diff((offsets[1:] - offsets[0]) // PART) > 0
        borders = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(borders, borders[1:], strict=False):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]]


def _marks(text: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of quotes, brackets and commas in a text that begins in a string (1) or not (0), and whether one is open there (at a quote: behind it)."""
    kind = _KIND[text]
    at = np.flatnonzero(kind)
    kind = kind[at]
    back = at[kind == _BACKSLASH]
    if back.size:
        # every other backslash of a run takes the next character with it
        order = np.arange(back.size)
        begin = np.maximum.accumulate(np.where(np.diff(back, prepend=-2) > 1, order, 0))
        taken = np.zeros(text.size + 1, bool)
        taken[back[(order - begin) % 2 == 0] + 1] = True
        keep = (kind != _BACKSLASH) & ~taken[at]
        at, kind = at[keep], kind[keep]
    return at, kind, (inside + np.cumsum(kind == _QUOTE)) % 2


def _step(kind: np.ndarray) -> np.ndarray:
    return (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_MEASURED = pa.schema([("_file", pa.utf8()), ("_block", pa.int64()), ("_size", pa.int64()), ("_flip", pa.int64()), ("_d0", pa.int64()), ("_d1", pa.int64()), ("_bytes", pa.int64()), ("_pieces", pa.int64())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: whether its quotes turn the state over, by how much it goes deeper if it begins outside of a string or in one."""
    now = None
    for run, text in _runs(batches, ["_file", "_block"]):
        key = [run.column(c)[0].as_py() for c in ("_file", "_block", "_size")]
        if now is None or now[:2] != key[:2]:
            if now:
                yield _batch([tuple(now)], _MEASURED)
            now = [*key, 0, 0, 0, 0, 0]
        _, kind, inside = _marks(text, now[3])
        step = _step(kind)
        now[3] = int(inside[-1]) if inside.size else now[3]
        now[4] += int(step[inside == 0].sum())
        now[5] += int(step[inside == 1].sum())
        now[6] += text.size
        now[7] += run.num_rows
    if now:
        yield _batch([tuple(now)], _MEASURED)


class _Split:
    """The state within a split: what a piece of its text ends."""

    def __init__(self, run: pa.RecordBatch, closing: int):
        self.row = {c: run.column(c)[0].as_py() for c in run.schema.names if c != "value"}
        self.closing, self.inside, self.depth, self.pieces = closing, self.row["_in"], self.row["_deep"], 0
        self.held: list[bytes] = []  # the text since the last mark
        self.marked = False
        self.ends = self.columns = self.roots = 0
        self.column_end: int | None = None
        self.strange = False

    def read(self, run: pa.RecordBatch, text: np.ndarray, check: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes | None, bool]:
        """Begins and ends of the elements that end in the text, whether a column ends with them, the first one's text where it begins before, and whether it began before the split."""
        self.pieces += run.num_rows
        if self.pieces == self.row["_bare"]:  # behind the last piece of this file stood no separator
            text = text[:-1]
        at, kind, inside = _marks(text, self.inside)
        outside = inside == 0
        step = np.where(outside, _step(kind), 0)
        depth = self.depth + np.cumsum(step)
        if self.closing:
            end = mark = outside & (depth == 1) & (text[at] == self.closing)
            last = np.zeros(at.size, bool)
        else:
            last = outside & (kind == _CLOSE) & (depth == 1)
            end = last | (outside & (kind == _COMMA) & (depth == 2))
            mark = end | (outside & (kind == _OPEN) & (depth == 2))
            if check:
                self._check(text, at, kind, depth - step, depth)
        self.inside, self.depth = (int(inside[-1]), int(depth[-1])) if at.size else (self.inside, self.depth)
        chosen = np.flatnonzero(mark)
        places, is_end = at[chosen], end[chosen]
        if not places.size:
            self.held.append(text.tobytes())
            return places, places, last[chosen], None, False
        begins, ends = np.concatenate(([0], places[:-1] + 1))[is_end], places[is_end] + 1
        first = b"".join([*self.held, text[: ends[0]].tobytes()]) if is_end[0] else None
        before = first is not None and not self.marked
        self.marked, self.held = True, [text[places[-1] + 1 :].tobytes()]
        last = last[chosen][is_end]
        if (closed := np.flatnonzero(last)).size:
            self.column_end = self.ends + int(closed[-1]) + 1
        self.ends += ends.size
        self.columns += closed.size
        return begins, ends, last, first, before

    def _check(self, text: np.ndarray, at: np.ndarray, kind: np.ndarray, before: np.ndarray, depth: np.ndarray) -> None:
        """Outside of the columns nothing may stand but white space, commas and the brackets of arrays."""
        solid, low, char = np.concatenate(([0], np.cumsum(_SOLID[text], dtype=np.int64))), before <= 1, text[at]
        gap = solid[at] - solid[np.concatenate(([0], at[:-1] + 1))]
        wrong = low & ((gap > 0) | (kind == _QUOTE) | ((kind == _OPEN) & (char != ord("["))) | ((kind == _COMMA) & (before < 1)))
        wrong |= (depth < 0) | ((kind == _CLOSE) & (depth <= 1) & (before > depth) & (char != ord("]")))
        self.roots += int(np.count_nonzero((kind == _OPEN) & (before == 0)))
        after, start = (depth[-1], at[-1] + 1) if at.size else (self.depth, 0)
        self.strange |= bool(wrong.any()) or (after <= 1 and solid[-1] > solid[start])


def _splits_of(batches: Iterator[pa.RecordBatch], closing: int) -> Iterator[tuple[_Split, bool, pa.RecordBatch, np.ndarray]]:
    now = None
    for run, text in _runs(batches, ["_split"]):
        new = now is None or run.column("_split")[0].as_py() != now.row["_split"]
        now = _Split(run, closing) if new else now
        yield now, new, run, text


_COUNTED = pa.schema([("_split", pa.int64()), ("_ends", pa.int64()), ("_columns", pa.int64()), ("_column_end", pa.int64()), ("_roots", pa.int64()), ("_strange", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary())])


def _count(closing: int) -> Callable:
    """One row a split: how many elements (and columns) end in it, what ends its first element if that begins before it, what follows its last end. A tail of no column is null."""

    def row(s: _Split, head: bytes | None) -> pa.RecordBatch:
        tail = b"".join(s.held) if s.closing or s.depth >= 2 else None
        return _batch([(s.row["_split"], s.ends, s.columns, s.column_end, s.roots, s.strange, head, tail)], _COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for split, new, part, text in _splits_of(batches, closing):
            if new:
                if now:
                    yield row(now, head)
                now, head = split, None
            *_, first, before = split.read(part, text, True)
            head = first if before else head
        if now:
            yield row(now, head)

    return run


def _elements(closing: int) -> Callable:
    """_line and value of the elements that begin and end in a split."""
    schema = pa.schema([("_line", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, _, part, text in _splits_of(batches, closing):
            line = split.row["_base"] + split.ends + 1
            _, ends, _, first, before = split.read(part, text, False)
            if not ends.size:
                continue
            # all but the first lie one behind the other in the text as it is
            values = pa.Array.from_buffers(pa.binary(), ends.size - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
            lines = pa.array(np.arange(line, line + ends.size))
            if before:
                lines = lines.slice(1)
            else:
                values = pa.concat_arrays([pa.array([first], pa.binary()), values])
            yield pa.RecordBatch.from_arrays([lines, values], schema=schema)

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_column, _pos (0-based), _n, value: cells that begin and end in a split, up to BLOCK of them in one text, with the comma or bracket behind them."""
    schema = pa.schema([("_column", pa.int64()), ("_pos", pa.int64()), ("_n", pa.int64()), ("value", pa.binary())])
    for split, new, part, text in _splits_of(batches, 0):
        if new:
            column, pos = split.row["_column"], split.row["_pos"]
        begins, ends, last, first, before = split.read(part, text, False)
        n = ends.size
        if not n:
            continue
        count = np.arange(n)
        columns = column + np.cumsum(last) - last
        begun = np.maximum.accumulate(np.concatenate(([-pos], np.where(last, count + 1, -pos))))  # the number of the first cell of the column
        places = count - begun[:-1]
        column, pos = int(columns[-1] + last[-1]), int(n - begun[-1])
        borders = np.flatnonzero((places % BLOCK == 0) | (count == int(before)))
        borders = [*borders[borders >= int(before)].tolist(), n]
        rows = []
        for a, b in zip(borders, borders[1:], strict=False):
            whole = text[begins[a] : ends[b - 1]].tobytes()
            if a == 0 and first is not None:
                whole = first + text[ends[0] : ends[b - 1]].tobytes()
            rows.append((int(columns[a]), int(places[a]), b - a, whole))
        if rows:
            yield _batch(rows, schema)


# -- documents --


def _pieces(spark: SparkSession, path: str, separator: str) -> tuple[DataFrame, DataFrame]:
    """The pieces of a document's text, and one row a split: its document, number (_split), the state at its begin (_in, _deep) and at its end (_final).

    Part files of one folder are one document, other files one each; documents follow each other by path."""
    raw = spark.read.option("lineSep", separator).text(path)
    raw = raw.select(F.concat("value", F.lit(separator)).alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"))
    splits = raw.mapInArrow(_measure, "_file string, _block long, _size long, _flip long, _d0 long, _d1 long, _bytes long, _pieces long")
    document = F.when(F.col("_file").rlike("/part-[0-9]+[^/]*\\z"), F.regexp_replace("_file", "/[^/]*\\z", "")).otherwise(F.col("_file"))
    # whether the file's last piece had no separator behind it: then all pieces and separators are more than its size
    file = Window.partitionBy("_file")
    bare = (F.sum("_bytes").over(file) > F.col("_size")) & (F.col("_block") == F.max("_block").over(file))
    splits = splits.select("*", document.alias("_doc"), bare.alias("_open"))
    back = [F.col(f"_d{b}") + F.when(F.col("_open") & (F.col("_flip") == b), 0 if separator == "," else 1).otherwise(0) for b in (0, 1)]
    earlier = Window.partitionBy("_doc").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("*", F.pmod(F.coalesce(F.sum("_flip").over(earlier), F.lit(0)), F.lit(2)).alias("_in"))
    splits = splits.withColumn("_goes", F.when(F.col("_in") == 0, back[0]).otherwise(back[1]))
    splits = splits.withColumn("_deep", F.coalesce(F.sum("_goes").over(earlier), F.lit(0)))
    number = F.row_number().over(Window.orderBy("_doc", "_file", "_block")).cast("long")
    return raw, cut(splits.select("_doc", "_file", "_block", number.alias("_split"), "_in", "_deep", (F.col("_deep") + F.col("_goes")).alias("_final"), F.when(F.col("_open"), F.col("_pieces")).otherwise(-1).alias("_bare")))


def _beside(raw: DataFrame, splits: DataFrame, *more: str) -> DataFrame:
    """The pieces with the row of their split. A broadcast keeps the order in which they are read."""
    states = ["_split", "_in", "_deep", "_bare", *more]
    return raw.join(F.broadcast(splits.select("_file", "_block", *states)), ["_file", "_block"]).select("value", *states)


def _counted(raw: DataFrame, splits: DataFrame, closing: int) -> DataFrame:
    """splits with what ends in them, in one file: one row a split."""
    counts = _beside(raw, splits).mapInArrow(_count(closing), "_split long, _ends long, _columns long, _column_end long, _roots long, _strange boolean, head binary, tail binary")
    return cut(splits.join(counts, "_split").repartition(1))


def _joined(splits: DataFrame, head: list[Column], tail: list[Column]) -> DataFrame:
    """Elements that do not begin and end in one split: the keys, and value, put together from the tails and heads of splits."""
    parts = [splits.select(*keys, F.struct("_split", F.lit(i).alias("_i"), F.col(c).cast("string").alias("value")).alias("part")).where("part.value is not null") for i, (c, keys) in enumerate((("head", head), ("tail", tail)))]
    both = parts[0].unionByName(parts[1])
    keys = [c for c in both.columns if c != "part"]
    return both.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts")).select(*keys, F.array_join(F.transform("parts", lambda x: x["value"]), "").alias("value"))


def records(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """_line (1-based, in the document's order), value, problem: each element of the outer array as text. A document that is cut off, or goes on behind its end, has a last record with a problem.

    Part files of one folder are one document, other files one each; documents follow each other by path. An element is one value: a whole column of the layout columns (column_rows() reads it by cells)."""
    closing = CLOSING[layout]
    raw, splits = _pieces(spark, path, closing)
    splits = _counted(raw, splits, ord(closing))
    c = F.col
    splits = splits.withColumn("_before", F.coalesce(F.sum("_ends").over(Window.partitionBy("_doc").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    documents = splits.groupBy("_doc").agg(F.sum("_ends").alias("_total"), F.max_by("_final", "_split").alias("_end"))
    whole = _joined(splits, [c("_doc"), c("_before").alias("_n")], [c("_doc"), (c("_before") + c("_ends")).alias("_n")]).join(documents, "_doc")
    whole = whole.withColumn("value", F.btrim("value", F.lit(SPACE + ",")))
    begun = c("_n") == 0
    inner = F.when(begun & c("value").startswith("["), F.btrim(F.substring("value", 2, 2**30), F.lit(SPACE + ","))).otherwise(c("value"))
    strange = F.when(begun & ~c("value").startswith("["), "the document is no array")
    whole = whole.select("_doc", "_n", "_total", "_end", inner.alias("value"), strange.alias("_strange"), (c("_n") == c("_total")).alias("_rest"))
    behind = F.when(c("_end") != 0, "the document is cut off, or goes on behind its end").when(~c("value").isin("]", ""), "the document goes on behind its end")
    whole = whole.select("*", F.when(c("_rest"), behind).otherwise(c("_strange")).alias("problem")).where("not _rest or problem is not null")
    first = Window.orderBy("_doc").rowsBetween(Window.unboundedPreceding, -1)
    rests = documents.join(whole.where("_rest").select("_doc", F.lit(1).alias("_bad")), "_doc", "left")
    bases = rests.select("_doc", F.coalesce(F.sum(c("_total") + F.coalesce("_bad", F.lit(0))).over(first), F.lit(0)).alias("_first"))
    splits = splits.join(bases, "_doc").withColumn("_base", c("_first") + c("_before"))
    found = _beside(raw, splits, "_base").mapInArrow(_elements(ord(closing)), "_line long, value binary")
    found = found.select("_line", F.btrim(c("value").cast("string"), F.lit(SPACE + ",")).alias("value"), F.lit(None).cast("string").alias("problem"))
    return found.unionByName(whole.join(bases, "_doc").select((c("_first") + c("_n") + 1).alias("_line"), "value", "problem"))


def column_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """_line, cells (texts, null where a column has no or a null value) of documents with n columns in all. Columns may differ in length. Only cells of BLOCK rows meet in one group.

    That the text is an array of n arrays is checked at once; that their values are JSON, when the rows are read."""
    c = F.col
    raw, splits = _pieces(spark, path, ",")
    splits = _counted(raw, splits, 0)
    documents = splits.groupBy("_doc").agg(F.sum("_columns").alias("columns"), F.sum("_roots").alias("roots"), F.bool_or("_strange").alias("strange"), F.max_by("_final", "_split").alias("end"))
    problem = F.when(c("roots") == 0, "the document is no array").when(c("end") != 0, "the document is cut off, or goes on behind its end").when(c("roots") > 1, "the document goes on behind its end").when(c("strange"), "the document is no array of arrays")
    seen = documents.agg(F.sum("columns").alias("n"), F.min_by(problem, F.when(problem.isNotNull(), c("_doc"))).alias("problem")).first()
    if seen["problem"]:
        raise ValueError(f"{path}: {seen['problem']}")
    if (seen["n"] or 0) != n:
        raise ValueError(f"{path}: not as many columns as the header has, but {seen['n'] or 0}")
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"_column": F.coalesce(F.sum("_columns").over(earlier), F.lit(0)), "_before": F.coalesce(F.sum("_ends").over(earlier), F.lit(0))})
    splits = splits.withColumn("_pos", c("_before") - F.coalesce(F.max(c("_before") + c("_column_end")).over(earlier), F.lit(0)))
    after = F.when(c("_column_end").isNull(), c("_pos") + c("_ends")).otherwise(c("_ends") - c("_column_end"))
    cells = _beside(raw, splits, "_column", "_pos").mapInArrow(_cells, "_column long, _pos long, _n long, value binary").withColumn("value", c("value").cast("string"))
    joined = _joined(splits, [c("_column"), c("_pos")], [(c("_column") + c("_columns")).alias("_column"), after.alias("_pos")])
    cells = cells.unionByName(joined.withColumn("_n", F.lit(1).cast("long")))
    text = F.concat(F.lit("["), F.substring("value", F.lit(1), F.char_length("value") - 1), F.lit("]"))
    cells = cells.select("_column", "_pos", "_n", c("value").endswith("]").alias("_last"), F.from_json(text, "array<string>", {"mode": "FAILFAST"}).alias("_cells"))
    # an array without values is read as one of no text
    none = (c("_n") == 1) & (c("_pos") == 0) & c("_last") & (F.size("_cells") == 0)
    wrong = F.raise_error(F.lit(f"{path}: a column has a malformed value (MALFORMED)")).cast("array<string>")
    cells = cells.select(F.floor(c("_pos") / BLOCK).alias("_block"), F.struct("_column", "_pos", F.when((F.size("_cells") == c("_n")) | none, c("_cells")).otherwise(wrong).alias("_cells")).alias("part"))
    blocks = cells.groupBy("_block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    column = lambda i: F.flatten(F.transform(F.filter("parts", lambda p: p["_column"] == i), lambda p: p["_cells"]))
    rows = blocks.select("_block", *[column(i).alias(f"c{i}") for i in range(n)]).select("_block", F.posexplode(F.arrays_zip(*[f"c{i}" for i in range(n)])).alias("_i", "_row"))
    return rows.select((c("_block") * BLOCK + c("_i") + 1).alias("_line"), F.array(*[c(f"_row.c{i}") for i in range(n)]).alias("cells"))
