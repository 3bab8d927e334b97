"""Media columns: interleaved document sequences.

A document becomes HTML of text and media references; parsing it yields ordered structs (position, kind, text, digest, caption);
media are stored once more as a table of their own, keyed by digest, and a digest join resolves the references, positions and captions staying in place.

In the query a document's sequence holds its lines as text items and two media: the whole payload after the first line, and the payload's last row at the
end. Both are resolved by digest, and the row is rebuilt from what stands at their positions.

Stored form: binary PGM (P5), 64 samples of 8 bits a row: a header that gives width, height and depth, then the samples,
which are the payload's bytes unchanged. read_pgm() is its exact inverse.

Defined results: a null text is an empty one; a payload has at least 64 bytes; references without a stored medium resolve
to null and keep their place; a table of media must have one row a digest (op3_media makes it so by an aggregate); equal payloads share one stored digest whoever brings them; null ids pass through; other
columns are ignored; an empty table gives an empty table.

Scale: payload bytes are written once, where they are read, and never shuffled: what the join moves is the digest and the
features computed from the stored bytes, pre-aggregated to one row a digest and task. A digest that a third of all documents refer
to is a hot key on the reference side only, which AQE splits.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

WIDTH = 64
PAYLOAD, TAIL = "payload", "tail"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TOKEN = re.compile(r"<figure\b[^>]*>(.*?)</figure>|<img\b[^>]*>|<[^>]+>", re.S | re.I)
_SRC, _CAPTION = re.compile(r"\bsrc=\"media:([^\"]*)\"", re.I), re.compile(r"<figcaption[^>]*>(.*?)</figcaption>", re.S | re.I)


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text, bytes 0 appended up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)) * WIDTH
    lack = (size - F.octet_length(raw)).cast("int")
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), lack)))


def write_pgm(samples: Column) -> Column:
    """The stored form of a payload."""
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(samples) / WIDTH).cast("long").cast("string"), F.lit("\n255\n")), "UTF-8"), samples)


def read_pgm(stored: bytes) -> bytes:
    """The samples of a stored form; an error if their number is not what the header says."""
    kind, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not an 8-bit PGM of the size that its header gives")
    return samples


def parse_sequence(page: str | None) -> list[dict]:
    """Ordered items of a page: text between tags, and media references with their captions."""
    out, at, text = [], 0, []

    def put(kind: str, **more) -> None:
        out.append({"position": len(out), "kind": kind, "text": None, "digest": None, "caption": None} | more)

    def end() -> None:
        line = " ".join(html_lib.unescape("".join(text)).split())
        text.clear()
        if line:
            put("text", text=line)

    for m in _TOKEN.finditer(page or ""):
        text.append((page or "")[at : m.start()])
        at = m.end()
        tag = m[0]
        if src := _SRC.search(tag):
            end()
            caption = _CAPTION.search(tag)
            put("media", digest=src[1], caption=" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", caption[1])).split()) if caption else None)
        elif re.match(r"</?(p|div|h[1-6]|li|article|section|br|figure)\b", tag, re.I):
            end()
    text.append((page or "")[at:])
    end()
    return out


def sequences(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, items (SEQUENCE) for each row of pages (key, html)."""
    out = T.StructType([pages.schema[key], *T.StructType.fromDDL(f"items {SEQUENCE}").fields])
    items = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([parse_sequence(h.as_py()) for h in b.column("html")], items)], names=[key, "items"])

    return pages.select(key, "html").mapInArrow(run, out)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features_of(stored: bytes) -> tuple:
    """FEATURES of one stored medium. feature: mean and deviation of the samples, and a 64-bit average hash of 64 equal stretches."""
    data = read_pgm(stored)
    samples = np.frombuffer(data, np.uint8)
    means = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64) * 64 / len(samples)
    bits = "".join("1" if x else "0" for x in means > means.mean())
    feature = f"{samples.mean():.4f}:{samples.std():.4f}:{int(bits, 2):016x}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def media_features(stored: DataFrame) -> DataFrame:
    """digest and FEATURES for each row of stored (digest, media), computed from the bytes read back."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features_of(x.as_py()) for x in b.column("media")]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), *columns], names=["digest", *names])

    return stored.select("digest", "media").mapInArrow(run, f"digest string, {FEATURES}")


def resolve(sequence: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, position, kind, text, digest, caption, and the columns of media (digest, ...; one row a digest) where the item refers to one."""
    items = sequence.select(key, F.explode("items").alias("i")).select(key, "i.*")
    found = media.withColumnRenamed("digest", "_digest")
    return items.join(found, F.col("digest") == F.col("_digest"), "left").drop("_digest")


def pages_of(stored: DataFrame) -> DataFrame:
    """key, html for each row of stored (key, digest, media, tail_digest): the text's lines, read back from the stored bytes, as paragraphs, the whole payload's medium after the first, that of its last row at the end."""
    samples = F.substring("media", F.octet_length("media") - F.col("key.payload_size") + 1, F.col("key.n_bytes").cast("int"))
    escaped = F.regexp_replace(F.regexp_replace(F.decode(samples, "UTF-8"), "&", "&amp;"), "<", "&lt;")
    blocks = F.transform(F.split(escaped, "\n"), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>")))

    def figure(digest: str, caption: str) -> Column:
        return F.concat(F.lit('<figure><img src="media:'), digest, F.lit(f'"><figcaption>{caption}</figcaption></figure>'))

    html = F.concat(F.lit("<article>"), F.element_at(blocks, 1), figure("digest", PAYLOAD), F.array_join(F.slice(blocks, 2, F.size(blocks)), ""), figure("tail_digest", TAIL), F.lit("</article>"))
    return stored.select("key", html.alias("html"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and position, tail_position (of the two media in the document's sequence) and n_texts (its text items)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), payload(F.col("text")).alias("p"))
    tail = F.substring("p", F.octet_length("p") - WIDTH + 1, F.lit(WIDTH))
    made = made.select(
        F.struct("row", "doc_id", "n_bytes", F.octet_length("p").alias("payload_size")).alias("key"),
        F.sha2("p", 256).alias("digest"), write_pgm(F.col("p")).alias("media"), F.sha2(F.concat(F.lit("tail "), tail), 256).alias("tail_digest"), write_pgm(tail).alias("tail_media"),
    )
    stored = written(made, "media", "zstd")
    names = [f.split()[0] for f in FEATURES.split(", ")]
    each = stored.select(F.explode(F.array(F.struct("digest", "media"), F.struct(F.col("tail_digest").alias("digest"), F.col("tail_media").alias("media")))).alias("m")).select("m.*")
    found = media_features(each).groupBy("digest").agg(*[F.min(n).alias(n) for n in names])
    refs = sequences(pages_of(stored), "key").select("key", F.filter("items", lambda i: i["kind"] == "media").alias("items"), F.size(F.filter("items", lambda i: i["kind"] == "text")).alias("n_texts"))
    refs = refs.select(F.struct("key.*", "n_texts").alias("key"), "items")
    items = resolve(refs, found, "key").groupBy("key").agg(*[F.max(F.struct(F.col("caption") == c, "position", *names)).alias(c) for c in (PAYLOAD, TAIL)])
    whole = [n for n in names if n != "tail_crc32"]
    return items.select("key.doc_id", "key.n_bytes", *[F.col(f"{PAYLOAD}.{n}") for n in whole], f"{TAIL}.tail_crc32", f"{PAYLOAD}.position", F.col(f"{TAIL}.position").alias("tail_position"), "key.n_texts")
