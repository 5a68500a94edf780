"""Operator 8, line dedup: range-partitioned line hashes, secondary sort, per-document keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, durable, fresh, slices, small_side, workers_import


def line_key(line: str) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(WHITE).encode("utf-8", "surrogatepass").lower()


def _line_hashes(batches):
    for batch in (x for b in batches for x in slices(b, 2)):
        doc, row, text = (batch.column(i) for i in range(3))
        hashes, at, pos = [], [], []
        for i, t in enumerate(text.to_pylist()):
            for p, line in enumerate((t or "").split("\n")):
                if k := line_key(line):
                    hashes.append(xxhash.xxh3_64_intdigest(k) - (1 << 63))
                    at.append(i)
                    pos.append(p)
        at = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), doc.take(at), row.take(at), pa.array(pos, pa.int32())], ["h", "doc", "row", "pos"])


def _runs(batches):
    """Streams rows sorted by (h, doc, row, pos): for each h of this partition how many documents hold it here, and
    its first occurrence. A hash that fills several partitions gives one row in each; documents never straddle."""
    h = doc = first = None
    docs = 0
    for batch in batches:
        out = []
        for x, d, r, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if x != h:
                if h is not None:
                    out.append((h, docs, *first))
                h, docs, doc, first = x, 1, d, (d, r, p)
            elif d != doc:
                doc, docs = d, docs + 1
        yield _run_batch(out)
    if h is not None:
        yield _run_batch([(h, docs, *first)])


_RUN = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())])


def _run_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _RUN, strict=True)], schema=_RUN)


def keep_bitmap(dropped) -> bytes:
    """One bit per line up to the last dropped one, 1 to keep, filled up with ones, deflated."""
    bits = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def _bitmaps(batches):
    for batch in batches:
        dropped = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in dropped], pa.int32()), pa.array([keep_bitmap(x) for x in dropped], pa.binary())], ["doc", "row", "n_dropped", "bitmap"])


def doc_key():
    """Null ids as one number of their own."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))


def row_key():
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, partitions: int | None = None) -> DataFrame:
    """(doc, row, n_dropped, bitmap) of the rows of ``docs`` (doc_id, text, ...) that lose lines.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys found in at least ``min_docs``
    documents lose all their lines, or all but the first in (doc_id, row, position) order with ``keep_first``.
    Blank lines have no key and stay. A row is told by doc_key() and row_key(). The bitmap ends at the last dropped line: later lines stay.

    (hash, document) is the range key, so a very common line is dealt over many partitions, each of which streams
    its part and reports one count; only those counts meet. Null ids count as one document; repeated rows as one."""
    workers_import(docs.sparkSession)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(doc_key().alias("doc"), row_key().alias("row"), "text")
    lines = keyed.mapInArrow(_line_hashes, "h long, doc long, row long, pos int")
    lines = durable(lines)
    runs = lines.repartitionByRange(n, "h", "doc").sortWithinPartitions("h", "doc", "row", "pos").mapInArrow(_runs, "h long, n long, doc long, row long, pos int")
    common = runs.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "row", "pos")).alias("first")).where(F.col("n") >= min_docs)
    common = small_side(durable(common), 64)
    drops = lines.join(common, "h")
    if keep_first:
        drops = drops.where(F.struct("doc", "row", "pos") != F.col("first"))
    drops = drops.select("doc", "row", "pos").distinct().groupBy("doc", "row").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))
    return drops.mapInArrow(_bitmaps, "doc long, row long, n_dropped int, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> list[str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    return [x for x, b in zip(lines, bits, strict=False) if b] + lines[len(bits) :]


def attach(docs: DataFrame, bitmaps: DataFrame, n_dropped: str = "n_dropped", bitmap: str = "bitmap") -> DataFrame:
    """``docs`` with two more columns called so (null: keep all)."""
    doc, row = fresh(docs, "doc", "row")
    bitmaps = durable(bitmaps.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("n_dropped").alias(n_dropped), F.col("bitmap").alias(bitmap)))
    size = bitmaps.agg(F.avg(F.octet_length(bitmap) + 48)).first()[0] or 0
    return docs.join(small_side(bitmaps, int(size) + 1), (doc_key() == F.col(doc)) & (row_key() == F.col(row)), "left").drop(doc, row)


def _digests(batches):
    for batch in (x for b in batches for x in slices(b, 1)):
        text, bitmap = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        kept = [kept_lines(t, b) for t, b in zip(text, bitmap, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([(t or "").count("\n") + 1 for t in text], pa.int64()), pa.array([x or 0 for x in batch.column(2).to_pylist()], pa.int64()), pa.array([hashlib.sha256("\n".join(k).encode("utf-8", "surrogatepass")).hexdigest() for k in kept], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of ``docs`` (doc_id, text, ...): null and empty texts are one
    empty line; rows alike in id and text lose the same lines; extra columns are ignored."""
    both = attach(docs.select("doc_id", "text"), line_bitmaps(docs, min_docs)).select(F.col("doc_id").cast("long"), "text", F.col("n_dropped").cast("long"), "bitmap")
    return both.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _rewrite(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    out = []
    for part in slices(pa.RecordBatch.from_arrays([texts, bitmaps], ["text", "bitmap"]), 0):
        rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
        out.append(pa.array([t if b is None else "\n".join(kept_lines(t, b)) for t, b in rows], pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def drop_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """``docs`` with its text rewritten; rows and all columns stay, whatever their names. Documents that lose all lines keep
    an empty text, null texts stay null; an empty table gives an empty one."""
    rewrite = F.arrow_udf(_rewrite, "string")
    n, bitmap = fresh(docs, "n_dropped", "bitmap")
    both = attach(docs, line_bitmaps(docs, min_docs, keep_first), n, bitmap)
    return both.withColumn("text", F.when(F.col(bitmap).isNull(), F.col("text")).otherwise(rewrite("text", bitmap))).select(*docs.columns)


def op8_line_dedup(spark, sf_dir):
    return line_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT rid, doc_id, p, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
common AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce(doc_id, -1)) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.k = c.k GROUP BY rid"""
}
