"""Helpers that the operators of this subpackage share: durable cuts of the lineage, joins whose
broadcast side is checked, connected components, and hashed words of Arrow string columns."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.tables import released, remove, shared_folder, stored  # noqa: F401  (operators and the pipeline take them from here)

#: Bytes that may be broadcast: beyond this, joins shuffle both sides.
BROADCAST_BYTES = 24 << 20
#: ASCII white space: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver has it. (On a cluster the package
    is installed or sent with --py-files.)"""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: A table written to the shared folder and read from there.
durable = stored


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` is called so."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_side(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (durable, rows of at most about row_bytes) marked for broadcast if its counted size allows that,
    else unmarked, so that the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def wide_key(*columns):
    """128 bits of the columns' values and of which are null, as struct<h, g>: by chance none of 10**12 rows share one."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    columns += [c.isNull() for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("h"), F.xxhash64(F.lit(2), *columns).alias("g"))


#: Type of wide_key.
WIDE = "struct<h:bigint,g:bigint>"


def row_key(doc_id="doc_id", text="text"):
    """A key of a row's id and text: ids may be null or repeated with other texts."""
    return wide_key(doc_id, text)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long): component is the smallest node that is reachable.

    Contraction: each round, every node points to its smallest neighbour if that is smaller, pointers are followed
    twice, and the edges are rewritten to the nodes pointed at, without loops and repeats. The graph is only ever
    held as tables; aggregates are minima, so a node with very many edges is combined before it is shuffled."""
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        for _ in range(2):
            to = to.alias("x").join(to.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"))
        to = durable(to)
        if found is None:
            found = to.select("node", F.col("to").alias("component"))
        else:
            found = found.alias("f").join(to.alias("t"), F.col("f.component") == F.col("t.node"), "left").select("f.node", F.coalesce("t.to", "f.component").alias("component"))
        found = durable(found)
        a = edges.join(to, edges.a == to.node).select(F.col("to").alias("a"), "b")
        b = a.join(to, a.b == to.node).select("a", F.col("to").alias("b")).where("a <> b")
        edges = durable(b.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            return found


def ascii_lower(column):
    """A-Z lower-cased, nothing else; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


# ---- hashed words of Arrow columns -------------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
#: Fixed random values of the 256 byte values; white space counts nothing, A-Z as a-z.
_RAW = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_RAW[_WS] = 0
_LOW = _RAW.copy()
_LOW[65:91] = _RAW[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MUL = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (_STEP, _BACK)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """The batch in runs of rows with about ``most`` bytes of text in a column: objects made from them stay few."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, row = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
    while row < len(size):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def chunks(column: pa.Array, most: int = 1 << 18):
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes: temporary arrays stay small."""
    data, at = text_bytes(column)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_limits(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word, row limits in words) of the words between ASCII white space."""
    white = _WS[data]
    before = np.ones(len(data), bool)
    before[1:] = white[:-1]
    before[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(before & ~white)
    return start, np.searchsorted(start, at)


#: What tells the two hashes of wide_words apart.
_SALTS = _rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, row limits in words) of the words between ASCII white space, A-Z as a-z. Each byte is mixed with
    its place in the word before the sum (a table of random values by byte and place, in effect), so that no structure of
    words makes sums meet; together 128 bits."""
    start, limits = word_limits(data, at)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), limits
    first = np.zeros(len(data), np.int64)
    first[start] = start
    place = (np.arange(len(data)) - np.maximum.accumulate(first)).astype(np.uint64) * _STEP
    own, out = _LOW[data], []
    for salt in _SALTS:
        value = mix(own * salt + place)
        value[own == 0] = 0
        out.append(mix(np.add.reduceat(value, start)))
    return *out, limits


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first byte of each word, row limits in words) of the words between ASCII white space."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    white = _WS[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = white[:-1]
    before[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(before & ~white)
    limits = np.searchsorted(start, at)
    if not len(start):
        return np.zeros(0, np.uint64), start, limits
    up, back = powers(n)
    h = np.add.reduceat((_LOW if lower else _RAW)[data] * up[:n], start) * back[start]
    return mix(h), start, limits


def shingles(h: np.ndarray, limits: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row limits) of the k-word shingles of each row; fewer words than k make one shingle, none none."""
    count = np.diff(limits)
    out = np.zeros(0, np.uint64)
    if len(h) >= k:
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out += h[j : len(h) - k + 1 + j] * _MUL[j]
        out = mix(out)
    lens = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(lens)])
    src = np.repeat(limits[:-1] - ends[:-1], lens) + np.arange(ends[-1])
    short = np.repeat((count < k) & (count > 0), lens)
    got = np.zeros(ends[-1], np.uint64)
    got[~short] = out[src[~short]]
    for row in np.flatnonzero((count < k) & (count > 0)):
        own = h[limits[row] : limits[row + 1]]
        own = np.append(own, np.uint64(len(own)))
        got[ends[row]] = mix(np.sum(own * _MUL[-len(own) :], dtype=np.uint64, keepdims=True))[0]
    return got, ends
