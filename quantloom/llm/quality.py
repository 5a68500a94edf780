"""Operator 6, quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, durable, fresh, mix, small_side, words, workers_import

#: Hashed features, labelled documents to learn from at most, shards that learn apart and are averaged, passes.
BITS, MOST_LABELS, SHARDS, PASSES = 18, 24_000, 8, 4
#: Follow-the-regularised-leader: step, its offset, L1 and L2 weights; SCALE multiplies all feature values.
ALPHA, BETA, L1, L2, SCALE = 0.6, 0.5, 0.02, 0.05, 24.0
_BIAS = (1 << BITS) - 1
#: Weights of shards are summed as whole multiples of 2**-UNIT: sums do not depend on their order.
UNIT = 40

# kinds of bytes in a word: upper, lower, digit, outside ASCII, full stop or comma, one bit each; other marks by two bits
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
_KIND[[44, 46]] = 16
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x not in (44, 46)]] = 32


def features(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Index arrays and the document limits of each: words, word pairs, and one to three word shapes (which kinds of
    characters, short or long, a repetition of the word before)."""
    h, start, limits = words(data, at, lower=False)
    if not len(h):
        return [np.zeros(0, np.int64)] * 5, [limits] * 5
    end = np.minimum(np.append(start[1:], len(data)), np.repeat(at[1:], np.diff(limits)))  # of the word or its text
    length = np.minimum(end - start, 24) // 6
    shape = np.bitwise_or.reduceat(_KIND[data], start).astype(np.uint64)
    again = np.zeros(len(h), np.uint64)
    again[1:] = h[1:] == h[:-1]
    again[limits[:-1][np.diff(limits) > 0]] = 0  # the word before is another text's
    shape = shape | (again << np.uint64(8)) | (length.astype(np.uint64) << np.uint64(9))

    def grams(x, k, salt):
        acc = np.full(max(0, len(x) - k + 1), salt, np.uint64)
        for j in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + x[j : len(x) - k + 1 + j])
        starts = limits[:-1]
        ends = np.maximum(limits[1:] - k + 1, starts)
        lens = ends - starts
        out = np.concatenate([[0], np.cumsum(lens)])
        src = np.repeat(starts - out[:-1], lens) + np.arange(out[-1])
        return (acc[src] & np.uint64((1 << BITS) - 1)).astype(np.int64), out

    got = [grams(h, 1, 1), grams(h, 2, 2), grams(shape, 1, 3), grams(shape, 2, 4), grams(shape, 3, 5)]
    return [x for x, _ in got], [x for _, x in got]


def _margins(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Sparse dot products: the mean weight of each kind of feature, times SCALE, plus the bias."""
    out = np.full(len(column), weights[_BIAS], np.float64)
    for row, data, at in chunks(column):
        for index, limits in zip(*features(data, at), strict=True):
            full = np.flatnonzero(np.diff(limits))
            if len(full):
                total = np.add.reduceat(weights[index], limits[full])
                out[row + full] += SCALE * total / np.diff(limits)[full]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _sparse(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(features, their counts, number of features and scale of each kind) of each text; the bias is a kind of its own. The
    arrays of a document are parts of a few large ones, eight bytes a feature, that go back when a shard is done."""
    docs = []
    for _, data, at in chunks(column):
        index, limits = features(data, at)
        rows = []
        for i in range(len(at) - 1):
            parts = [np.unique(x[e[i] : e[i + 1]], return_counts=True) for x, e in zip(index, limits, strict=True)] + [(np.array([_BIAS]), np.ones(1, np.int64))]
            scale = np.array([SCALE / max(1, p[1].sum()) for p in parts[:-1]] + [1.0])
            rows.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([len(p[0]) for p in parts]), scale))
        x, n = (np.concatenate([r[k] for r in rows]).astype(np.int32) for k in (0, 1))
        end = np.cumsum([len(r[0]) for r in rows])
        docs += [(x[e - len(r[0]) : e], n[e - len(r[0]) : e], r[2], r[3]) for e, r in zip(end, rows, strict=True)]
    return docs


def learn(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], labels: list[float]) -> np.ndarray:
    """Weights after PASSES passes over the documents in random orders. A feature's value is its share among those of its
    kind, times SCALE; the bias's is one."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    order = np.random.default_rng(5)
    for _ in range(PASSES):
        for i in order.permutation(len(docs)):
            x, count, kinds, scale = docs[i]
            v = count * np.repeat(scale, kinds)
            w = -np.sign(z[x]) * np.maximum(np.abs(z[x]) - L1, 0) / ((BETA + np.sqrt(n[x])) / ALPHA + L2)
            g = (_sigmoid(float(w @ v)) - labels[i]) * v
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            np.add.at(z, x, g - s * w)
            np.add.at(n, x, g * g)
    return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _train(batches):
    """(shard, feature, weight) learned from rows (shard, label, text) in order of their shards: a partition may hold
    several shards, each learns for itself. Every shard reports its bias, so that it counts in the mean."""

    def learned():
        w = learn(docs, labels)
        at = np.union1d(np.flatnonzero(w), [_BIAS])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), pa.array(at, pa.int32()), pa.array(np.round(w[at] * 2.0**UNIT).astype(np.int64))], ["shard", "i", "w"])

    shard, docs, labels = None, [], []
    for batch in batches:
        of = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if docs and of[a] != shard:
                    yield learned()
                    docs, labels = [], []
                shard = int(of[a])
                labels += batch.column(1)[a:b].to_pylist()
                docs += _sparse(batch.column(2).slice(a, b - a))
    if docs:
        yield learned()


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, most: int) -> DataFrame:
    """(label, text, doc_id) of at most ``most`` documents with a label of 0 or 1 whose crc32(doc_id) mod modulus is
    not held: those with the smallest hashes of their ids. Several labels of one document count as the largest."""
    mine = labels.where(F.col(column).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % modulus != held))
    mine = mine.groupBy("doc_id").agg(F.max(column).cast("double").alias("label"))
    mine = durable(mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(small_side(mine, 24), "doc_id").select("label", "text", "doc_id")


def fit(sample: DataFrame) -> np.ndarray:
    """Weights from (label, text, doc_id): the mean of the models of the shards that have rows, SHARDS at most. A row's
    shard follows from its id alone, so the weights do not depend on partitions. Without rows all are zero."""
    workers_import(sample.sparkSession)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard")
    rows = sample.select(shard, "label", "text", "doc_id").repartition(SHARDS, "shard").sortWithinPartitions("shard", "doc_id", "text")
    learned = rows.select("shard", "label", "text").mapInArrow(_train, "shard int, i int, w long")
    found = learned.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toArrow()  # 2**BITS rows at most
    weights = np.zeros(1 << BITS)
    index, total, shards = (found[x].to_numpy() for x in ("i", "w", "n"))
    if len(index):
        weights[index] = total / 2.0**UNIT / shards[index == _BIAS][0]
    return weights


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``column``; a null text is an empty one and gets the bias alone."""
    workers_import(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches):
        for batch in batches:
            yield batch.append_column(column, pa.array(_sigmoid(_margins(held.value, batch.column("text"))), pa.float64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return fit(labelled(docs, labels, "quality", 3, 1, MOST_LABELS))


def held_out(modulus: int, held: int):
    """Rows without an id are held out: nothing is learned from them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text, ...); extra columns are ignored.

    A null text is an empty one and gets the bias alone; texts are scored whole whatever their length; rows alike in
    text score alike, repeated rows each give a row; rows without an id are held out. Without labels all score one half."""
    scored = score(docs.select("doc_id", "text"), quality_model(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score under the threshold: all columns, whatever their names, and all repeated rows
    stay; null and empty texts score as the bias does; without labels all stay; an empty table gives an empty one."""
    (name,) = fresh(docs, "score")
    return score(docs, quality_model(docs, labels), name).where(F.col(name) >= threshold).drop(name)


def op6_quality(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return quality_scores(read("documents"), read("labels"))
