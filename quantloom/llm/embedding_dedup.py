"""Operator 7, embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, durable, small_side, wide_key, workers_import

#: Vectors wanted in a bucket, vectors compared with each other at once, chance to miss a pair just at the threshold.
BUCKET, BLOCK, MISS = 1024, 1024, 1e-7


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """(bits, tables): enough bits that unrelated vectors of the largest label fill a bucket with about BUCKET, then
    enough tables that a pair of this cosine shares none with a chance of MISS."""
    bits = min(30, max(2, ceil(log2(max(rows, 1) / BUCKET))))
    same = (1 - acos(min(1.0, max(-1.0, cosine))) / pi) ** bits
    return bits, 1 if same >= 1 else max(1, ceil(log(MISS) / log(1 - same)))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of ``v`` in double precision, at length one."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _hasher(bits: int, tables: int):
    """Beside each vector its size, its bytes as they are and the key of its bucket in each table."""

    def run(batches):
        for batch in batches:
            values, lens = batch.column(3).flatten().to_numpy(), pc.list_value_length(batch.column(3)).to_numpy()
            start = np.cumsum(lens) - lens
            keys, raw = np.zeros((len(lens), tables), np.int32), [b""] * len(lens)
            for size in np.unique(lens):
                at = np.flatnonzero(lens == size)
                v = values[start[at][:, None] + np.arange(size)]
                planes = np.random.default_rng(11).standard_normal((size, bits * tables))
                keys[at] = ((unit(v) @ planes > 0).reshape(len(v), tables, bits) * (1 << np.arange(bits, dtype=np.int32))).sum(2)
                for i, x in zip(at, v, strict=True):
                    raw[i] = x.tobytes()
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lens, pa.int32()), pa.array(raw, pa.binary()), lists], ["id", "label", "copies", "size", "raw", "keys"])

    return run


def _smallest(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches in a symmetric matrix of links: neighbours' minima, then shortcuts."""
    lead = np.arange(len(near))
    while True:
        new = np.minimum(lead, np.where(near, lead, len(lead)).min(1))
        new = np.minimum(new, new[new])
        if (new == lead).all():
            return lead
        lead = new


def _compare(cosine: float, tables: int, kind):
    """Of a block pair of one bucket, (a, b, n) of each vector with links that no earlier table has: how many vectors
    they lead to, and the first of those that they reach inside the block pair. As many rows as vectors at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = unit(np.frombuffer(b"".join(pdf.raw), kind).reshape(len(pdf), -1))
        ids, blk, t = pdf.id.to_numpy(), pdf.blk.to_numpy(), int(pdf.t.iloc[0])
        near = v @ v.T >= cosine
        np.fill_diagonal(near, False)
        if blk.min() != blk.max():
            near &= blk[:, None] != blk[None, :]
        some = np.flatnonzero(near.any(1))
        if not len(some):
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "n": ids[:0]})
        near, ids, copies = near[np.ix_(some, some)], ids[some], pdf.copies.to_numpy()[some]
        if t:
            for k in np.stack(pdf["keys"].iloc[some].to_list())[:, :t].T:
                near &= k[:, None] != k[None, :]
        n = near @ copies
        return pd.DataFrame({"a": ids, "b": ids[_smallest(near)], "n": n})[n > 0]

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label, ...).

    Vectors of one non-null label (of any type) and length are linked if their cosine, in double precision, is at least
    ``cosine``. n_links counts the other vectors linked directly, component_id is the smallest vec_id that links reach,
    itself included. Null, empty and zero vectors and such with null or non-finite components link with nothing and
    are components of their own. Rows with a null vec_id count as vectors but are no component's smallest id, nor kept.
    Ids are taken to be unique: rows that repeat an id and vector count as one another's links. Extra columns are
    ignored; an empty table gives an empty one.

    Equal vectors of a label meet first and go on as one with a count, so copies are never paired out. Bits and tables
    follow the largest label. Buckets of one vector are dropped before vectors are sent to the others, as they are stored
    (floats as floats). Large buckets are cut into blocks, each pair of blocks is compared in a task of its own, which
    reports counts and joining links, never pairs; a link counts in the first table that it shares only."""
    spark = vectors.sparkSession
    workers_import(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"), "label")
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    plain = F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0 as 0
    base = base.withColumn("v", plain).withColumn("key", F.when(fine, wide_key("label", "v")))
    sets = base.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    sets = durable(sets.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay as they are
    rows = sets.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(rows, cosine)
    label = sets.select("label").schema[0]
    kinds = T.StructType([T.StructField("id", T.LongType()), label, T.StructField("copies", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("raw", T.BinaryType()), T.StructField("keys", T.ArrayType(T.IntegerType()))])
    hashed = durable(sets.select("id", "label", "copies", "v").mapInArrow(_hasher(bits, tables), kinds))
    bucket = ["label", "size", "t", "key"]
    many = hashed.select("label", "size", F.posexplode("keys").alias("t", "key")).groupBy(*bucket).count().where("count > 1")
    many = small_side(durable(many.select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))), 64)
    rows = hashed.select("*", F.posexplode("keys").alias("t", "key")).join(many, bucket)
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("lo", F.least("blk", "o")).withColumn("hi", F.greatest("blk", "o")).drop("o", "nb")
    links = rows.groupBy(*bucket, "lo", "hi").applyInPandas(_compare(cosine, tables, np.float32 if single else np.float64), "a long, b long, n long")
    links = durable(links)
    comp = components(links.select("a", "b"))
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    node = sets.select("id", "key", "rep", "copies").join(degree, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    node = durable(node)
    node = node.join(node.groupBy("component").agg(F.min("rep").alias("least")), "component").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "least")
    out = base.select("vec_id", "key").join(small_side(durable(node), 48), "key", "left")
    ident = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), ident.alias("component_id"), F.coalesce(F.col("vec_id") == ident, F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op7_embedding_dedup": r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
  WHERE len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, x.b FROM reach r JOIN link x ON r.b = x.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, m AS component_id, vec_id = m AS kept
FROM v JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = vec_id"""
}
