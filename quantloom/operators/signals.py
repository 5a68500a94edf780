"""Correlations of many signals as block products, an edge table of those over a limit, and a greedy choice in rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.tables import stored

#: Signals to a block of the product, and partial sums that one task adds up.
BLOCK, FAN = 256, 16


def _products(names, block):
    """Of the rows of a partition, for each pair of blocks of signals: numbers of complete pairs, and sums of x, x * x, x * y, y
    and y * y over them."""
    starts = range(0, len(names), block)

    def run(frames):
        total = None
        for f in frames:
            x = f[names].to_numpy(float)
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            m = there.astype(float)
            one = (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)
            total = one if total is None else tuple(a + b for a, b in zip(total, one, strict=True))
        if total is not None:
            part, (n, x, xx, xy) = TaskContext.get().partitionId(), total
            cut = lambda t, i, j: t[i : i + block, j : j + block].tobytes()
            for i in starts:
                yield pd.DataFrame([(i // block, j // block, part, *(cut(t, i, j) for t in (n, x, xx, xy, x.T, xx.T))) for j in starts if i <= j], columns=["i", "j", "part", "n", "x", "xx", "xy", "y", "yy"])

    return run


def added(sums: DataFrame, keys, values, parts: int | None = None) -> DataFrame:
    """One row for each key with the element-wise sums of the arrays of doubles (as binary) in ``values``. ``sums`` has a row per
    key and partition (part); they are added FAN at a time, so no task meets those of all partitions. Where the number of
    partitions is not given, ``sums`` is stored to count them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1].copy()
        for c in values:
            first[c] = [np.add.reduce([np.frombuffer(v, float) for v in pdf[c]]).tobytes()]
        return first

    if parts is None:
        sums = stored(sums)
        parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy(*keys, "part").applyInPandas(run, sums.schema)
        parts = -(-parts // FAN)
    return sums


def block_products(df: DataFrame, names, block: int = BLOCK) -> DataFrame:
    """(i, j, part, n, x, xx, xy, y, yy): sums over all rows for each pair of blocks, one row a pair. A task holds the sums of its
    partition: k x k numbers a kind."""
    schema = "i int, j int, part long, n binary, x binary, xx binary, xy binary, y binary, yy binary"
    names = list(names)
    sums = df.select(*(F.col(x).cast("double").alias(x) for x in names)).mapInPandas(_products(names, block), schema)
    return added(sums, ["i", "j"], ["n", "x", "xx", "xy", "y", "yy"])


def _correlated(names, block, limit):
    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                a, b = names[r.i * block : (r.i + 1) * block], names[r.j * block : (r.j + 1) * block]
                n, x, xx, xy, y, yy = (np.frombuffer(v, float).reshape(len(a), len(b)) for v in (r.n, r.x, r.xx, r.xy, r.y, r.yy))
                with np.errstate(divide="ignore", invalid="ignore"):
                    vx, vy = xx - x * x / n, yy - y * y / n
                    corr = np.where((n >= 2) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy), (xy - x * y / n) / np.sqrt(vx * vy), np.nan)
                keep = (np.abs(corr) > limit) & (np.triu(np.ones_like(corr, bool), 1) if r.i == r.j else True)
                p, q = np.nonzero(keep)
                named = (pd.Series(np.array(x, object)[k], dtype=object) for x, k in ((a, p), (b, q)))
                yield pd.DataFrame(dict(zip("ab", named, strict=True)) | {"corr": np.clip(corr[p, q], -1, 1)})

    return run


def correlation_edges(df: DataFrame, names, limit: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(a, b, corr) of the pairs of columns whose pooled correlation over the rows that have both is beyond +-``limit``, a before
    b in ``names``. Columns should be of one scale (z-scores), as sums are taken of their squares. Constant ones have none."""
    return block_products(df, names, block).mapInPandas(_correlated(list(names), block, limit), "a string, b string, corr double")


def uniqueness(df: DataFrame, names, block: int = BLOCK) -> DataFrame:
    """(candidate_id, max_signal_corr_abs, signal_uniqueness): the largest size of each signal's correlations, to ten digits so
    that two signals that are each other's nearest tie, and one less it."""
    edges = correlation_edges(df, names, 0.0, block)
    both = edges.select(F.col("a").alias("candidate_id"), "corr").unionByName(edges.select(F.col("b").alias("candidate_id"), "corr"))
    most = both.groupBy("candidate_id").agg(F.round(F.max(F.abs("corr")), 10).alias("m"))
    all_ = df.sparkSession.createDataFrame([(x,) for x in names], "candidate_id string").join(most, "candidate_id", "left")
    return all_.select("candidate_id", F.coalesce("m", F.lit(0.0)).alias("max_signal_corr_abs"), (1 - F.coalesce("m", F.lit(0.0))).alias("signal_uniqueness"))


def greedy_rounds(pool: DataFrame, edges: DataFrame, score: str = "score") -> DataFrame:
    """(candidate_id, kept, close_to): from the best score on (ties: the first id) a candidate stays unless it has an edge with
    one that stays; close_to is the best of those.

    In rounds over tables: who has no better undecided neighbour stays, who has a neighbour that stays goes. Each round
    decides the best undecided candidate of every connected part at least, most of them in the first few."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), "candidate_id"))
    state = stored(pool.select("candidate_id", place.alias("place")).withColumn("kept", F.lit(None).cast("boolean")))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    at = state.select("candidate_id", "place")
    both = both.join(at.toDF("a", "p"), "a").join(at.toDF("b", "q"), "b").where("q < p")  # b is the better one
    both = stored(both.select("a", "b", "q"))
    while not state.where("kept is null").isEmpty():
        known = both.join(state.select(F.col("candidate_id").alias("b"), F.col("kept").alias("k")), "b")
        seen = known.groupBy(F.col("a").alias("candidate_id")).agg(F.max(F.coalesce("k", F.lit(False))).alias("near"), F.max(F.col("k").isNull()).alias("open"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("near", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = stored(state.join(seen, "candidate_id", "left").select("candidate_id", "place", now.alias("kept")))
    stays = both.join(state.where("kept").select(F.col("candidate_id").alias("b")), "b").groupBy(F.col("a").alias("candidate_id")).agg(F.min_by("b", "q").alias("close_to"))
    return state.join(stays, "candidate_id", "left").select("candidate_id", "kept", F.when(~F.col("kept"), F.col("close_to")).alias("close_to"))
