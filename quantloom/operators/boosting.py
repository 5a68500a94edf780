"""Boosted regression trees of second order: quantile bins, histograms of gradients and hessians made by partition and added in
a tree, splits found on the histograms, the best split first.

Rows are binned once (a byte a column) and stored with their margin. A pass over them makes the histograms that the next splits
need: those of the smaller child of every leaf that can still be split, so a tree takes about a pass a level though it
grows by leaves; the other child is the parent less its sibling. Gradients are rounded to whole numbers, few enough bits that
all sums are exact in doubles: a model doesn't depend on partitions, their order, or a task that ran twice."""

from __future__ import annotations

import heapq
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT
from quantloom.functions.tables import remove, shared_folder

from .signals import added

#: Places of a column's histogram: 0 for missing values, then the bins.
PLACES = 256
#: Trees whose margins each pass recomputes before they are stored anew, and trees after which the gradients' bound is taken anew.
KEPT, BOUNDED = 2, 16


@dataclass(frozen=True)
class Settings:
    """``squared`` is the L2 penalty of leaf values; ``leaves`` or ``depth`` bound a tree (None: no bound, but not both)."""

    trees: int = 100
    step: float = 0.1
    leaves: int | None = 31
    depth: int | None = None
    squared: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1e-3
    least_rows: int = 1
    bins: int = 254
    row_share: float = 1.0
    column_share: float = 1.0
    loss: str = "squared"
    seed: int = 7

    def __post_init__(self):
        if self.leaves is None and self.depth is None:
            raise ValueError("a tree needs a bound: leaves or depth")
        if self.loss not in ("squared", "logistic") or not 2 <= self.bins < PLACES:
            raise ValueError("loss is squared or logistic, bins are 2 to 255")


#: Trees by level and by leaf, with usual parameters.
DEFAULTS = {
    "boost_by_level": Settings(trees=500, step=0.05, leaves=None, depth=6, squared=1.0, least_hessian=1.0, row_share=0.8, column_share=0.8),
    "boost_by_leaf": Settings(trees=500, step=0.05, leaves=31, squared=0.0, least_rows=20, column_share=0.8),
}


@dataclass
class Tree:
    """Nodes from the root (0). An inner node sends bins 1 to ``cut`` of its feature left, and missing values as ``missing_left``
    says; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, x in (("feature", -1), ("cut", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def split(self, node: int, found: tuple, left: int, right: int) -> None:
        self.gain[node], self.feature[node], self.cut[node], self.missing_left[node] = found
        self.left[node], self.right[node] = left, right

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))
        at, going = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            going = going[feature[at[going]] >= 0]
            if not len(going):
                return at
            node = at[going]
            b = bins[going, feature[node]]
            at[going] = np.where(np.where(b == 0, missing[node], b <= cut[node]), left[node], right[node])

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    settings: Settings
    trees: list[Tree]


def bin_rows(frame: pd.DataFrame, features, edges) -> np.ndarray:
    """The bin of each value: 0 if missing, else 1 and how many edges lie below it."""
    out = np.zeros((len(frame), len(features)), np.uint8)
    for i, (name, e) in enumerate(zip(features, edges, strict=True)):
        x = frame[name].to_numpy(float)
        out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, side="left"))
    return out


def quantile_edges(rows: DataFrame, features, bins: int) -> list[np.ndarray]:
    """At most bins - 1 distinct quantiles of each column, which end its bins; a column of few values has an edge at each common one."""
    shares = [i / bins for i in range(1, bins)]
    there = lambda x: F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    found = rows.agg(*(F.percentile_approx(there(x), shares, 100 * bins).alias(x) for x in features)).first()
    return [np.unique(np.array(found[x] or [], float)) for x in features]


def gradients(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margin."""
    if loss == "squared":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def whole(loss: str, rows: int, bound: float) -> tuple[float, float]:
    """Factors for gradients (at most ``bound``) and hessians, by which sums over ``rows`` rounded ones stay whole below 2 ** 52."""
    bits = max(8, min(30, 52 - math.ceil(math.log2(max(rows, 1)))))
    return 2.0**bits / (bound or 1.0), 1.0 if loss == "squared" else 2.0**bits


def drawn(h: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Rows that a tree uses: those whose hash, mixed with tree and seed, lies in the share."""
    z = h.view(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**64 < share


def best_split(hist: np.ndarray, s: Settings, columns) -> tuple | None:
    """(gain, feature, cut, missing_left) with the greatest gain of a histogram (column, place, (gradient, hessian, rows)) in real
    units, None if none beats ``least_gain``; ties: first column, then cut, then missing values right."""
    hist = hist[columns]
    total = hist[0].sum(0)
    score = lambda t: t[..., 0] ** 2 / np.maximum(t[..., 1] + s.squared, 1e-300)
    seen = hist[:, 1:-1].cumsum(1)
    left = np.stack([seen, seen + hist[:, :1]], 2)
    right = total - left
    fits = np.ones(left.shape[:-1], bool)
    for side in (left, right):
        fits &= (side[..., 2] >= max(s.least_rows, 1)) & (side[..., 1] >= s.least_hessian)
    gain = np.where(fits, 0.5 * (score(left) + score(right) - score(total)), -np.inf)
    i = int(gain.argmax())
    f, cut, missing = np.unravel_index(i, gain.shape)
    if not gain.flat[i] > s.least_gain + 1e-12 * score(total):
        return None
    return float(gain.flat[i]), int(columns[f]), int(cut) + 1, bool(missing)


def _columns_of(batch: pa.RecordBatch, k: int):
    n = len(batch)
    b = batch.column("b")
    flat = np.frombuffer(b.buffers()[2], np.uint8) if n else np.zeros(0, np.uint8)
    at = np.frombuffer(b.buffers()[1], np.int32)[b.offset] if n else 0
    cells = flat[at : at + n * k].reshape(n, k)
    return cells, *(batch.column(c).to_numpy() for c in ("y", "margin", "h"))


def _binned(features, edges, base):
    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            cells = bin_rows(frame, features, edges)
            ends = pa.py_buffer(np.arange(len(cells) + 1, dtype=np.int32) * len(features))
            packed = pa.Array.from_buffers(pa.binary(), len(cells), [None, ends, pa.py_buffer(np.ascontiguousarray(cells))])
            yield pa.RecordBatch.from_arrays([packed, pa.array(frame["y"].to_numpy(float)), pa.array(np.full(len(frame), base)), pa.array(frame["h"].to_numpy(np.int64))], ["b", "y", "margin", "h"])

    return run


_ROWS = "b binary, y double, margin double, h long"


def _moved(trees, step, k):
    """Rows with the margins of further trees."""
    def run(batches):
        for batch in batches:
            bins, y, margin, h = _columns_of(batch, k)
            for t in trees:
                margin = margin + step * t.values(bins)
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(y), pa.array(margin), pa.array(h)], ["b", "y", "margin", "h"])

    return run


def _histograms(trees, tree, number, wanted, k, s, factors):
    """A partition's histograms of the wanted nodes of the tree that grows."""
    def run(batches):
        slots = np.full(len(tree.feature), -1)
        slots[wanted] = np.arange(len(wanted))
        total = np.zeros((len(wanted), k, PLACES, 3))
        for batch in batches:
            bins, y, margin, h = _columns_of(batch, k)
            slot = slots[tree.nodes(bins)]
            keep = slot >= 0
            if s.row_share < 1:
                keep &= drawn(h, number, s.seed, s.row_share)
            bins, y, margin, slot = bins[keep], y[keep], margin[keep], slot[keep]
            for t in trees:
                margin = margin + s.step * t.values(bins)
            g, q = (np.rint(x * f) for x, f in zip(gradients(s.loss, margin, y), factors, strict=True))
            for f in range(k):
                at = slot * PLACES + bins[:, f]
                for i, w in ((0, g), (1, q), (2, None)):
                    if i != 1 or s.loss != "squared":  # whose hessians are the numbers of rows
                        total[:, f, :, i] += np.bincount(at, w, len(wanted) * PLACES).reshape(len(wanted), PLACES)
        if s.loss == "squared":
            total[..., 1] = total[..., 2]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.array(wanted, np.int32)), pa.array(np.full(len(wanted), part)), pa.array([m.tobytes() for m in total], pa.binary())], ["node", "part", "m"])

    return run


def grow(histograms, k: int, s: Settings, columns) -> Tree:
    """A tree grown best split first. ``histograms(tree, nodes)`` gives those of nodes in real units; it is asked for the
    smaller children of all leaves that the bound on leaves may still split, so about once a level."""
    draft = Tree()
    value = lambda h: float(-h[0, :, 0].sum() / max(h[0, :, 1].sum() + s.squared, 1e-300))
    draft.add(0.0)
    known = {0: histograms(draft, [0])[0]}
    draft.value[0] = value(known[0])
    depth, open_, taken = {0: 0}, [], set()

    def offer(node):
        found = best_split(known[node], s, columns) if s.depth is None or depth[node] < s.depth else None
        if found is not None:
            heapq.heappush(open_, (-found[0], node, found))
        else:
            del known[node]

    offer(0)
    while open_ and (s.leaves is None or len(taken) + 1 < s.leaves):
        node = open_[0][1]
        if draft.feature[node] < 0:  # its children are not known yet: ask for those of every leaf that may be split
            most = len(open_) if s.leaves is None else s.leaves - 1 - len(taken)
            ask, pairs = [], []
            for _, leaf, found in heapq.nsmallest(most, open_):
                if draft.feature[leaf] < 0:
                    _, f, cut, missing = found
                    own = known[leaf][f]
                    low = own[1 : cut + 1, 2].sum() + (own[0, 2] if missing else 0)
                    left, right = draft.add(0.0), draft.add(0.0)
                    draft.split(leaf, found, left, right)
                    small, large = (left, right) if 2 * low <= own[:, 2].sum() else (right, left)
                    ask.append(small)
                    pairs.append((leaf, small, large))
            for (leaf, small, large), h in zip(pairs, histograms(draft, ask), strict=True):
                known[small], known[large] = h, known.pop(leaf) - h
                for child in (small, large):
                    draft.value[child], depth[child] = value(known[child]), depth[leaf] + 1
        heapq.heappop(open_)
        taken.add(node)
        for child in (draft.left[node], draft.right[node]):
            offer(child)
    tree, at = Tree(), [(0, None, None)]
    while at:  # the nodes that were taken, and their leaves
        node, parent, side = at.pop(0)
        new = tree.add(draft.value[node])
        if parent is not None:
            getattr(tree, side)[parent] = new
        if node in taken:
            tree.split(new, (draft.gain[node], draft.feature[node], draft.cut[node], draft.missing_left[node]), -1, -1)
            at += [(draft.left[node], new, "left"), (draft.right[node], new, "right")]
    return tree


def fit(train: DataFrame, features, settings: Settings = Settings(), keys=(DATE, INSTRUMENT)) -> Boosted:
    """Trees for y from the feature columns; null and NaN are missing values with a side of their own at each split. Rows without y
    are left out; without rows the model is 0 everywhere. ``keys`` tell rows apart where a tree draws some of them.

    The driver holds edges and histograms: columns times 256 numbers for each open leaf, whatever the rows."""
    s, features = settings, list(features)
    spark, k = train.sparkSession, len(features)
    y = F.col("y").cast("double")
    rows = train.where(y.isNotNull() & ~F.isnan(y)).select(y.alias("y"), F.xxhash64(*keys).alias("h"), *(F.col(x).cast("double").alias(x) for x in features))
    n, mean, low, high = rows.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y")).first()
    if not n or not k:
        return Boosted(features, [np.zeros(0)] * k, mean or 0.0, s, [])
    edges = quantile_edges(rows, features, s.bins)
    base = mean if s.loss == "squared" else math.log(max(mean, 1e-6) / max(1 - mean, 1e-6))
    folder = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
    trees: list[Tree] = []
    try:
        path = f"{folder}/0"
        rows.mapInArrow(_binned(features, edges, base), _ROWS).write.parquet(path)
        table, fresh = spark.read.schema(_ROWS).parquet(path), []
        bound, bounded = max(high - base, base - low) if s.loss == "squared" else 1.0, 0
        for number in range(s.trees):
            if len(fresh) == KEPT:
                old, path = path, f"{folder}/{number}"
                table.mapInArrow(_moved(fresh, s.step, k), _ROWS).write.parquet(path)
                table, fresh = spark.read.schema(_ROWS).parquet(path), []
                remove(spark, old)
                if s.loss == "squared" and number - bounded >= BOUNDED:
                    bound, bounded = table.agg(F.max(F.abs(F.col("margin") - F.col("y")))).first()[0], number
            factors = whole(s.loss, n, bound)
            rng = np.random.default_rng([s.seed, number])
            columns = np.sort(rng.permutation(k)[: max(1, round(s.column_share * k))])

            def histograms(tree, wanted, number=number, factors=factors, table=table, fresh=fresh):
                sums = table.mapInArrow(_histograms(fresh, tree, number, wanted, k, s, factors), "node int, part long, m binary")
                sums = added(sums, ["node"], ["m"], table.rdd.getNumPartitions())
                by = {r.node: np.frombuffer(r.m, float).reshape(k, PLACES, 3) for r in sums.collect()}  # a row a wanted node
                none = np.zeros((k, PLACES, 3))
                return [by.get(w, none) / [*factors, 1.0] for w in wanted]

            tree = grow(histograms, k, s, columns)
            trees.append(tree)
            fresh.append(tree)
            if s.loss == "squared":
                bound *= 1 + s.step  # no leaf's value is above the greatest gradient
    finally:
        remove(spark, folder)
    return Boosted(features, edges, base, s, trees)


def score(model: Boosted, frame: pd.DataFrame) -> np.ndarray:
    bins = bin_rows(frame, model.features, model.edges)
    margin = np.full(len(frame), model.base)
    for t in model.trees:
        margin = margin + model.settings.step * t.values(bins)
    return margin if model.settings.loss == "squared" else 1 / (1 + np.exp(-margin))


def predicted(model: Boosted) -> Column:
    @F.pandas_udf("double")
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(score(model, frame))

    return run(F.struct(*(F.col(x).cast("double").alias(x) for x in model.features)))


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_y", predicted(model) if model.features else F.lit(model.base))


def importance(model: Boosted) -> list[tuple[float, int]]:
    """(sum of gains, number of splits) of each feature."""
    gain, count = np.zeros(len(model.features)), np.zeros(len(model.features), int)
    for t in model.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                gain[f] += g
                count[f] += 1
    return list(zip(map(float, gain), map(int, count), strict=True))
