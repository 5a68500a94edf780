"""Boosted trees against a plain grower: rows in lists, every split tried in turn."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import boosting, models

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 700
    f = pd.DataFrame({"date": pd.to_datetime("2020-01-01") + pd.to_timedelta(np.arange(n) % 50, "D"), "instrument_id": np.arange(n) // 50, "a": rng.normal(size=n), "b": rng.integers(0, 6, n).astype(float), "c": rng.normal(size=n) * 1e6})
    f["y"] = np.sin(2 * f.a) + (f.b > 3) * f.a + 0.3 * rng.normal(size=n)
    f["date"] = f.date.dt.date
    f.loc[rng.random(n) < 0.1, "a"] = np.nan
    f.loc[f.a.isna(), "y"] += 1
    f.loc[rng.random(n) < 0.03, "y"] = np.nan
    return f


def spark_rows(spark, frame, parts):
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, instrument_id long, a double, b double, c double, y double").repartition(parts)


def plain(frame, edges, s, columns_of):
    """Sums of squares gained by each split of each leaf, one row at a time; no histograms, no subtraction, no batches."""
    f = frame.dropna(subset=["y"])
    bins = boosting.bin_rows(f, FEATURES, edges).tolist()
    y = f.y.tolist()
    base = sum(y) / len(y)
    margin, trees = [base] * len(y), []
    score = lambda g, h: g * g / (h + s.squared)
    for number in range(s.trees):
        g = [y[i] - margin[i] for i in range(len(y))]

        def best(rows, depth):
            if s.depth is not None and depth >= s.depth:
                return None
            found = None
            total = sum(g[i] for i in rows)
            for c in columns_of(number):
                for cut in sorted({bins[i][c] for i in rows} - {0}) or [1]:
                    for missing in (False, True):
                        left = [i for i in rows if (missing if bins[i][c] == 0 else bins[i][c] <= cut)]
                        if min(len(left), len(rows) - len(left)) < s.least_rows:
                            continue
                        gl = sum(g[i] for i in left)
                        gain = 0.5 * (score(gl, len(left)) + score(total - gl, len(rows) - len(left)) - score(total, len(rows)))
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-7):
                            found = (gain, left, [i for i in rows if i not in set(left)])
            return found

        start = list(range(len(y)))
        leaves = [(start, 0, best(start, 0))]
        while s.leaves is None or len(leaves) < s.leaves:
            able = [x for x in leaves if x[2] is not None]
            if not able:
                break
            one = max(able, key=lambda x: x[2][0])
            leaves.remove(one)
            leaves += [(side, one[1] + 1, best(side, one[1] + 1)) for side in one[2][1:]]
        for rows, _, _ in leaves:
            v = sum(g[i] for i in rows) / (len(rows) + s.squared)
            for i in rows:
                margin[i] += s.step * v
        trees.append(sorted(len(x[0]) for x in leaves))
    return f, margin, trees


@pytest.mark.parametrize("s", [boosting.Settings(trees=3, step=0.5, leaves=6, least_rows=5, bins=16), boosting.Settings(trees=2, step=0.3, leaves=None, depth=3, least_rows=1, bins=10, column_share=0.6)])
def test_plain_grower(spark, frame, s):
    model = boosting.fit(spark_rows(spark, frame, 5), FEATURES, s)
    columns = lambda number: sorted(np.random.default_rng([s.seed, number]).permutation(3)[: max(1, round(s.column_share * 3))])
    own, margin, _ = plain(frame, model.edges, s, columns)
    assert np.allclose(boosting.score(model, own), margin, atol=1e-7)
    assert all(t.feature.count(-1) <= (s.leaves or 2**s.depth) for t in model.trees)


def test_partitions_do_not_matter(spark, frame):
    s = boosting.Settings(trees=2, leaves=8, bins=32, row_share=0.7)
    one, many = (boosting.fit(spark_rows(spark, frame, p), FEATURES, s) for p in (1, 23))
    assert [t.__dict__ for t in one.trees] == [t.__dict__ for t in many.trees]
    h = np.arange(100_000).astype(np.int64) * 7919
    assert abs(boosting.drawn(h, 0, 1, 0.7).mean() - 0.7) < 0.01
    assert abs((boosting.drawn(h, 0, 1, 0.5) & boosting.drawn(h, 1, 1, 0.5)).mean() - 0.25) < 0.01


def test_margins_stored_anew(spark, frame, monkeypatch):
    s = boosting.Settings(trees=5, leaves=4, bins=16)
    rows = spark_rows(spark, frame, 3)
    whole = boosting.fit(rows, FEATURES, s)
    monkeypatch.setattr(boosting, "KEPT", 2)
    parts = boosting.fit(rows, FEATURES, s)
    assert [t.feature for t in whole.trees] == [t.feature for t in parts.trees]
    assert np.allclose(boosting.score(whole, frame), boosting.score(parts, frame), atol=1e-6)


def test_held_out_error_beside_first_order(spark, frame):
    full = frame.fillna({"a": 0.0})
    train, test = full[full.instrument_id < 10], full[full.instrument_id >= 10]
    rows, held = spark_rows(spark, train, 4), spark_rows(spark, test, 4).where("y is not null")
    error = lambda m: models.regression_metrics(models.predict(m, held)).first().rmse
    second = error(models.fit(rows, FEATURES, "boost_by_leaf", trees=20, step=0.2, leaves=16))
    first = error(models.fit(rows, FEATURES, "gbt", trees=20, step=0.2, depth=4))
    assert second < 1.1 * first and second < 0.75 * held.agg(F.stddev_pop("y")).first()[0]


def test_logistic(spark, frame):
    own = frame.assign(y=(frame.y > 0.3).astype(float))
    model = boosting.fit(spark_rows(spark, own, 3), FEATURES, boosting.Settings(trees=8, step=0.3, leaves=6, loss="logistic"))
    p = boosting.score(model, own)
    assert ((p > 0) & (p < 1)).all() and ((p > 0.5) == (own.y == 1)).mean() > 0.8


def test_edges_of_input(spark):
    kind = "date date, instrument_id long, a double, b double, c double, y double"
    none = boosting.fit(spark.createDataFrame([], kind), FEATURES, boosting.Settings(trees=2))
    assert none.trees == [] and none.base == 0.0
    rows = [(None, i, 1.0, None, float("nan"), float(i % 2)) for i in range(20)]
    flat = boosting.fit(spark.createDataFrame(rows, kind), FEATURES, boosting.Settings(trees=2))
    assert [t.feature for t in flat.trees] == [[-1], [-1]]
    got = boosting.predict(flat, spark.createDataFrame(rows, kind).withColumn("h", F.lit(1))).agg(F.min("predicted_y"), F.max("predicted_y")).first()
    assert got[0] == got[1] == 0.5
    two = boosting.fit(spark.createDataFrame([(None, i, None if i < 5 else 1.0, None, None, float(i < 5)) for i in range(20)], kind), FEATURES, boosting.Settings(trees=1, step=1.0, squared=0.0))
    assert two.trees[0].feature.count(-1) == 2 and [x[1] for x in boosting.importance(two)] == [1, 0, 0]


def test_margins_stored_often_change_nothing(spark, frame, monkeypatch):
    own = frame.copy()
    s = boosting.Settings(trees=5, leaves=4, bins=16)
    rows = spark_rows(spark, own, 4)
    assert boosting.KEPT <= 4  # a pass walks few trees for each row, however many there are
    found = []
    for kept in (boosting.KEPT, 100):
        monkeypatch.setattr(boosting, "KEPT", kept)
        found.append([(t.feature, t.cut, t.missing_left, t.value) for t in boosting.fit(rows, FEATURES, s).trees])
    assert found[0] == found[1]
