"""Rewards, selection by added score and the strict path against plain loops and by hand."""

import itertools
import os
from datetime import date, timedelta

import numpy as np
import pytest

from quantloom.functions import tables as T
from quantloom.operators import calendar, candidates, portfolio
from quantloom.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for d in range(24):
        x = rng.standard_normal((15, 4))
        y = 0.5 * x[:, 0] + 0.3 * x[:, 1] + 0.1 * x[:, 2] + rng.standard_normal(15)
        out += [(date(2020, 1, 1) + timedelta(d), i, *map(float, x[i]), float(y[i])) for i in range(15)]
    return out


WINDOWS = [(date(2020, 1, 10), date(2020, 1, 11), date(2020, 1, 14)), (date(2020, 1, 14), date(2020, 1, 15), date(2020, 1, 20))]
NAMES = ["a", "b", "c", "d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, instrument_id int, a double, b double, c double, d double, y double")


def plain_scores(rows, names):
    """The same by loops: ridge on standardised columns, mean correlation by date."""
    at, out = [2 + NAMES.index(n) for n in names], []
    for end, start, stop in WINDOWS:
        train = np.array([[r[i] for i in (*at, 6)] for r in rows if r[0] <= end])
        x, y = train[:, :-1], train[:, -1]
        dev = x.std(0, ddof=1)
        z = (x - x.mean(0)) / dev
        coef = np.linalg.solve(z.T @ z + np.eye(len(at)), z.T @ (y - y.mean())) / dev
        days = sorted({r[0] for r in rows if start <= r[0] <= stop})
        out.append(np.mean([np.corrcoef(np.array([[r[i] for i in at] for r in rows if r[0] == d]) @ coef, [r[6] for r in rows if r[0] == d])[0, 1] for d in days]))
    return out


def test_scores_of_subsets_follow_from_moments(spark, rows):
    dates, sums = candidates.moments(frame(spark, rows), NAMES)
    for size in (1, 2, 4):
        for names in itertools.combinations(NAMES, size):
            got = candidates.window_scores(dates, sums, [1 + NAMES.index(n) for n in names], WINDOWS)
            assert np.abs(np.array(got) - plain_scores(rows, names)).max() < 1e-9


def test_forward_selection_against_loops(spark, rows):
    families = {"b": "x+y", "c": "Y", "d": "z"}
    got = [(r.candidate, r.gain) for r in candidates.forward_selection(frame(spark, rows), ["a"], families, WINDOWS, 3, overlap=0.01, redundancy=0.02, least=-1.0).orderBy("step").collect()]
    stable = lambda names: (lambda s: np.mean(s) - 0.5 * np.std(s))(np.array(plain_scores(rows, names)))
    x = np.array([r[2:6] for r in rows])
    corr = np.abs(np.corrcoef(x.T))
    split = {"b": {"x", "y"}, "c": {"y"}, "d": {"z"}}
    taken, want = [], []
    for _ in range(3):
        best = None
        for c in families:
            if c not in taken:
                gain = stable(["a", *taken, c]) - stable(["a", *taken])
                gain -= 0.01 * any(split[c] & split[t] for t in taken)
                gain -= 0.02 * max([corr[NAMES.index(c), NAMES.index(t)] for t in taken], default=0)
                if best is None or gain > best[0]:
                    best = gain, c
        taken.append(best[1])
        want.append((best[1], best[0]))
    assert [c for c, _ in got] == [c for c, _ in want] and np.abs(np.array([g for _, g in got]) - [g for _, g in want]).max() < 1e-9
    alone = {r.candidate: r.gain for r in candidates.add_one_scores(frame(spark, rows), ["a"], ["b", "c", "d"], WINDOWS).collect()}
    assert all(abs(alone[c] - (np.mean(plain_scores(rows, ["a", c])) - np.mean(plain_scores(rows, ["a"])))) < 1e-9 for c in "bcd")
    steps = candidates.audit_steps(frame(spark, rows), ["a"], ["b"], date(2020, 1, 20)).collect()
    assert [r.step for r in steps] == [0, 1] and all(-1 <= r.ic <= 1 for r in steps)


def test_rewards_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.6, 9.0, 2.0, 0.5, 0.3), (None, float("nan"), 0.4, None, None, None, None)], "t_pearson_ic_mean double, t_spearman_ic_mean double, t_pearson_ic_positive_ratio double, t_pearson_ic_ir double, complexity double, t_max_signal_corr_abs double, financial_logic_score double")
    a, b = (r[0] for r in df.select(candidates.reward(df, "predictive_ic", "t_")).collect())
    assert abs(a - (0.1 + 0.1 + 0.05 * 0.1 + 0.02 * 0.3 - 0.003 - 0.03 * 0.5)) < 1e-12 and b == 0
    a, b = (r[0] for r in df.select(candidates.reward(df, "incremental_proxy", "t_")).collect())
    assert abs(a - (0.025 + 0.15 + 0.025 * 3 + 0.04 * 0.1 + 0.04 * 0.3 - 0.012 - 0.12 * 0.5)) < 1e-12 and b == 0
    score = lambda name: [r[0] for r in df.select(candidates.metric_score(df, name)).collect()]
    assert score("t_pearson_ic_mean") == [0.1, -1e9] and score("nothing") == [-1e9, -1e9]
    with pytest.raises(ValueError):
        candidates.reward(df, "other")


def test_strict_features_see_no_later_dates(spark, rows):
    made = lambda df: df.withColumn("seen", df.a * 0 + 1)
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    made = lambda df: df.withColumn("upto", F.max("date").over(Window.partitionBy("instrument_id").orderBy("date").rowsBetween(-1000, 0))).withColumn("n", F.count("*").over(Window.partitionBy("instrument_id")))
    df = frame(spark, rows)
    train, test = candidates.strict_features(df, made, 3, history=4)
    first = test.agg(F.min("date")).first()[0]
    assert train.agg(F.max("date")).first()[0] < first and train.where("upto > date").isEmpty() and test.where("upto > date").isEmpty()
    days = sorted({r[0] for r in rows})
    later = [d for d in days if d >= first]
    assert {r.n for r in train.select("n").distinct().collect()} == {len(days) - len(later) - 3}  # purged rows teach nothing
    assert {r.n for r in test.select("n").distinct().collect()} == {len(later) + 4}  # and four rows of history


def test_strict_group_gives_test_predictions(spark, rows):
    made = lambda df: df
    out, scores, weights = candidates.strict_group(frame(spark, rows), made, NAMES, {"ridge": [{"alpha": 1.0}], "lasso": [{"alpha": 1e-3}]}, 1, folds=2)
    days = sorted({r[0] for r in rows})[19:]
    assert {r.date for r in out.collect()} == set(days) and out.count() == 15 * len(days)
    assert scores.count() == 4 and abs(sum(r.weight for r in weights.collect()) - 1) < 1e-9


def test_grid_equals_single_ledgers(spark):
    rng = np.random.default_rng(5)
    panel, price = [], {i: 10.0 for i in range(12)}
    for d in range(30):
        for i in price:
            price[i] *= 1 + 0.02 * rng.standard_normal()
            panel.append((date(2020, 1, 1) + timedelta(d), i, price[i], float(rng.random()), "s", 1.0))
    df = spark.createDataFrame(panel, "date date, instrument_id int, close double, predicted_y double, sector string, market_cap double")
    market = portfolio.market_snapshot(df)
    scored = portfolio.merge_predictions(df.select("date", "instrument_id", "predicted_y"), market)
    cells = [portfolio.Config(hold=h, step=s, top_k=k) for h, s, k in ((3, 1, 2), (5, 2, 3), (4, 4, 2))]
    got = {r.cell: r.total_return for r in portfolio.grid(scored, market, cells).collect()}
    assert all(abs(got[i] - portfolio.summarize(portfolio.ledger(scored, market, c)).first().total_return) < 1e-12 for i, c in enumerate(cells))


def test_small_merges(spark, tmp_path):
    p = spark.createDataFrame([(date(2020, 1, 1), 1, 0.5, 0.0), (date(2020, 1, 1), 2, 0.6, 0.0)], "date date, instrument_id int, predicted_y double, y double")
    got = tables.with_actuals(p, p.where("instrument_id = 1").withColumn("y", p.predicted_y).unionByName(p.where("instrument_id = 1")))
    assert sorted((r.instrument_id, r.y) for r in got.na.fill(-1.0).collect()) == [(1, 0.5), (2, -1.0)]
    events = spark.createDataFrame([(1, date(2019, 12, 1), 7.0)], "instrument_id int, effective_date date, eps double")
    p.write.parquet(f"{tmp_path}/p")
    events.write.parquet(f"{tmp_path}/e")
    tables.merge_fundamentals_files(spark, f"{tmp_path}/p", f"{tmp_path}/e", f"{tmp_path}/o", ["eps"])
    assert sorted((r.instrument_id, r.eps or 0) for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [(1, 7.0), (2, 0)]
    g = spark.createDataFrame([(10, 20, 20.0, 1.0), (5, 20, 20.0, 2.0)], "hold int, top_k int, cost_bps double, sharpe double")
    assert candidates.grid_slice(g).count() == 1 and candidates.anomaly_columns(g, ["hold", "x"]).columns == ["hold"]
    assert candidates.compact(g, {"sharpe": "s"}).columns == ["s"]
    signed = candidates.signed_columns(p, spark.createDataFrame([("predicted_y", -1)], "candidate string, direction int"))
    assert sorted(r.res_predicted_y for r in signed.collect()) == [-0.6, -0.5]


def test_shared_folder_of_a_cluster_must_be_set(spark):
    class Conf:
        def __init__(self, base):
            self.base = base

        def get(self, name, default=None):
            return self.base

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf(None)

    class Session:
        sparkContext, conf = Context(), Conf(None)

    with pytest.raises(RuntimeError):
        T.shared_folder(Session())
    Session.conf = Conf("/shared/x/")
    assert T.shared_folder(Session()) == "/shared/x" and os.path.isdir(T.shared_folder(spark))
    assert T.stored(spark.range(3)).count() == 3 and calendar is not None
