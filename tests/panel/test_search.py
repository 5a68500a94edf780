"""Candidate search at scale against plain loops: linear grids, selection by any metric, correlations, choices, noise."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import alpha_scores, candidates, linear_grid, signals

KEYS = ["date", "instrument_id"]
FEATURES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(40)]
    rows = []
    for i in range(12):
        for t, d in enumerate(days):
            if rng.random() < 0.9:
                x = rng.normal(size=4) * [1, 5, 0.2, 1] + [0, 1e6, 3, 0]
                y = 0.5 * x[0] - 0.3 * (x[1] - 1e6) / 5 + 0.4 * x[2] * (t > 20) + rng.normal()
                rows.append((d, i, *map(float, x), float(y) if rng.random() < 0.95 else None))
    return pd.DataFrame(rows, columns=["date", "instrument_id", *FEATURES, "y"])


@pytest.fixture(scope="module")
def panel(spark, frame):
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "date date, instrument_id long, f0 double, f1 double, f2 double, f3 double, y double").repartition(5)


def train_rows(frame, end, horizon):
    own = frame[frame.date <= end].sort_values(["instrument_id", "date"])
    if horizon:
        own = own[own.groupby("instrument_id").cumcount(ascending=False) >= horizon]
    return own.dropna()


def loop_fit(train, columns, model, alpha, share=0.5):
    x, y = train[columns].to_numpy(), train.y.to_numpy()
    m, d = x.mean(0), x.std(0, ddof=1)
    z, n = (x - m) / d, len(y)
    if model == "ridge":
        w = np.linalg.solve(z.T @ z + alpha * np.eye(len(columns)), z.T @ (y - y.mean()))
    else:
        share = 1.0 if model == "lasso" else share
        w = np.zeros(len(columns))
        for _ in range(4000):  # proximal gradient, not coordinates
            step = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + alpha)
            g = z.T @ (z @ w - (y - y.mean())) / n + alpha * (1 - share) * w
            w = w - step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * alpha * share, 0)
    return lambda f: y.mean() + (f[columns].to_numpy() - m) / d @ w


def loop_metrics(valid, predict, groups):
    valid = valid.dropna().sort_values(["date", "instrument_id"])
    p = predict(valid)
    ic, rank, days = [], [], []
    for d in sorted(valid.date.unique()):
        own = (valid.date == d).to_numpy()
        a, b = pd.Series(p[own]), pd.Series(valid.y.to_numpy()[own])
        ic.append(a.corr(b))
        rank.append(a.rank().corr(b.rank()))
        g = np.ceil(a.rank(method="first") / len(a) * groups)
        days.append(b.groupby(g).mean())
    mean = pd.concat(days, axis=1).mean(axis=1)
    e = p - valid.y.to_numpy()
    return {"pearson_ic_mean": np.mean(ic), "spearman_ic_mean": np.mean(rank), "rmse": math.sqrt((e * e).mean()), "mae": np.abs(e).mean(), "long_short_return": mean.iloc[-1] - mean.iloc[0]}


def loop_score(m, metric):
    if metric == "composite_ic_rank_ls":
        return sum(w * m[x] for x, w in candidates.COMPOSITE.items())
    return -m[metric] if metric in candidates.LESS_IS_BETTER else m[metric]


def test_penalty_grid_against_loops(panel, frame):
    models = {"ridge": [{"alpha": 1.0}, {"alpha": 50.0}], "lasso": [{"alpha": 0.05}, {"alpha": 0.3}], "elastic_net": [{"alpha": 0.2, "l1_ratio": 0.4}]}
    got = {(r.fold, r.model, r.candidate): r for r in linear_grid.penalty_grid(panel, FEATURES, models, 3, 2, 4).collect()}
    days = sorted(frame.date.unique())
    assert len(got) == 3 * 5
    for fold in (1, 2, 3):
        e = len(days) - (4 - fold) * (len(days) // 4)
        train, valid = train_rows(frame, days[e - 1], 2), frame[(frame.date > days[e - 1]) & (frame.date <= days[e + len(days) // 4 - 1])]
        for model, sets in models.items():
            for k, p in enumerate(sets):
                want = loop_metrics(valid, loop_fit(train, FEATURES, model, p["alpha"], p.get("l1_ratio", 0.5)), 4)
                for name, x in want.items():
                    assert got[fold, model, k][name] == pytest.approx(x, abs=2e-6), (fold, model, k, name)


@pytest.mark.parametrize("metric", ["composite_ic_rank_ls", "rmse", "spearman_ic_mean"])
def test_forward_selection_by_metric_against_loops(panel, frame, metric):
    days = sorted(frame.date.unique())
    windows = [(days[17], days[19], days[27]), (days[26], days[28], days[39])]
    pool = {"f1": "a+b", "f2": "b", "f3": "c"}
    options = {"penalty": 0.4, "overlap": 0.02, "redundancy": 0.05, "least": -1.0}

    def scores(columns):
        return np.array([loop_score(loop_metrics(frame[(frame.date >= a) & (frame.date <= b)], loop_fit(train_rows(frame, e, 1), columns, "ridge", 2.0), 3), metric) for e, a, b in windows])

    stable = lambda s: s.mean() - options["penalty"] * s.std()
    corr = train_rows(frame, windows[-1][0], 1)[FEATURES].corr().abs()
    at, want = ["f0"], []
    now, score = scores(at), stable(scores(at))
    alone = {c: scores(["f0", c]) for c in pool}
    for step in (1, 2, 3):
        tried = []
        for c in pool:
            if c in at:
                continue
            s, taken = scores([*at, c]), at[1:]
            near = max((corr.loc[c, t] for t in taken), default=0.0)
            kin = 0.02 if any(set(pool[c].split("+")) & set(pool[t].split("+")) for t in taken) else 0.0
            tried.append((stable(s) - kin - 0.05 * near, c, s))
        value, c, s = max(tried, key=lambda x: x[0])
        want.append((step, c, value, value - score, np.mean(s - now > -1.0)))
        at, now, score = [*at, c], s, value
    got = linear_grid.forward_by_metric(panel, ["f0"], pool, windows, 3, metric, "ridge", 2.0, horizon=1, groups=3, **options).orderBy("step").collect()
    assert [(r.step, r.candidate) for r in got] == [w[:2] for w in want]
    for r, w in zip(got, want, strict=True):
        assert (r.score, r.gain, r.positive_ratio) == (pytest.approx(w[2], abs=1e-6), pytest.approx(w[3], abs=1e-6), w[4])
    one = {r.candidate: r for r in linear_grid.add_one(panel, ["f0"], list(pool), windows, metric, "ridge", 2.0, 0.4, 1, 3).collect()}
    first = scores(["f0"])
    for c, s in alone.items():
        assert (one[c].score_mean, one[c].score_min, one[c].gain) == (pytest.approx(s.mean(), abs=1e-6), pytest.approx(s.min(), abs=1e-6), pytest.approx(stable(s) - stable(first), abs=1e-6))


def test_limits_of_forward_selection(panel, frame):
    days = sorted(frame.date.unique())
    windows, pool = [(days[20], days[22], days[39])], {"f1": "a", "f2": "a", "f3": "a"}
    run = lambda **o: [r.candidate for r in linear_grid.forward_by_metric(panel, ["f0"], pool, windows, 3, groups=3, least=o.pop("least", -1.0), **o).orderBy("step").collect()]
    assert len(run()) == 3 and len(run(per_family=1)) == 1 and len(run(most_corr=-1.0)) == 1 and run(least=9.0) == [] and run(positive=1.5) == []
    assert linear_grid.forward_by_metric(panel.where("f0 > 1e9"), [], pool, windows, 2).collect() == []


def test_sums_of_windows_without_rows(panel):
    assert linear_grid.penalty_grid(panel.where("f0 > 1e9"), FEATURES, {"ridge": [{"alpha": 1.0}]}).collect() == []
    assert linear_grid.param_candidates({"alpha": 1}, [{"alpha": 2}, {"l1_ratio": 0.1}]) == [{"alpha": 2}, {"alpha": 1, "l1_ratio": 0.1}]
    assert linear_grid.param_candidates(None, None) == [{}]


def test_many_signals_by_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 9))
    x = base @ rng.normal(size=(9, 70)) + 0.3 * rng.normal(size=(300, 70))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 5] = 1.0
    names = [f"s{i:02d}" for i in range(70)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(37)
    want = pd.DataFrame(x, columns=names).corr()
    for block in (16, 256):
        got = {(r.a, r.b): r.corr for r in signals.correlation_edges(df, names, 0.6, block).collect()}
        pairs = {(a, b): want.loc[a, b] for i, a in enumerate(names) for b in names[i + 1 :] if abs(want.loc[a, b]) > 0.6}
        assert set(got) == set(pairs) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in pairs.items())
    rng = random.Random(3)
    pool = [(n, float(rng.randrange(20))) for n in names]
    kept, close = [], {}
    for n, _ in sorted(pool, key=lambda p: (-p[1], p[0])):
        near = next((k for k in kept if (k, n) in pairs or (n, k) in pairs), None)
        close[n] = near
        if near is None:
            kept.append(n)
    rows = signals.greedy_rounds(spark.createDataFrame(pool, "candidate_id string, score double"), signals.correlation_edges(df, names, 0.6)).collect()
    assert {r.candidate_id: (r.kept, r.close_to) for r in rows} == {n: (close[n] is None, close[n]) for n in names}
    most = {r.candidate_id: r.max_signal_corr_abs for r in signals.uniqueness(df, names, 16).collect()}
    assert most["s05"] == 0.0 and all(most[n] == pytest.approx(want[n].drop(n).abs().max(), abs=1e-9) for n in names if n != "s05")


def test_noise_is_counted_not_drawn(spark):
    rows = spark.range(4000).select(F.lit("c").alias("factor"), F.lit(date(2021, 1, 1)).alias("date"), F.col("id").alias("instrument_id"), F.lit(0.0).alias("y"), (F.col("id") % 7).cast("double").alias("value"))
    pick = lambda df: {(r.variant, r.instrument_id): r.value for r in df.collect()}
    one, two = pick(alpha_scores.variants(rows, 0.5, 0.3, 9)), pick(alpha_scores.variants(rows.repartition(11), 0.5, 0.3, 9))
    assert one == two and one != pick(alpha_scores.variants(rows, 0.5, 0.3, 8))
    noise = np.array([one["gaussian", i] - i % 7 for i in range(4000)]) / (0.5 * np.std(np.arange(4000) % 7))
    assert abs(noise.mean()) < 0.06 and abs(noise.std() - 1) < 0.05 and abs((np.abs(noise) < 1).mean() - 0.683) < 0.03
    assert abs(sum(one["dropout", i] is None for i in range(4000)) / 4000 - 0.3) < 0.03
    assert all(one["base", i] == i % 7 for i in range(4000))


def _traded(spark):
    from quantloom.operators import portfolio

    rng = np.random.default_rng(9)
    days = [date(2021, 1, 1) + timedelta(days=i) for i in range(30)]
    market = [(d, i, "abc"[i % 3], float(rng.normal() / 50), float(abs(rng.normal())) + 0.1) for d in days for i in range(24)]
    market = spark.createDataFrame(market, "date date, instrument_id long, sector string, daily_close_return double, realized_vol_20 double")
    scores = market.select("date", "instrument_id", (F.hash("date", "instrument_id") % 97).cast("double").alias("predicted_y"), F.lit(0.0).alias("y"))
    return portfolio.merge_predictions(scores, market), market


def test_grid_of_many_cells_is_the_ledgers_one_by_one(spark):
    from quantloom.operators import portfolio

    rows, market = _traded(spark)
    cells = [portfolio.Config(hold=h, step=2, delay=1, top_k=k, cost_bps=c, neutral=n, weights=w, cap=cap, clock=clock) for h, clock in ((3, "signal_horizon"), (5, "execution_horizon")) for k in (2, 4) for n in (False, True) for c, w, cap in ((0.0, "equal", None), (20.0, "rank", 0.3), (20.0, "score_vol", None))]
    got = {r.cell: r for r in portfolio.grid(rows, market, cells).collect()}
    assert len(got) == len(cells) == 24
    for i in (0, 4, 5, 11, 14, 22, 23):
        one = portfolio.summarize(portfolio.ledger(rows, market, cells[i])).first()
        assert all(got[i][x] == pytest.approx(one[x], abs=1e-12) for x in ("total_return", "sharpe", "max_drawdown", "transaction_cost", "n_days", "gross_exposure"))


def test_scans_of_a_grid_do_not_grow_with_its_cells(spark):
    from quantloom.operators import portfolio

    rows, market = _traded(spark)
    many = [portfolio.Config(hold=h, step=2, delay=1, top_k=k, cost_bps=c, neutral=n) for h in (3, 4, 5, 6) for k in (1, 2, 3, 4) for c in (0.0, 20.0) for n in (False, True)]
    some = [many[0], many[1]]
    count = lambda cells: portfolio.ledgers(rows, market, cells)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert len(many) == 64 and count(many) == count(some)


def test_books_of_many_kinds_are_those_of_each(spark):
    from quantloom.operators import portfolio

    rows, _ = _traded(spark)
    kinds = [(k, n) for k in (1, 3, 5, 12) for n in (False, True)]
    got = portfolio.all_books(rows.where("instrument_id <> 7"), kinds).toPandas()
    for k, n in kinds:
        own = got[(got.top_k == k) & (got.neutral == n)]
        if k == 12:
            assert len(own) == 0  # 23 names are fewer than two books
            continue
        for d, f in rows.where("instrument_id <> 7").toPandas().groupby("date"):
            book = own[own.date == d]
            assert (book.side == "long").sum() == (book.side == "short").sum() == k
            if not n:
                order = f.sort_values(["predicted_y", "instrument_id"], ascending=[False, True])
                assert set(book[book.side == "long"].instrument_id) == set(order.instrument_id[:k])


def test_stored_tables_go_with_their_block(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from quantloom.functions import tables

    shared = tmp_path / "shared"
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(shared))
    for name in ("signal_edges", "penalty_grid", "long_short_summary", "staged_scores", "relation_centrality"):
        with tables.released(spark):
            __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "out" / name))
            assert list(shared.glob("stored-*"))
        assert not list(shared.glob("stored-*")) and spark.read.parquet(str(tmp_path / "out" / name)).count() > 0


@pytest.mark.parametrize("metric", ["composite_ic_rank_ls", "rmse"])
def test_individual_audit(panel, frame, metric):
    window = (date(2020, 1, 20), date(2020, 1, 23), date(2020, 2, 9))
    got = linear_grid.individual_audit(panel, ["f0"], ["f2", "f1"], window, metric, horizon=1, groups=4, least=0.01).orderBy("rank").collect()
    assert [r.candidate for r in got] == ["", "f2", "f1"]
    own = frame.dropna(subset=FEATURES[:3] + ["y"])
    train = train_rows(frame[[*KEYS, *FEATURES[:3], "y"]], window[0], 1)
    valid = own[(own.date >= window[1]) & (own.date <= window[2])]
    want = [loop_score(loop_metrics(valid, loop_fit(train, ["f0", *more], "ridge", 1.0), 4), metric) for more in ([], ["f2"], ["f1"])]
    for r, score in zip(got, want, strict=True):
        assert r.oos_selection_score == pytest.approx(score, abs=1e-7)
        assert r.delta_vs_baseline == pytest.approx(score - want[0], abs=1e-7)
        assert r.improves_baseline == (score > want[0] + 0.01)
