"""Exact, metamorphic and leakage checks of the panel operators on small frames."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions import expression as E
from quantloom.operators import calendar, compare, diagnostics, factors, features, formulas, joins, models, portfolio, preprocess, quality_audit, relation
from quantloom.plans import queries
from quantloom.sources import panel_io

DAYS = [d.date() for d in pd.bdate_range("2024-01-01", periods=45)]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, name in enumerate("ABC"):
        price = 50.0
        for d in DAYS:
            price *= float(np.exp(rng.normal(0, 0.02)))
            o, c = price * (1 + rng.normal(0, 0.005)), price
            h, low = max(o, c) * 1.01, min(o, c) * 0.99
            v = float(rng.integers(1000, 5000))
            rows.append((name, d, o, h, low, c, v, (h + low + c) / 3, c * v, 1.0, 1e6 * (k + 1), "XY"[k % 2]))
    return spark.createDataFrame(rows, "instrument_id string, date date, open double, high double, low double, close double, volume double, vwap double, turnover double, adjustment double, market_cap double, sector string").persist()


def test_label_does_not_jump_over_a_missing_date(spark):
    rows = [("A", d, 10.0 + i) for i, d in enumerate(DAYS[:5])] + [("B", d, 20.0 + i) for i, d in enumerate(DAYS[:5]) if i != 2]
    out = calendar.add_forward_returns(spark.createDataFrame(rows, "instrument_id string, date date, close double"), [1])
    got = {(r.instrument_id, r.date): r.y_1d for r in out.collect()}
    assert got["B", DAYS[1]] is None and abs(got["A", DAYS[1]] - (12 / 11 - 1)) < 1e-12 and got["A", DAYS[4]] is None


def test_canonical_factors_ignore_the_price_unit(panel):
    scale = F.when(F.col("instrument_id") == "A", 0.1).when(F.col("instrument_id") == "B", 7.0).otherwise(125.0)
    scaled = panel.withColumns({x: F.col(x) * scale for x in ("open", "high", "low", "close", "vwap", "turnover")})
    a, b = (factors.factors(x, factors.CANONICAL).orderBy("instrument_id", "date").toPandas() for x in (panel, scaled))
    for x in factors.CANONICAL:
        np.testing.assert_allclose(a[x], b[x], rtol=1e-7, atol=1e-9)


def test_unknown_and_empty_factor_lists(panel):
    assert factors.factors(panel, []).columns == ["instrument_id", "date"]
    with pytest.raises(ValueError):
        factors.factors(panel, ["alpha030"])
    assert len(factors.FACTORS) == 176


def test_decay_renormalises_over_present_values(spark):
    df = spark.createDataFrame([("A", DAYS[0], 1.0), ("A", DAYS[1], None), ("A", DAYS[2], 3.0)], "instrument_id string, date date, x double")
    out = E.evaluate(df, {"d": E.decay(E.field("x"), 3), "s": E.sma(E.field("x"), 3, 1)}).orderBy("date").collect()
    assert out[2].d == 2.5
    want = pd.Series([1.0, np.nan, 3.0]).ewm(alpha=1 / 3, adjust=False).mean().tolist()
    assert [r.s for r in out] == pytest.approx(want)


def test_purge_and_folds(panel):
    train, test = calendar.split(panel)
    left = calendar.purge(train, 5)
    assert train.count() - left.count() == 15 and left.agg(F.max("date")).first()[0] == sorted({r.date for r in train.collect()})[-6]
    walk = calendar.walk_forward(panel, 3, 5).collect()
    for fold in (1, 2, 3):
        a = [r.date for r in walk if r.fold == fold and r.part == "train"]
        b = [r.date for r in walk if r.fold == fold and r.part == "valid"]
        assert max(a) < min(b) and len(set(b)) == 11 and DAYS.index(min(b)) - DAYS.index(max(a)) == 6


def test_holding_windows(panel):
    a = calendar.holding_windows(panel, 5, 1).orderBy("signal_date").first()
    b = calendar.holding_windows(panel, 5, 1, "execution_horizon").orderBy("signal_date").first()
    assert (a.execution_date, a.end_date, a.days) == (DAYS[1], DAYS[5], 4) and (b.end_date, b.days) == (DAYS[6], 5)


def test_preprocessing_twice_keeps_the_raw_size_exposure(panel):
    once = preprocess.preprocess(panel, ["volume"])
    twice = preprocess.preprocess(once, ["volume"])
    assert twice.select("market_cap").distinct().count() == 3 and once.columns == panel.columns


def test_neutral_residuals_match_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 40
    rows = [(f"i{i}", DAYS[0], float(rng.normal()), float(np.exp(rng.normal(10, 1))), "XYZ"[i % 3]) for i in range(n)]
    df = spark.createDataFrame(rows, "instrument_id string, date date, x double, market_cap double, sector string")
    got = preprocess.neutralize(df, ["x"]).toPandas().set_index("instrument_id")["x"]
    p = pd.DataFrame(rows, columns=["i", "d", "x", "m", "s"]).set_index("i")
    z = np.log(p.m)
    a = np.column_stack([np.ones(n), (z - z.mean()) / z.std(ddof=0), pd.get_dummies(p.s, drop_first=True).astype(float)])
    want = p.x - a @ np.linalg.lstsq(a, p.x, rcond=None)[0]
    np.testing.assert_allclose(got[p.index], want, atol=1e-9)


def test_quota_remainders_and_caps(spark):
    rows = [(DAYS[0], f"i{i:02d}", float(i), s) for i, s in enumerate("A" * 7 + "B" * 5 + "C" * 2 + "D")]
    df = spark.createDataFrame(rows, "date date, instrument_id string, predicted_y double, sector string")
    got = {r.sector: r.quota for r in portfolio.sector_quotas(df, 5).collect()}
    assert got == {"A": 3, "B": 2} or sum(got.values()) == 5
    book = portfolio.books(df, 5, True).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in book} == {"long": 5, "short": 5}


def test_capped_weights(spark):
    rows = [(DAYS[0], f"i{i}", float(x), "long") for i, x in enumerate([8, 4, 2, 1, 1])]
    df = spark.createDataFrame(rows, "date date, instrument_id string, predicted_y double, side string")
    got = [r.weight for r in portfolio.side_weights(df, "rank", 0.3).orderBy(F.desc("weight"), "instrument_id").collect()]
    assert abs(sum(got) - 1) < 1e-12 and max(got) <= 0.3 + 1e-12 and got[0] == got[1] == pytest.approx(0.3) if got[1] > 0.299 else max(got) <= 0.3 + 1e-12


def test_round_trip_costs(spark):
    df = spark.createDataFrame([(DAYS[0], "A", 1.0), (DAYS[0], "B", -1.0)], "date date, instrument_id string, weight double")
    s = portfolio.trade_summary(df, portfolio.Config(cost_bps=20.0)).first()
    assert s.gross_turnover == 4.0 and s.turnover_cost_bps == pytest.approx(80.0)
    half = portfolio.scale_to_portfolio(portfolio.trade_summary(df, portfolio.Config(hold=5, step=2)), portfolio.Config(hold=5, step=2), ["gross_turnover"]).first()
    assert half.gross_turnover == 2.0 and half.sleeve_gross_turnover == 4.0


def test_ledger_keeps_cash_days(panel):
    df = panel.select("date", "instrument_id", F.lit(0.0).alias("y"), F.col("volume").alias("predicted_y"))
    market = portfolio.market_snapshot(panel)
    out = portfolio.ledger(portfolio.merge_predictions(df, market), market, portfolio.Config(hold=3, step=10, top_k=1, cost_bps=20.0)).orderBy("date").toPandas()
    assert (out.gross_exposure == 0).sum() > 0 and len(out) == DAYS.index(out.date.max()) - DAYS.index(out.date.min()) + 1
    assert out.transaction_cost[0] == pytest.approx(0.004) and out.long_gross_return[0] == 0
    assert out.nav.iloc[-1] == pytest.approx((1 + out.net_return).prod())


def test_incomplete_sleeves_are_skipped_whole(panel):
    gap = panel.where(~((F.col("instrument_id") == "A") & (F.col("date") == F.lit(DAYS[3]))))
    market = portfolio.market_snapshot(gap)
    rows = portfolio.merge_predictions(gap.select("date", "instrument_id", F.lit(0.0).alias("y"), (F.col("instrument_id") == "A").cast("double").alias("predicted_y")), market)
    held = portfolio.held_days(portfolio.sleeves(rows, portfolio.Config(hold=4, step=4, top_k=1)), market)
    assert {r.signal_date for r in portfolio.skipped(held).collect()} == {r.signal_date for r in held.where("not complete").select("signal_date").distinct().collect()} != set()


def test_as_of_uses_what_was_known(spark):
    bars = spark.createDataFrame([("A", d) for d in DAYS[:6]], "instrument_id string, date date")
    f = spark.createDataFrame([("A", DAYS[0], DAYS[2], 1.0), ("A", DAYS[1], DAYS[4], 2.0)], "instrument_id string, report_date date, effective_date date, eps double")
    assert [r.eps for r in joins.as_of(bars, f, ["eps"]).orderBy("date").collect()] == [None, None, 1.0, 1.0, 2.0, 2.0]


def test_availability_is_the_last_source(spark):
    kind = "instrument_id string, report_date date, filing_date date, accepted_date date"
    a = spark.createDataFrame([("A", DAYS[0], None, DAYS[3], 1.0)], f"{kind}, revenue double")
    b = spark.createDataFrame([("A", DAYS[0], DAYS[9], None, 2.0)], f"{kind}, assets double")
    assert joins.statements([a, b]).first().effective_date == DAYS[9]
    c = spark.createDataFrame([("A", DAYS[0], None, None, 2.0)], f"{kind}, assets double")
    assert joins.statements([c]).first().effective_date == DAYS[0] + dt.timedelta(90)


def test_loading_keeps_missing_values(spark):
    df = spark.createDataFrame([("1", "2024-01-02", "1", None, "x", "2", "inf")], "instrument_id string, date string, open string, high string, low string, close string, volume string")
    r = panel_io.load_panel(df).first()
    assert r.open == 1.0 and r.high is None and r.low is None and r.volume is None and r.turnover is None and r.market_cap_source == "missing" and r.date == dt.date(2024, 1, 2)
    with pytest.raises(ValueError):
        panel_io.load_panel(df.drop("close"))


def test_universe_and_wide_tables(spark):
    a = spark.createDataFrame([("brk.b ", "Holding", "N", "N"), ("ETF1", "Fund", "Y", "N"), ("ABCW", "Abc Warrant", "N", "N"), ("T", "Test", "N", "Y")], "symbol string, name string, etf string, test string")
    assert [r.symbol for r in panel_io.universe([a]).collect()] == ["BRK-B"]
    w = spark.createDataFrame([(DAYS[0], 1.0, 2.0, None, None)], "date date, close_A double, volume_A double, close_B double, volume_B double")
    assert [(r.symbol, r.close) for r in panel_io.wide_to_long(w, ["A", "B"], ["close", "volume"]).collect()] == [("A", 1.0)]


def test_audits(panel):
    split = panel.withColumn("adjustment", F.when(F.col("date") >= F.lit(DAYS[20]), 2.0).otherwise(1.0)).withColumn("close", F.when(F.col("date") >= F.lit(DAYS[20]), F.col("close") / 2).otherwise(F.col("close")))
    events = quality_audit.corporate_actions(split).collect()
    assert len(events) == 3 and {r.flag for r in events} == {"raw_jump_explained"}
    short = panel.where((F.col("instrument_id") != "C") | (F.col("date") <= F.lit(DAYS[10])))
    assert "early_end" in {r.instrument_id: r.reasons for r in quality_audit.coverage(short, least=5).collect()}["C"]


def test_formulas_refuse_labels():
    with pytest.raises(ValueError):
        formulas.compile_spec(("rank", "y_5d"))
    assert formulas.fields_of(("blend", ("rank", "close"), "volume", 0.3)) == {"close", "volume"}


def test_zoo_checks_and_greedy_selection(spark):
    zoo = spark.createDataFrame([("a", "close|y"), ("b", "close"), ("b", "volume"), ("c", "other")], "candidate_id string, fields string")
    assert {(r.candidate_id, r.problem) for r in formulas.validate_zoo(zoo, ["close", "volume"]).collect()} == {("a", "forbidden_field"), ("b", "duplicate_id"), ("c", "unknown_field")}
    pool = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 2.0), ("c", "x", 1.0), ("d", "y", 0.5)], "candidate_id string, family string, score double")
    pairs = spark.createDataFrame([("a", "b", 0.95)], "a string, b string, corr double")
    assert [r.candidate_id for r in formulas.greedy_by_correlation(pool, pairs, 0.9, cap=1).where("kept").collect()] == ["a", "d"]


def test_model_weights(spark):
    got = lambda rows: sorted(round(r.weight, 6) for r in models.model_weights(spark.createDataFrame(rows, "model string, score double")).collect())
    assert got([("a", None), ("b", None)]) == [0.5, 0.5] and got([("a", 0.6), ("b", 0.4)]) == [0.45, 0.55]


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    model = models.fit(df, ["a", "b"], "ridge", alpha=5.0)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z + 5.0 * np.eye(2), z.T @ (y - y.mean()))
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), want, rtol=1e-6)


def test_selection_drops_redundant_and_constant(spark):
    from quantloom.operators import selection

    rng = np.random.default_rng(2)
    rows = [(d, f"i{i}", float(v := rng.normal()), v * 2e200, 1.0, float(rng.normal()), v + float(rng.normal())) for d in DAYS[:6] for i in range(12)]
    df = spark.createDataFrame(rows, "date date, instrument_id string, a double, huge double, constant double, b double, y double")
    got = {r.feature: r for r in selection.table(df, ["a", "huge", "constant", "b"]).collect()}
    assert got["a"].kept and got["b"].kept and not got["constant"].kept and not got["huge"].kept and got["huge"].redundant_with == "a"


def test_feature_guards(panel):
    features.check_allowed(["momentum_5"])
    with pytest.raises(ValueError):
        features.check_allowed(["y_1d"])
    assert "adjustment" not in features.safe_columns(panel)


def test_relation_and_comparison_tables(spark):
    assert spark.range(1).select(relation.std_from_sums(F.lit(2.0), F.lit(4.0), F.lit(10.0)).alias("s")).first().s == pytest.approx(1.0)
    df = spark.createDataFrame([("w", "base", 1.0), ("w", "x", 3.0)], "w string, e string, m double")
    assert compare.deltas(df, ["w"], ["m"], "e", "base").first().delta_m == 2.0


def test_quantile_groups_differ_from_ntile(spark):
    df = spark.createDataFrame([(DAYS[0], f"i{i}", float(i)) for i in range(7)], "date date, instrument_id string, x double")
    got = [r.g for r in df.select("x", diagnostics.quantile_group(F.col("x"), 3, "date").alias("g")).orderBy("x").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 3]


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(DAYS[0], f"i{i}", x) for i, x in enumerate([1.0, 2.0, 2.0, None])], "date date, instrument_id string, x double")
    got = [r.p for r in df.select("instrument_id", C.pct_rank(F.col("x")).alias("p")).orderBy("instrument_id").collect()]
    assert got == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, None]) or got[3] is None and got[:3] == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3])


@pytest.mark.parametrize("name", ["panel_month", "ts_weighted", "daily_ic", "preprocess", "long_short_books", "as_of_fundamentals"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "region", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.SQL[name]).df()
    a, b = (x[sorted(x.columns)].assign(**{c: x[c].astype(str) for c in x.columns if "date" in c}) for x in (a, b))
    a, b = (x.sort_values(list(x.columns)).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c].astype(float), rtol=1e-6, atol=1e-9)
        elif "date" in c:
            assert (a[c].str[:10] == b[c].str[:10]).all()
        else:
            assert (a[c] == b[c]).all()
