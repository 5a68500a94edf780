"""Findings of round 3: halves in SQL's rounding, and plans that put no whole table into one task."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions import expression as E
from quantloom.operators import alpha_scores, diagnostics, preprocess, relation
from quantloom.plans import factor_sql, testpanel
from quantloom.plans.testpanel import tidy_sql


def test_halves_are_rounded_as_sql_does(spark):
    ranks = [(a / 1000, b / 1000, c / 1000) for a in range(5, 1000, 45) for b in range(1, 1000, 61) for c in (250, 333, 475, 990)]
    df = spark.createDataFrame(ranks, "a double, b double, c double")
    got = sorted(tuple(r) for r in df.select("a", "b", "c", C.tidy(-F.col("a") * F.col("b") * F.col("c"))).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE t (a DOUBLE, b DOUBLE, c DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", ranks)
    want = sorted(con.execute(f"SELECT a, b, c, {tidy_sql('(-a * b * c)')} FROM t").fetchall())
    assert got == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _signals(spark):
    return spark.range(60).selectExpr("id % 6 AS instrument_id", "date_add(DATE'2024-01-01', CAST(id DIV 6 AS INT)) AS date", "CAST(hash(id) % 97 AS DOUBLE) AS predicted_y", "CAST(hash(id, 1) % 89 AS DOUBLE) AS y")


def test_book_turnover_numbers_dates_not_rows(spark):
    assert "dense_rank" not in _plan(diagnostics.book_turnover(_signals(spark)))


def test_turnover_numbers_dates_not_rows(spark):
    rows = _signals(spark)
    assert "dense_rank" not in _plan(diagnostics.turnover(rows, ["predicted_y"]))
    assert "dense_rank" not in _plan(diagnostics.factor_summary(rows, ["predicted_y"]))


def test_medians_are_exact_and_hold_no_column_in_one_task(spark):
    rng = np.random.default_rng(5)
    n = 5001
    values = {"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float), "c": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)), "d": np.exp(9 * rng.normal(size=n)), "e": np.arange(n) * 1.0}
    rows = [tuple(None if x == "e" and i % 2 else float(values[x][i]) for x in values) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    names = df.columns
    want = df.agg(*(F.coalesce(F.percentile(x, 0.5), F.lit(0.0)).alias(x) for x in names)).first()
    for accuracy in (1000, 4):
        got = preprocess.medians(df, names, accuracy)
        assert "percentile(" not in _plan(got) and got.first() == want


def test_rows_move_by_phase_and_not_by_layer(spark):
    panel = _signals(spark).selectExpr("instrument_id", "date", "predicted_y AS close", "y AS volume")
    found = {"a": E.rank(E.v), "b": E.rank(E.mean(E.c, 3)), "c": E.rank(E.mean(E.mean(E.c, 3), 3)), "d": E.rank(E.mean(E.sma(E.c, 5), 3))}
    plan = E.evaluate(panel, found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # to instruments, to dates


def _loop_centralities(edges, rounds, damping):
    good = [e for e in edges if e[3] is not None and e[3] > 0]
    total, x = {}, {(d, n): 1.0 for d, s, t, _ in good for n in (s, t)}
    for d, _, t, w in good:
        total[d, t] = total.get((d, t), 0.0) + w
    for _ in range(rounds):
        y = dict.fromkeys(x, 1 - damping)
        for d, s, t, w in good:
            y[d, s] += damping * w / total[d, t] * x[d, t]
        for day in {d for d, _ in x}:
            own = [k for k in x if k[0] == day]
            mean = sum(y[k] for k in own) / len(own)
            x |= {k: y[k] / mean for k in own}
    near = {}
    for d, s, t, w in good:
        near[d, t] = near.get((d, t), 0.0) + w / total[d, t] * x[d, s]
    return {(d, s, t): (x.get((d, s)), near.get((d, t))) for d, s, t, _ in edges}


def test_centralities_make_their_edges_once(spark):
    rng = np.random.default_rng(3)
    rows = [(d, s, t, float(rng.integers(1, 9))) for d in (1, 2, 3) for s in range(12) for t in range(9) if s != t and rng.random() < 0.3]
    rows += [(1, 50, 3, 0.0), (2, 51, 60, -1.0), (3, 52, 4, None)]
    edges = spark.createDataFrame(rows, "date int, source int, target int, weight double").where("source is not null")
    out = relation.with_centralities(edges, rounds=3)
    assert "LogicalRDD" not in _plan(out)  # the edges' own plan is run while the result is built, and not again
    assert "LogicalRDD" in _plan(edges)
    got = {(r.date, r.source, r.target): (r.source_influence_centrality, r.target_neighbor_centrality) for r in out.collect()}
    want = _loop_centralities(rows, 3, 0.85)
    assert got.keys() == want.keys() and out.columns == [*edges.columns, "source_influence_centrality", "target_neighbor_centrality"]
    for k, pair in want.items():
        for a, b in zip(got[k], pair, strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12)


def test_pairs_of_suppliers_move_once(spark, tmp_path):
    from datetime import date

    days = [date(2020, 1, 5), date(2020, 2, 5), date(2020, 4, 5)]
    rng = np.random.default_rng(4)
    lines = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 9)), 1, 2.0, 10.0, 0.1, days[i % 3]) for i in range(200)] + [(999, 1, s, 1, 2.0, 10.0, 0.1, None) for s in range(9)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.createDataFrame([(s, s % 5, 1.0) for s in range(9) if s != 7], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    out = testpanel.edges(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") == 1  # lines are read once: neither sectors nor pairs need a second reading
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = "date, source, target, weight, rank, same_sector"
    want = con.execute(f"WITH {testpanel.panel_sql()}, {testpanel.EDGES_SQL} SELECT {columns} FROM edges").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in out.select(*columns.split(", ")).collect()) and want


def test_candidates_are_measured_where_their_dates_are(spark):
    rows = spark.range(600).selectExpr("CAST(id % 2 AS STRING) AS factor", "date_add(DATE'2024-01-01', CAST(id DIV 100 AS INT)) AS date", "(id DIV 2) % 50 AS instrument_id", "CAST(hash(id) % 97 AS DOUBLE) AS y", "CAST(hash(id, 1) % 89 AS DOUBLE) AS value")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(alpha_scores.daily(alpha_scores.unit_scale(alpha_scores.variants(rows)))) == 2  # the rows, the candidates' deviations
    assert "Join FullOuter" not in _plan(alpha_scores.tradability(rows))
    own = rows.where("hash(factor, date, instrument_id) % 5 <> 0").toPandas()
    own["p"] = own.groupby(["factor", "date"])["value"].rank(pct=True)
    own = own.sort_values(["factor", "instrument_id", "date"])
    own["d"] = own.groupby(["factor", "instrument_id"])["p"].diff().abs()
    for r in alpha_scores.tradability(spark.createDataFrame(own[["factor", "date", "instrument_id", "value"]]), 0.3).collect():
        one = own[own.factor == r.candidate_id]
        tops = []
        for _, f in one.groupby("date"):
            f = f.sort_values(["value", "instrument_id"], ascending=[False, True])
            tops.append(set(f.instrument_id[: max(1, math.ceil(len(f) * 0.3))]))
        assert abs(r.rank_turnover - one.d.mean()) < 1e-12
        assert abs(r.retention - np.mean([len(a & b) / len(a) for a, b in zip(tops, tops[1:])])) < 1e-12


def test_correlations_of_two_rows_rank_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE panel AS SELECT i AS instrument_id, DATE '2024-01-01' + t::INT AS date, 5e4 + (hash(i, t) % 9973) / 97e2 AS close, 9e3 + (hash(t, i) % 9967) / 97e2 AS volume FROM range(400) a(i), range(12) b(t)")
    con.execute("UPDATE panel SET volume = NULL WHERE hash(instrument_id, date, 3) % 40 = 0")
    factors = {"k": E.rank(E.corr(E.c, E.v, 2))}
    want = con.execute(f"WITH {factor_sql.ctes(factors, 'panel')} SELECT instrument_id, date, k FROM factor_values").fetchall()
    assert len({r[2] for r in want}) > 30  # noise parts ties, in either engine
    rows = spark.createDataFrame(con.execute("FROM panel").fetchall(), "instrument_id long, date date, close double, volume double")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in E.evaluate(rows, factors).collect())


def test_candidates_dates_are_sorted_once(spark, monkeypatch):
    make = "CAST(id % 2 AS STRING) AS factor", "date_add(DATE'2024-01-01', CAST(id DIV 100 AS INT)) AS date", "(id DIV 2) % 50 AS instrument_id", "IF(id % 11 = 0, NULL, CAST(hash(id) % 97 AS DOUBLE)) AS y", "IF(id DIV 100 = 3 OR id % 13 = 0, NULL, IF(id DIV 100 = 4, 7D, CAST(hash(id, 1) % 9 AS DOUBLE))) AS value"
    rows = spark.range(594).selectExpr(*make).where("date < '2024-01-06' or instrument_id < 4")  # a date without values, one of equals, one of few
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [")
    assert sorts(alpha_scores.by_day(rows)) == 1
    assert sorts(alpha_scores.tradability(rows)) == 4  # rows by date and by instrument, and two of dates
    told = lambda df: sorted((r.factor, r.variant, str(r.date), [None if x is None else round(x, 9) for x in (r.ic, r.rank_ic, r._low, r._high, r._mean, r._dev, *r.returns)]) for r in df.collect())
    whole, spilled, some = (told(alpha_scores.by_day(rows, groups=3, q=0.05, at_once=n)) for n in (100, 0, 40))
    assert repr(whole) == repr(spilled) == repr(some) and len(whole) == 36 and any(r[3][0] is None for r in whole) and any(r[3][0] for r in whole)
    kept, wide = [], rows.groupBy("date", "instrument_id").agg(F.max("y").alias("y"), F.max("value").alias("a"), F.min("value").alias("b"))
    monkeypatch.setattr(alpha_scores, "stored", lambda df: kept.append(df) or df)
    meta = spark.createDataFrame([("a", "a", "f", 1.0, 1.0, 1.0, 0.5), ("b", "b", "f", 1.0, 1.0, 1.0, 0.5)], "candidate_id string, formula string, family string, complexity double, depth double, field_count double, financial_logic_score double")
    assert alpha_scores.alpha_scores(wide, meta).columns and "Window" not in _plan(kept[0])
