"""Registered queries of the panel operators and their SQL. Each is one operator, or a few of one kind, over a panel made
from the tables; numbers are tidied so that the order of sums does not matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions import expression as E
from quantloom.functions.tables import stored
from quantloom.operators import calendar, diagnostics, factors, features, portfolio, preprocess

from . import testpanel as tp
from .factor_sql import PREPARED, ctes, factor_query
from .testpanel import tidy_sql

QUERIES, SQL = {}, {}
KEYS = ("instrument_id", "date")


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def tidied(df, keep=KEYS):
    """Doubles tidied, whole numbers as long, the rest as it is."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name in keep or kind in ("string", "boolean", "date"):
            out.append(c)
        elif kind in ("double", "float"):
            out.append(C.tidy(c).alias(name))
        elif kind in ("int", "bigint", "smallint"):
            out.append(c.cast("long").alias(name))
        else:
            out.append(c)
    return df.select(*out)


def tidied_sql(columns, source, keep="instrument_id, date"):
    return f"SELECT {keep}, {', '.join(f'{tidy_sql(c)} AS {c}' for c in columns)} FROM {source}"


def _expressions(name, found, keep=KEYS):
    def run(spark, sf_dir):
        out = E.evaluate(factors.prepare(tp.panel(spark, sf_dir)), found, keep)
        return out.select(*keep, *(C.tidy(x).alias(x) for x in found))

    QUERIES[name] = run
    if keep == KEYS:
        SQL[name] = factor_query(found)
    else:
        SQL[name] = f"WITH {tp.panel_sql()},\n{PREPARED},\n{ctes(found, 'prepared', keep)}\n{tidied_sql(found, 'factor_values', ', '.join(keep))}"


# ---- the panel itself ----


@query("panel_month", f"WITH {tp.panel_sql()} {tidied_sql(['open', 'high', 'low', 'close', 'volume', 'turnover', 'vwap', 'adjustment', 'market_cap'], 'panel', 'instrument_id, date, sector')}")
def panel_month(spark, sf_dir):
    return tidied(tp.panel(spark, sf_dir))


# ---- time-series primitives ----

c, v, h, l, o, w = E.c, E.v, E.h, E.l, E.o, E.w  # noqa: E741
_expressions("ts_rolling", {"mean_5": E.mean(c, 5), "sum_5": E.total(c, 5), "std_5": E.std(c, 5), "min_5": E.low_of(c, 5), "max_5": E.high_of(c, 5), "prod_3": E.prod(c / E.mean(c, 5), 3), "delay_2": E.delay(c, 2), "delta_2": E.delta(c, 2), "count_up_5": E.count_if(E.c > E.pc, 5), "sum_if_5": E.total(E.where(E.c > E.pc, v, 0.0), 5), "mad_6": E.mad(c, 6), "divide": c / (h - l)})
_expressions("ts_pairs", {"corr_6": E.corr(c, v, 6), "cov_6": E.cov(c, v, 6), "slope_6": E.slope(c, 6), "slope_with_gaps": E.slope(E.where(E.c > E.pc, c, c / 0.0), 6)})
_expressions("ts_order", {"ts_rank_8": E.ts_rank(c, 8), "since_high_10": E.since_high(h, 10), "since_low_10": E.since_low(l, 10), "rank": E.rank(v), "rank_in_sector": E.rank_in(v, "sector")})
_expressions("ts_weighted", {"decay_5": E.decay(c, 5), "decay_12": E.decay(E.delta(c, 1), 12), "sma_3_1": E.sma(c, 3, 1), "sma_13_2": E.sma(v, 13, 2), "ema_12": features.ema(c, 12), "sma_gaps": E.sma(E.where(E.c > E.pc, c, c / 0.0), 5, 1)})
_expressions("factor_helpers", {"signed_volume": factors.SIGNED, "signed_sum": E.total(factors.SIGNED, 6), "rsi": factors.rsi(c, 6), "rsv": factors.rsv(9), "true_range": factors.RANGE, "dtm": factors.DTM, "dbm": factors.DBM, "rise": factors.RISE, "fall": factors.FALL, "ret": E.r, "hlc3": E.tp})


@query("ts_argmax", f"""WITH {tp.panel_sql()}, w AS (SELECT instrument_id, date, list(close) OVER (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS a FROM panel)
SELECT instrument_id, date, list_position(a, list_max(a))::DOUBLE AS argmax_8, list_position(a, list_min(a))::DOUBLE AS argmin_8 FROM w""")
def ts_argmax(spark, sf_dir):
    return tp.panel(spark, sf_dir).select(*KEYS, C.ts_argmax(F.col("close"), 8).alias("argmax_8"), C.ts_argmin(F.col("close"), 8).alias("argmin_8"))


# ---- factors and features ----

_names = list(factors.FACTORS)
for _i in range(0, len(_names), 22):
    _part = {x: factors.FACTORS[x] for x in _names[_i : _i + 22]}
    _expressions(f"factors_{_i // 22 + 1}", _part)
_expressions("factors_canonical", {x: factors.FACTORS[x] for x in factors.CANONICAL})
for _family in ("base", "advanced"):
    _expressions(f"features_{_family}", features.FAMILIES[_family])
_expressions("features_sector_context", features.FAMILIES["sector_context"], (*KEYS, "sector"))


_state = """day AS (SELECT date, avg(r) AS m, stddev_samp(r) AS market_cross_sectional_dispersion, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS market_breadth FROM (
  SELECT date, CASE WHEN pc > 1e-8 AND close > 0 THEN ln(close / pc) END AS r FROM (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY date) AS pc FROM panel)) GROUP BY date),
rolled AS (SELECT *, CASE WHEN count(m) OVER w5 >= 2 THEN sum(m) OVER w5 END AS market_return_5d, CASE WHEN count(m) OVER w20 >= 5 THEN sum(m) OVER w20 END AS market_return_20d, CASE WHEN count(m) OVER w20 >= 5 THEN stddev_samp(m) OVER w20 END AS market_volatility_20d
  FROM day WINDOW w5 AS (ORDER BY date ROWS 4 PRECEDING), w20 AS (ORDER BY date ROWS 19 PRECEDING)),
state AS (SELECT *, CASE WHEN market_volatility_20d > CASE WHEN count(market_volatility_20d) OVER w >= 20 THEN quantile_cont(market_volatility_20d, 0.5) OVER w END THEN 1.0 ELSE 0.0 END::DOUBLE AS market_high_vol_regime FROM rolled WINDOW w AS (ORDER BY date ROWS 251 PRECEDING))"""


@query("market_state", f"WITH {tp.panel_sql()}, {_state} {tidied_sql(['market_return_5d', 'market_return_20d', 'market_volatility_20d', 'market_high_vol_regime', 'market_cross_sectional_dispersion', 'market_breadth'], 'state', 'date')}")
def market_state(spark, sf_dir):
    return tidied(features.market_state(tp.panel(spark, sf_dir)))


@query("macro_context", f"""WITH {tp.MACRO_SQL}, f AS (SELECT date, last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS x, last_value(us10y IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS y FROM macro),
g AS (SELECT date, x AS macro_vix, x - lag(x, 5) OVER (ORDER BY date) AS macro_vix_change_5d, (x - CASE WHEN count(x) OVER w >= 20 THEN avg(x) OVER w END) / CASE WHEN count(x) OVER w >= 20 AND abs(stddev_samp(x) OVER w) > 1e-8 THEN stddev_samp(x) OVER w END AS macro_vix_zscore_252d,
  y AS macro_us10y, y - lag(y, 5) OVER (ORDER BY date) AS macro_us10y_change_5d, (y - CASE WHEN count(y) OVER w >= 20 THEN avg(y) OVER w END) / CASE WHEN count(y) OVER w >= 20 AND abs(stddev_samp(y) OVER w) > 1e-8 THEN stddev_samp(y) OVER w END AS macro_us10y_zscore_252d FROM f WINDOW w AS (ORDER BY date ROWS 251 PRECEDING))
{tidied_sql(['macro_vix', 'macro_vix_change_5d', 'macro_vix_zscore_252d', 'macro_us10y', 'macro_us10y_change_5d', 'macro_us10y_zscore_252d'], 'g', 'date')}""")
def macro_context(spark, sf_dir):
    return tidied(features.macro_context(tp.macro(spark, sf_dir), ["vix", "us10y"]))


# ---- labels, splits, folds, windows ----

_cal = "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM panel)), pt AS (SELECT p.*, t FROM panel p JOIN cal USING (date))"


def _forward(every="month"):
    return f"""WITH {tp.panel_sql(every=every)}, {_cal}, y AS (SELECT a.instrument_id, a.date, b.close / a.close - 1 AS y_1d, c.close / a.close - 1 AS y_5d, d.close / a.close - 1 AS y_10d FROM pt a
  LEFT JOIN pt b ON b.instrument_id = a.instrument_id AND b.t = a.t + 1 LEFT JOIN pt c ON c.instrument_id = a.instrument_id AND c.t = a.t + 5 LEFT JOIN pt d ON d.instrument_id = a.instrument_id AND d.t = a.t + 10)
{tidied_sql(['y_1d', 'y_5d', 'y_10d'], 'y')}"""


@query("forward_returns", _forward())
def forward_returns(spark, sf_dir):
    return tidied(calendar.add_forward_returns(tp.panel(spark, sf_dir)).select(*KEYS, "y_1d", "y_5d", "y_10d"))


@query("forward_returns_weekly", _forward("week"))
def forward_returns_weekly(spark, sf_dir):
    return tidied(calendar.add_forward_returns(tp.panel(spark, sf_dir, "week")).select(*KEYS, "y_1d", "y_5d", "y_10d"))


_split = "sp AS (SELECT instrument_id, date, close, t > least(greatest(floor((SELECT max(t) FROM cal) * 0.8), 1), (SELECT max(t) FROM cal) - 1) AS is_test FROM pt)"


@query("time_split", f"WITH {tp.panel_sql()}, {_cal}, {_split} SELECT instrument_id, date, is_test FROM sp")
def time_split(spark, sf_dir):
    return calendar.tagged_split(tp.panel(spark, sf_dir)).select(*KEYS, "is_test")


@query("purged_train_context", f"""WITH {tp.panel_sql()}, {_cal}, {_split}, tr AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM sp WHERE NOT is_test),
pu AS (SELECT instrument_id, date, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM tr WHERE k > 5)
SELECT instrument_id, date, 'train' AS part FROM pu WHERE k <= 12 UNION ALL SELECT instrument_id, date, 'test' FROM sp WHERE is_test""")
def purged_train_context(spark, sf_dir):
    train, test = calendar.split(tp.panel(spark, sf_dir))
    out = calendar.history_context(calendar.purge(train, 5).withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")), 12)
    return out.select(*KEYS, "part")


@query("purge_summary", f"""WITH {tp.panel_sql('panel', 'week')}, {_cal}, {_split}, tr AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) <= 5 AS cut FROM sp WHERE NOT is_test)
SELECT count(*) AS rows_before, count(*) FILTER (NOT cut) AS rows_after, count(*) FILTER (cut) AS rows_purged, count(DISTINCT date) FILTER (cut) AS dates_touched, max(date) FILTER (NOT cut) AS last_train_date FROM tr""")
def purge_summary(spark, sf_dir):
    return calendar.purge_summary(calendar.split(tp.panel(spark, sf_dir, "week"))[0], 5)


@query("walk_forward", f"""WITH {tp.panel_sql()}, {_cal}, f AS (SELECT fold, n - (4 - fold) * (n // 4) AS e, n - (4 - fold) * (n // 4) + n // 4 AS v FROM (SELECT max(t) AS n FROM cal), (SELECT unnest(range(1, 4)) AS fold)),
b AS (SELECT instrument_id, date, fold, CASE WHEN t <= e THEN 'train' ELSE 'valid' END AS part FROM pt JOIN f ON t <= v), r AS (SELECT *, row_number() OVER (PARTITION BY fold, part, instrument_id ORDER BY date DESC) AS k FROM b)
SELECT instrument_id, date, fold, part FROM r WHERE part = 'valid' OR k > 5""")
def walk_forward(spark, sf_dir):
    return calendar.walk_forward(tp.panel(spark, sf_dir), 3, 5).select(*KEYS, F.col("fold").cast("long").alias("fold"), "part")


@query("fold_summary", SQL["walk_forward"].replace("SELECT instrument_id, date, fold, part FROM r WHERE part = 'valid' OR k > 5", "SELECT fold, part, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT instrument_id) AS instruments FROM r WHERE part = 'valid' OR k > 5 GROUP BY fold, part"))
def fold_summary(spark, sf_dir):
    return tidied(calendar.fold_summary(calendar.walk_forward(tp.panel(spark, sf_dir), 3, 5)))


@query("date_blocks", f"WITH {tp.panel_sql()} SELECT date, ntile(5) OVER (ORDER BY date) AS block FROM (SELECT DISTINCT date FROM panel)")
def date_blocks(spark, sf_dir):
    return tidied(calendar.date_blocks(tp.panel(spark, sf_dir), 5))


@query("halves", f"WITH {tp.panel_sql()}, {_cal} SELECT instrument_id, date, CASE WHEN t <= (SELECT max(t) FROM cal) // 2 THEN 1 ELSE 2 END::BIGINT AS half FROM pt")
def halves(spark, sf_dir):
    return tidied(calendar.halves(tp.panel(spark, sf_dir)).select(*KEYS, "half"))


@query("month_windows", f"""WITH {tp.panel_sql()}, s AS (SELECT min(date) AS lo, max(date) AS hi FROM panel), k AS (SELECT unnest(range(0, 400)) AS k), m AS (SELECT * FROM (VALUES (3, 1), (6, 2), (12, 12)) x(months, step)),
w AS (SELECT months || 'm' AS mode, (lo + to_months((k * step)::INT))::DATE AS start, (lo + to_months((k * step)::INT) + to_months(months) - INTERVAL 1 DAY)::DATE AS "end", hi FROM s, k, m),
a AS (SELECT 'full' AS mode, lo AS start, hi AS "end" FROM s UNION ALL SELECT mode, start, "end" FROM w WHERE "end" <= hi)
SELECT mode, start, "end", count(*) AS rows, count(DISTINCT instrument_id) AS instruments FROM panel JOIN a ON date BETWEEN start AND "end" GROUP BY ALL""")
def month_windows(spark, sf_dir):
    df = tp.panel(spark, sf_dir)
    out = calendar.in_windows(df, calendar.month_windows(df)).groupBy("mode", "start", "end").agg(F.count("*").alias("rows"), F.countDistinct("instrument_id").alias("instruments"))
    return tidied(out)


@query("recent_windows", f"""WITH {tp.panel_sql()}, h AS (SELECT max(date) AS "end" FROM panel), a AS (SELECT 'last_' || m || 'm' AS mode, ("end" - to_months(m) + INTERVAL 1 DAY)::DATE AS start, "end" FROM h, (SELECT unnest([3, 6, 12]) AS m))
SELECT mode, start, "end", count(*) AS rows FROM panel JOIN a ON date BETWEEN start AND "end" GROUP BY ALL""")
def recent_windows(spark, sf_dir):
    df = tp.panel(spark, sf_dir)
    return tidied(calendar.in_windows(df, calendar.recent_windows(df)).groupBy("mode", "start", "end").agg(F.count("*").alias("rows")))


@query("shift_and_hold", f"""WITH {tp.panel_sql()}, {_cal} SELECT a.date AS signal_date, e.date AS execution_date, z.date AS end_date, 4::BIGINT AS days, s.date AS shifted FROM cal a JOIN cal e ON e.t = a.t + 1 JOIN cal z ON z.t = a.t + 5 LEFT JOIN cal s ON s.t = a.t - 2""")
def shift_and_hold(spark, sf_dir):
    df = tp.panel(spark, sf_dir)
    return tidied(calendar.holding_windows(df, 5, 1).join(calendar.shift_dates(df, -2).withColumnRenamed("date", "signal_date"), "signal_date"))


# ---- cross-sectional preprocessing ----

_cols = ["volume", "turnover", "vwap"]
_win = ", ".join(f"least(greatest({x}, quantile_cont({x}, 0.01) OVER d), quantile_cont({x}, 0.99) OVER d) AS {x}" for x in _cols)
_z = ", ".join(f"({x} - avg({x}) OVER d) / CASE WHEN stddev_pop({x}) OVER d > 1e-12 THEN stddev_pop({x}) OVER d END AS {x}" for x in _cols)
_zs = f"wi AS (SELECT instrument_id, date, sector, market_cap, {_win} FROM panel WINDOW d AS (PARTITION BY date)), zs AS (SELECT instrument_id, date, sector, market_cap, {_z} FROM wi WINDOW d AS (PARTITION BY date))"


@query("winsor_zscore", f"WITH {tp.panel_sql()}, {_zs} {tidied_sql(_cols, 'zs')}")
def winsor_zscore(spark, sf_dir):
    return tidied(preprocess.standardize(tp.panel(spark, sf_dir), _cols).select(*KEYS, *_cols))


_neutral = f"""q AS (SELECT *, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS s0 FROM zs),
q1 AS (SELECT *, avg((s0 IS NOT NULL)::INT) OVER d >= 0.9 AND max(s0) OVER d > min(s0) OVER d AS used, len(list_distinct(list(sector) OVER d)) AS g FROM q WINDOW d AS (PARTITION BY date)),
q2 AS (SELECT *, CASE WHEN used THEN (s0 - avg(s0) OVER d) / stddev_pop(s0) OVER d END AS sz, g + used::INT AS k FROM q1 WINDOW d AS (PARTITION BY date)),
q3 AS (SELECT instrument_id, date, k, {', '.join(f"{x}, CASE WHEN NOT used OR sz IS NOT NULL THEN {x} END AS v_{x}, CASE WHEN {x} IS NOT NULL THEN coalesce(sz, 0) END AS s_{x}" for x in _cols)}, sector, used, sz FROM q2),
q4 AS (SELECT *, {', '.join(f"v_{x} - avg(v_{x}) OVER w AS a_{x}, CASE WHEN v_{x} IS NOT NULL THEN s_{x} - avg(CASE WHEN v_{x} IS NOT NULL THEN s_{x} END) OVER w END AS b_{x}, count(v_{x}) OVER d AS n_{x}" for x in _cols)} FROM q3 WINDOW w AS (PARTITION BY date, sector), d AS (PARTITION BY date)),
neutral AS (SELECT instrument_id, date, {', '.join(f"CASE WHEN k <= 1 OR n_{x} <= k THEN {x} ELSE a_{x} - b_{x} * CASE WHEN sum(b_{x} * b_{x}) OVER d > 1e-12 THEN sum(a_{x} * b_{x}) OVER d / sum(b_{x} * b_{x}) OVER d ELSE 0 END END AS {x}" for x in _cols)} FROM q4 WINDOW d AS (PARTITION BY date))"""


@query("neutralize", f"WITH {tp.panel_sql()}, {_zs}, {_neutral} {tidied_sql(_cols, 'neutral')}")
def neutralize(spark, sf_dir):
    return tidied(preprocess.neutralize(preprocess.standardize(tp.panel(spark, sf_dir), _cols), _cols).select(*KEYS, *_cols))


@query("preprocess", f"""WITH p0 AS (SELECT 1), {tp.panel_sql('raw')}, panel AS (SELECT * REPLACE (CASE WHEN count(volume) OVER d > 1 AND stddev_pop(volume) OVER d > 1e-12 THEN volume END AS volume, CASE WHEN count(turnover) OVER d > 1 AND stddev_pop(turnover) OVER d > 1e-12 THEN turnover END AS turnover, CASE WHEN count(vwap) OVER d > 1 AND stddev_pop(vwap) OVER d > 1e-12 THEN vwap END AS vwap) FROM raw WINDOW d AS (PARTITION BY date)),
{_zs}, {_neutral}, back AS (SELECT r.instrument_id, r.date, {', '.join(f"CASE WHEN p.{x} IS NOT NULL THEN n.{x} ELSE r.{x} END AS {x}" for x in _cols)} FROM raw r JOIN panel p USING (instrument_id, date) JOIN neutral n USING (instrument_id, date)) {tidied_sql(_cols, 'back')}""")
def preprocess_all(spark, sf_dir):
    return tidied(preprocess.preprocess(tp.panel(spark, sf_dir), _cols).select(*KEYS, *_cols))


@query("impute_medians", f"WITH {tp.panel_sql()}, {_cal}, x AS (SELECT instrument_id, date, t, lag(close, 12) OVER (PARTITION BY instrument_id ORDER BY date) AS a FROM pt), m AS (SELECT coalesce(quantile_cont(a, 0.5), 0) AS m FROM x WHERE t <= 40), f AS (SELECT instrument_id, date, coalesce(a, m) AS a FROM x, m) {tidied_sql(['a'], 'f')}")
def impute_medians(spark, sf_dir):
    df = calendar.with_t(tp.panel(spark, sf_dir)).withColumn("a", C.delay(F.col("close"), 12))
    return tidied(preprocess.impute(df, df.where("t <= 40"), ["a"]).select(*KEYS, "a"))


# ---- diagnostics ----

_pred = f"WITH {tp.panel_sql()}, {tp.predictions_sql()}"
_corr = "CASE WHEN count(*) >= 2 AND stddev_pop({a}) > 1e-9 * abs(avg({a})) AND stddev_pop({b}) > 1e-9 * abs(avg({b})) THEN round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 10) END"
_pairs = """pairs AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY predicted_y) + (count(*) OVER (PARTITION BY date, predicted_y) - 1) / 2 AS rs, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2 AS rt FROM pred WHERE y IS NOT NULL)"""
_ic = f"{_pairs}, ic AS (SELECT date, {_corr.format(a='predicted_y', b='y')} AS ic, {_corr.format(a='rs', b='rt')} AS rank_ic, count(*) AS n FROM pairs GROUP BY date)"


def _panel(spark, sf_dir):
    """The panel, computed once for all that a query makes of it."""
    return stored(tp.panel(spark, sf_dir))


def _predictions(spark, sf_dir):
    return stored(tp.predictions(_panel(spark, sf_dir)))


@query("daily_ic", f"{_pred}, {_ic} SELECT date, {tidy_sql('ic')} AS ic, {tidy_sql('rank_ic')} AS rank_ic, n FROM ic")
def daily_ic(spark, sf_dir):
    return tidied(diagnostics.daily_ic(_predictions(spark, sf_dir)))


def _summary(x, ddof=1):
    s = f"stddev_{'samp' if ddof else 'pop'}({x})"
    return f"{tidy_sql(f'avg({x})')} AS mean, {tidy_sql(f'quantile_cont({x}, 0.5)')} AS median, {tidy_sql(s)} AS std, {tidy_sql(f'(avg({x}) / CASE WHEN {s} > 1e-12 THEN {s} END)')} AS icir, {tidy_sql(f'avg(({x} > 0)::INT)')} AS positive_ratio, count({x}) AS n_dates"


@query("ic_summary", f"{_pred}, {_ic} SELECT 'ic' AS kind, {_summary('ic')} FROM ic UNION ALL SELECT 'rank_ic', {_summary('rank_ic', 0)} FROM ic")
def ic_summary(spark, sf_dir):
    ic = diagnostics.daily_ic(_predictions(spark, sf_dir))
    a = diagnostics.summarize_ic(ic).withColumn("kind", F.lit("ic"))
    return tidied(a.unionByName(diagnostics.summarize_ic(ic, "rank_ic", ddof=0).withColumn("kind", F.lit("rank_ic"))))


_groups = """g AS (SELECT date, y, least(greatest(ceil(row_number() OVER (PARTITION BY date ORDER BY predicted_y, instrument_id) / count(*) OVER (PARTITION BY date) * 5), 1), 5)::BIGINT AS "group" FROM pred WHERE y IS NOT NULL),
gr AS (SELECT "group", avg(r) AS avg_return, count(*) AS n_dates FROM (SELECT date, "group", avg(y) AS r FROM g GROUP BY ALL) GROUP BY "group")"""


@query("group_returns", f'{_pred}, {_groups} SELECT "group", {tidy_sql("avg_return")} AS avg_return, n_dates FROM gr')
def group_returns(spark, sf_dir):
    return tidied(diagnostics.group_returns(_predictions(spark, sf_dir), 5))


_spread = f"""sr AS (SELECT *, rank() OVER (ORDER BY avg_return)::DOUBLE AS r FROM gr), spread AS (SELECT max_by(avg_return, "group") AS top, min_by(avg_return, "group") AS bottom, max_by(avg_return, "group") - min_by(avg_return, "group") AS spread, {_corr.format(a='"group"::DOUBLE', b='r')} AS monotonicity FROM sr)"""


@query("prediction_metrics", f"""{_pred}, {_ic}, {_groups}, {_spread},
p AS (SELECT {_corr.format(a='predicted_y', b='y')} AS pooled_corr FROM pairs), e AS (SELECT sqrt(avg((predicted_y - y) ** 2)) AS rmse, avg(abs(predicted_y - y)) AS mae, count(y) AS rows, count(DISTINCT date) AS dates, count(DISTINCT instrument_id) AS instruments, avg((y IS NOT NULL)::INT) AS coverage FROM pred)
SELECT {tidy_sql('pooled_corr')} AS pooled_corr, {tidy_sql('rmse')} AS rmse, {tidy_sql('mae')} AS mae, rows, dates, instruments, {tidy_sql('coverage')} AS coverage, {tidy_sql('i')} AS ic_mean, {tidy_sql('r')} AS rank_ic_mean, {tidy_sql('spread')} AS top_bottom_spread, {tidy_sql('monotonicity')} AS monotonicity
FROM p, e, spread, (SELECT avg(ic) AS i, avg(rank_ic) AS r FROM ic)""")
def prediction_metrics(spark, sf_dir):
    m = diagnostics.prediction_metrics(_predictions(spark, sf_dir), 5)
    return tidied(m.select("pooled_corr", "rmse", "mae", "rows", "dates", "instruments", "coverage", "ic_mean", "rank_ic_mean", "top_bottom_spread", "monotonicity"))


_tops = """k AS (SELECT *, floor(count(*) OVER (PARTITION BY date) * 0.2) AS k, row_number() OVER (PARTITION BY date ORDER BY predicted_y DESC, instrument_id) AS u, row_number() OVER (PARTITION BY date ORDER BY predicted_y, instrument_id) AS d FROM pred{where}),
ls AS (SELECT date, avg(y) FILTER (u <= k) AS top, avg(y) FILTER (d <= k) AS bottom, avg(y) FILTER (u <= k) - avg(y) FILTER (d <= k) AS spread FROM k GROUP BY date)"""


@query("long_short_by_date", f"{_pred}, {_tops.format(where=' WHERE y IS NOT NULL')} SELECT date, {tidy_sql('top')} AS top, {tidy_sql('bottom')} AS bottom, {tidy_sql('spread')} AS spread FROM ls")
def long_short_by_date(spark, sf_dir):
    return tidied(diagnostics.long_short_by_date(_predictions(spark, sf_dir)))


@query("book_turnover", f"""{_pred}, {_tops.format(where='')}, t AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM pred)),
b AS (SELECT t, instrument_id, CASE WHEN u <= k THEN 1.0 ELSE -1.0 END / k AS w FROM k JOIN t USING (date) WHERE u <= k OR d <= k),
s AS (SELECT coalesce(a.t, o.t + 1) AS t, sum(abs(coalesce(a.w, 0) - coalesce(o.w, 0))) AS turnover FROM b a FULL JOIN b o ON o.t + 1 = a.t AND o.instrument_id = a.instrument_id GROUP BY 1)
SELECT date, {tidy_sql('turnover::DOUBLE')} AS turnover FROM t JOIN s USING (t) WHERE t > 1""")
def book_turnover(spark, sf_dir):
    return tidied(diagnostics.book_turnover(_predictions(spark, sf_dir)))


@query("spread_summary", f"""{_pred}, {_tops.format(where=' WHERE y IS NOT NULL')}, x AS (SELECT spread, CASE WHEN (row_number() OVER (ORDER BY date) - 1) % 5 = 0 THEN spread END AS own FROM ls)
SELECT {tidy_sql('avg(spread)')} AS mean, {tidy_sql('(avg(spread) / stddev_samp(spread) * sqrt(252))')} AS sharpe, {tidy_sql('avg(own)')} AS mean_apart, {tidy_sql('(avg(own) / stddev_samp(own) * sqrt(50.4))')} AS sharpe_apart, {tidy_sql('(product(1 + own) - 1)')} AS compounded FROM x""")
def spread_summary(spark, sf_dir):
    return tidied(diagnostics.spread_summary(diagnostics.long_short_by_date(_predictions(spark, sf_dir))))


_sig = ["volume", "vwap", "turnover"]
_long = f"lf AS (SELECT p.date, p.instrument_id, y, u.f AS factor, u.v AS value FROM panel p JOIN pred USING (date, instrument_id), LATERAL (SELECT unnest(['volume', 'vwap', 'turnover']) AS f, unnest([volume, vwap, turnover]) AS v) u)"
_fic = f"""fp AS (SELECT *, rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2 AS rs, rank() OVER (PARTITION BY factor, date ORDER BY y) + (count(*) OVER (PARTITION BY factor, date, y) - 1) / 2 AS rt FROM lf WHERE y IS NOT NULL AND value IS NOT NULL),
fic AS (SELECT factor, date, CASE WHEN count(*) >= 5 THEN {_corr.format(a='value', b='y')} END AS ic, CASE WHEN count(*) >= 5 THEN {_corr.format(a='rs', b='rt')} END AS rank_ic, count(*) AS n FROM fp GROUP BY factor, date)"""


def _signals(spark, sf_dir):
    df = _panel(spark, sf_dir)
    return stored(df.join(tp.predictions(df), ["date", "instrument_id"]))


@query("factor_ic", f"{_pred}, {_long}, {_fic} SELECT factor, date, {tidy_sql('ic')} AS ic, {tidy_sql('rank_ic')} AS rank_ic, n FROM fic")
def factor_ic(spark, sf_dir):
    return tidied(diagnostics.factor_ic(_signals(spark, sf_dir), _sig, least=5))


@query("factor_decay", f"{_pred}, {_long}, {_fic} SELECT factor, date_trunc('year', date)::DATE AS period, {tidy_sql('avg(ic)')} AS mean, {tidy_sql('quantile_cont(ic, 0.5)')} AS median, {tidy_sql('stddev_samp(ic)')} AS std, count(ic) AS n FROM fic GROUP BY 1, 2")
def factor_decay(spark, sf_dir):
    return tidied(diagnostics.decay_table(diagnostics.factor_ic(_signals(spark, sf_dir), _sig, least=5)))


@query("factor_turnover", f"""{_pred}, {_long}, r AS (SELECT *, count(*) OVER (PARTITION BY factor, date) AS n FROM lf),
p AS (SELECT factor, instrument_id, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2) / n AS p, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, instrument_id) <= ceil(n * 0.2) AS top, dense_rank() OVER (PARTITION BY factor ORDER BY date) AS k FROM r WHERE n >= 5),
s AS (SELECT a.factor, a.k, avg(abs(a.p - b.p)) AS change, sum((a.top AND b.top)::INT) AS stay, count(*) AS common FROM p a JOIN p b ON a.factor = b.factor AND a.instrument_id = b.instrument_id AND b.k + 1 = a.k GROUP BY 1, 2),
t AS (SELECT factor, k + 1 AS k, sum(top::INT) AS were FROM p GROUP BY 1, 2)
SELECT factor, {tidy_sql('avg(change)')} AS rank_turnover, {tidy_sql('avg(stay / nullif(were, 0))')} AS retention, count(*) AS transitions FROM s JOIN t USING (factor, k) WHERE common >= 2 GROUP BY factor""")
def factor_turnover(spark, sf_dir):
    return tidied(diagnostics.turnover(_signals(spark, sf_dir), _sig, least=5))


@query("factor_correlation", f"""WITH {tp.panel_sql()}, z AS (SELECT {', '.join(f"(({x} - avg({x}) OVER d) / CASE WHEN stddev_pop({x}) OVER d > 1e-12 THEN stddev_pop({x}) OVER d END) AS {x}" for x in _sig)} FROM panel WINDOW d AS (PARTITION BY date))
{' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {tidy_sql(f'corr({a}, {b})')} AS corr FROM z" for a, b in (('volume', 'vwap'), ('volume', 'turnover'), ('vwap', 'turnover')))}""")
def factor_correlation(spark, sf_dir):
    return tidied(diagnostics.factor_correlation(tp.panel(spark, sf_dir), _sig))


@query("factor_summary")
def factor_summary(spark, sf_dir):
    return tidied(diagnostics.factor_summary(_signals(spark, sf_dir), _sig))


@query("horizon_ic", f"""WITH {tp.panel_sql()}, {_cal}, h AS (SELECT a.date, a.instrument_id, a.volume, a.vwap, n AS horizon, b.close / a.close - 1 AS y FROM pt a CROSS JOIN (SELECT unnest([1, 5]) AS n) LEFT JOIN pt b ON b.instrument_id = a.instrument_id AND b.t = a.t + n),
lf AS (SELECT date, instrument_id, horizon, y, 'volume' AS factor, volume AS value FROM h UNION ALL SELECT date, instrument_id, horizon, y, 'vwap', vwap FROM h),
r AS (SELECT *, rank() OVER (PARTITION BY factor, horizon, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, horizon, date, value) - 1) / 2 AS rs, CASE WHEN y IS NOT NULL THEN rank() OVER (PARTITION BY factor, horizon, date, y IS NULL ORDER BY y) + (count(*) OVER (PARTITION BY factor, horizon, date, y) - 1) / 2 END AS rt FROM lf),
ic AS (SELECT factor, horizon, date, CASE WHEN count(y) >= 2 THEN corr(value, y) END AS ic, CASE WHEN count(y) >= 2 THEN corr(rs, rt) END AS rank_ic, count(y) AS n FROM r GROUP BY 1, 2, 3)
SELECT factor, horizon::BIGINT AS horizon, date, {tidy_sql('round(ic, 10)')} AS ic, {tidy_sql('round(rank_ic, 10)')} AS rank_ic, n FROM ic""")
def horizon_ic(spark, sf_dir):
    return tidied(diagnostics.horizon_ic(calendar.add_forward_returns(tp.panel(spark, sf_dir), [1, 5]), ["volume", "vwap"], (1, 5)))


# ---- portfolios ----


def _traded(spark, sf_dir):
    df = _panel(spark, sf_dir)
    market = stored(portfolio.market_snapshot(df))
    return stored(portfolio.merge_predictions(tp.predictions(df), market)), market


_market = """market AS MATERIALIZED (SELECT *, (s - avg(s) OVER d) / CASE WHEN stddev_pop(s) OVER d > 1e-12 THEN stddev_pop(s) OVER d END AS size_exposure_z, CASE WHEN count(daily_close_return) OVER w >= 5 THEN stddev_pop(daily_close_return) OVER w END AS realized_vol_20 FROM (
  SELECT date, instrument_id, sector, market_cap, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) - 1 AS daily_close_return, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS s FROM panel)
  WINDOW d AS (PARTITION BY date), w AS (PARTITION BY instrument_id ORDER BY date ROWS 19 PRECEDING)),
merged AS MATERIALIZED (SELECT date, instrument_id, y, predicted_y, sector, market_cap, daily_close_return, size_exposure_z, realized_vol_20 FROM pred JOIN market USING (date, instrument_id))"""


@query("market_snapshot", f"{_pred}, {_market} {tidied_sql(['daily_close_return', 'market_cap', 'size_exposure_z', 'realized_vol_20'], 'market', 'instrument_id, date, sector')}")
def market_snapshot(spark, sf_dir):
    return tidied(portfolio.market_snapshot(tp.panel(spark, sf_dir)))


def _books_sql(k):
    return f"""bk AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY predicted_y DESC, instrument_id) <= {k} THEN 'long' WHEN row_number() OVER (PARTITION BY date ORDER BY predicted_y, instrument_id) <= {k} THEN 'short' END AS side FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM merged) WHERE n >= {2 * k}),
books AS MATERIALIZED (SELECT * FROM bk WHERE side IS NOT NULL)"""


@query("long_short_books", f"{_pred}, {_market}, {_books_sql(3)} SELECT date, instrument_id, side FROM books")
def long_short_books(spark, sf_dir):
    return portfolio.books(_traded(spark, sf_dir)[0], 3).select("date", "instrument_id", "side")


_quota = """sc AS (SELECT date, sector, count(*) AS n_s, sum(count(*)) OVER (PARTITION BY date) AS n FROM merged GROUP BY date, sector),
q0 AS (SELECT *, n_s // 2 AS cap, 3 * n_s / n AS raw FROM sc WHERE n_s >= 2), q1 AS (SELECT *, least(floor(raw), cap)::BIGINT AS base, round(raw - floor(raw), 9) AS rest FROM q0),
q2 AS (SELECT *, cap - base AS slack, greatest(0, 3 - sum(base) OVER (PARTITION BY date)) AS lack, coalesce(sum(cap - base) OVER (PARTITION BY date ORDER BY rest DESC, n_s DESC, sector ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q1),
quota AS (SELECT date, sector, (base + least(slack, greatest(0, lack - before)))::BIGINT AS quota FROM q2)"""


@query("sector_quotas", f"{_pred}, {_market}, {_quota} SELECT * FROM quota WHERE quota > 0")
def sector_quotas(spark, sf_dir):
    return tidied(portfolio.sector_quotas(_traded(spark, sf_dir)[0].where("predicted_y is not null"), 3))


@query("sector_neutral_books", f"""{_pred}, {_market}, {_quota}, m AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM merged),
a AS (SELECT m.*, CASE WHEN row_number() OVER (PARTITION BY date, sector ORDER BY predicted_y DESC, instrument_id) <= quota THEN 'long' WHEN row_number() OVER (PARTITION BY date, sector ORDER BY predicted_y, instrument_id) <= quota THEN 'short' END AS s1 FROM m LEFT JOIN quota USING (date, sector) WHERE n >= 6),
b AS (SELECT *, CASE WHEN s1 IS NOT NULL THEN s1 WHEN row_number() OVER (PARTITION BY date, s1 IS NULL ORDER BY predicted_y DESC, instrument_id) <= 3 - count(*) FILTER (s1 = 'long') OVER (PARTITION BY date) THEN 'long' END AS s2, 3 - count(*) FILTER (s1 = 'short') OVER (PARTITION BY date) AS ls FROM a),
c AS (SELECT *, CASE WHEN s2 IS NOT NULL THEN s2 WHEN row_number() OVER (PARTITION BY date, s2 IS NULL ORDER BY predicted_y, instrument_id) <= ls THEN 'short' END AS side FROM b)
SELECT date, instrument_id, side FROM c WHERE side IS NOT NULL""")
def sector_neutral_books(spark, sf_dir):
    return portfolio.books(_traded(spark, sf_dir)[0], 3, True).select("date", "instrument_id", "side")


_x = "CASE WHEN side = 'long' THEN predicted_y ELSE -predicted_y END"
_modes = {"equal": "1.0::DOUBLE", "rank": "(count(*) OVER s - row_number() OVER (PARTITION BY date, side ORDER BY x DESC, instrument_id) + 1)::DOUBLE", "score": "x - min(x) OVER s + 1e-12", "score_vol": "(x - min(x) OVER s + 1e-12) / greatest(coalesce(realized_vol_20, quantile_cont(realized_vol_20, 0.5) OVER s, 1), 1e-6)"}


@query("book_weights", f"{_pred}, {_market}, {_books_sql(3)}, x AS (SELECT *, {_x} AS x FROM books), " + ", ".join(f"w_{m} AS (SELECT date, instrument_id, '{m}' AS mode, CASE WHEN side = 'long' THEN 1 ELSE -1 END * sc / sum(sc) OVER (PARTITION BY date, side) AS weight FROM (SELECT *, {e} AS sc FROM x WINDOW s AS (PARTITION BY date, side)))" for m, e in _modes.items()) + f" SELECT date, instrument_id, mode, {tidy_sql('weight')} AS weight FROM (" + " UNION ALL ".join(f"SELECT * FROM w_{m}" for m in _modes) + ")")
def book_weights(spark, sf_dir):
    picked = portfolio.books(_traded(spark, sf_dir)[0], 3)
    out = [portfolio.side_weights(picked, m).select("date", "instrument_id", F.lit(m).alias("mode"), "weight") for m in _modes]
    return tidied(out[0].union(out[1]).union(out[2]).union(out[3]))


@query("capped_weights")
def capped_weights(spark, sf_dir):
    return tidied(portfolio.side_weights(portfolio.books(_traded(spark, sf_dir)[0], 4), "rank", 0.3).select("date", "instrument_id", "side", "weight"))


def _ledger_sql(cfg):
    s, k, days = cfg.sleeves, cfg.top_k, cfg.days
    return f"""{_pred}, {_market}, {_books_sql(k)}, cl AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM market)),
tg AS (SELECT b.date AS sd, t + {cfg.delay} AS te, t + {cfg.delay + days} AS tz, instrument_id, CASE WHEN side = 'long' THEN 1.0 ELSE -1.0 END / {k} AS w FROM books b JOIN cl USING (date) WHERE (t - 1) % {cfg.step} = 0 AND t + {cfg.delay + days} <= (SELECT max(t) FROM cl)),
hd AS (SELECT sd, te, tz, t, cl.date, g.instrument_id, w, daily_close_return AS r FROM tg g JOIN cl ON t > te AND t <= tz LEFT JOIN market m ON m.date = cl.date AND m.instrument_id = g.instrument_id),
ok AS (SELECT sd FROM hd GROUP BY sd HAVING count(*) = count(r)),
dy AS (SELECT sd, te, tz, t, sum(CASE WHEN w > 0 THEN w * r ELSE 0 END) AS lg, sum(CASE WHEN w < 0 THEN w * r ELSE 0 END) AS sg, sum(greatest(w, 0)) AS le, sum(greatest(-w, 0)) AS se FROM hd WHERE sd IN (FROM ok) GROUP BY ALL),
al AS (SELECT sd, te, tz, t, lg, sg, le, se FROM dy UNION ALL SELECT sd, te, tz, te, 0, 0, le, se FROM dy WHERE t = tz),
cs AS (SELECT *, (le + se) * {cfg.cost_bps} / 1e4 * ((t = te)::INT + (t = tz)::INT) AS tc, CASE WHEN t > te THEN se * {cfg.borrow_bps} / 1e4 / 252 ELSE 0 END AS bc FROM al),
tt AS (SELECT t, sum(lg) / {s} AS lg, sum(sg) / {s} AS sg, sum(le) / {s} AS le, sum(se) / {s} AS se, sum(tc) / {s} AS tc, sum(bc) / {s} AS bc FROM cs GROUP BY t),
led0 AS (SELECT c.date, coalesce(avg(daily_close_return), 0) AS benchmark_return, any_value(c.t) AS t FROM cl c JOIN market m ON m.date = c.date WHERE c.t BETWEEN (SELECT min(te) FROM cs) AND (SELECT max(tz) FROM cs) GROUP BY c.date),
led AS (SELECT date, benchmark_return, coalesce(lg, 0) AS long_gross_return, coalesce(sg, 0) AS short_gross_return, coalesce(tc, 0) AS transaction_cost, coalesce(bc, 0) AS borrow_cost, coalesce(le, 0) AS long_exposure, coalesce(se, 0) AS short_exposure_abs,
  coalesce(lg, 0) + coalesce(sg, 0) - coalesce(tc, 0) - coalesce(bc, 0) AS net_return FROM led0 LEFT JOIN tt USING (t)),
nav AS (SELECT *, product(1 + net_return) OVER w AS nav, product(1 + benchmark_return) OVER w AS benchmark_nav, net_return - benchmark_return AS active_return, long_gross_return + short_gross_return AS gross_return, long_exposure + short_exposure_abs AS gross_exposure, long_exposure - short_exposure_abs AS net_exposure FROM led WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""


_nav = ["benchmark_return", "long_gross_return", "short_gross_return", "transaction_cost", "borrow_cost", "long_exposure", "short_exposure_abs", "gross_return", "gross_exposure", "net_exposure", "net_return", "nav", "benchmark_nav", "active_return"]
_cfg = portfolio.Config(hold=6, step=2, delay=1, top_k=3, cost_bps=20.0, borrow_bps=50.0)


@query("long_short_ledger", f"{_ledger_sql(_cfg)} {tidied_sql(_nav, 'nav', 'date')}")
def long_short_ledger(spark, sf_dir):
    rows, market = _traded(spark, sf_dir)
    return tidied(portfolio.ledger(rows, market, _cfg))


@query("long_short_summary", f"""{_ledger_sql(_cfg)}, d AS (SELECT *, nav / greatest(max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM nav),
m AS (SELECT product(1 + net_return) - 1 AS r FROM nav GROUP BY date_trunc('month', date))
SELECT count(*) AS n_days, {tidy_sql('(max_by(nav, date) - 1)')} AS total_return, {tidy_sql('(stddev_samp(net_return) * sqrt(252))')} AS annual_volatility, {tidy_sql('(avg(net_return) / stddev_samp(net_return) * sqrt(252))')} AS sharpe, {tidy_sql('min(dd)')} AS max_drawdown, {tidy_sql('avg((net_return > 0)::INT)')} AS hit_ratio,
  {tidy_sql('sum(transaction_cost)')} AS transaction_cost, {tidy_sql('sum(borrow_cost)')} AS borrow_cost, (SELECT {tidy_sql('avg((r > 0)::INT)')} FROM m) AS month_hit_ratio, (SELECT count(*) FROM m) AS n_months FROM d""")
def long_short_summary(spark, sf_dir):
    out = portfolio.summarize(stored(portfolio.ledger(*_traded(spark, sf_dir), _cfg)))
    return tidied(out.select("n_days", "total_return", "annual_volatility", "sharpe", "max_drawdown", "hit_ratio", "transaction_cost", "borrow_cost", "month_hit_ratio", "n_months"))


_cells = [portfolio.Config(hold=h, step=2, delay=1, top_k=k, cost_bps=c, borrow_bps=50.0) for h in (4, 6) for k in (2, 3) for c in (10.0, 20.0)]
_total = """SELECT count(*) AS n_days, max_by(nav, date) - 1 AS total_return, stddev_samp(net_return) * sqrt(252) AS annual_volatility, avg(net_return) / stddev_samp(net_return) * sqrt(252) AS sharpe, min(dd) AS max_drawdown, sum(transaction_cost) AS transaction_cost
  FROM (SELECT *, nav / greatest(max(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM nav)"""
_grid_columns = ["total_return", "annual_volatility", "sharpe", "max_drawdown", "transaction_cost"]


@query("portfolio_grid", tidied_sql(_grid_columns, "(" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS cell, {x.hold}::BIGINT AS hold, {x.top_k}::BIGINT AS top_k, {x.cost_bps}::DOUBLE AS cost_bps, * FROM ({_ledger_sql(x)} {_total})" for i, x in enumerate(_cells)) + ")", "cell, hold, top_k, cost_bps, n_days"))
def portfolio_grid(spark, sf_dir):
    out = portfolio.grid(*_traded(spark, sf_dir), _cells)
    return tidied(out.select("cell", "hold", "top_k", "cost_bps", "n_days", *_grid_columns))


@query("trade_costs", f"""{_pred}, {_market}, {_books_sql(3)}, x AS (SELECT date, 1.0::DOUBLE AS long_weight, 1.0::DOUBLE AS short_weight FROM books GROUP BY date)
SELECT date, {tidy_sql('long_weight')} AS long_weight, {tidy_sql('short_weight')} AS short_weight, 4.0::DOUBLE AS gross_turnover, {tidy_sql('(4.0 * 20 / 1e4)')} AS turnover_cost, {tidy_sql('(50 / 1e4 * 5 / 252)')} AS borrow_cost_estimate FROM x""")
def trade_costs(spark, sf_dir):
    w = portfolio.side_weights(portfolio.books(_traded(spark, sf_dir)[0], 3))
    return tidied(portfolio.trade_summary(w, _cfg).select("date", "long_weight", "short_weight", "gross_turnover", "turnover_cost", "borrow_cost_estimate"))


@query("sector_exposure", f"""{_pred}, {_market}, {_books_sql(3)}, u AS (SELECT date, sector, count(*) / sum(count(*)) OVER (PARTITION BY date) AS universe_weight FROM merged GROUP BY date, sector),
o AS (SELECT date, sector, sum((side = 'long')::INT) / 3 AS long_weight, sum((side = 'short')::INT) / 3 AS short_weight_abs FROM books GROUP BY date, sector)
SELECT date, sector, {tidy_sql('coalesce(long_weight, 0)')} AS long_weight, {tidy_sql('coalesce(short_weight_abs, 0)')} AS short_weight_abs, {tidy_sql('universe_weight')} AS universe_weight FROM u LEFT JOIN o USING (date, sector) WHERE date IN (SELECT date FROM books)""")
def sector_exposure(spark, sf_dir):
    rows = _traded(spark, sf_dir)[0]
    return tidied(portfolio.sector_exposure(portfolio.side_weights(portfolio.books(rows, 3)), rows).select("date", "sector", "long_weight", "short_weight_abs", "universe_weight"))


@query("return_attribution")
def return_attribution(spark, sf_dir):
    rows, market = _traded(spark, sf_dir)
    return tidied(portfolio.attribution(portfolio.held_days(portfolio.sleeves(rows, _cfg), market), _cfg))


@query("long_only_weights", f"""{_pred}, {_market}, a AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY predicted_y DESC, instrument_id) > greatest(floor(round((count(*) OVER (PARTITION BY date, sector) / count(*) OVER (PARTITION BY date) + 0.1) * 4, 9)), 1) AS over FROM merged),
b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY over, predicted_y DESC, instrument_id) AS u FROM a), c AS (SELECT date, instrument_id, predicted_y FROM b WHERE u <= 4),
d AS (SELECT date, instrument_id, (count(*) OVER (PARTITION BY date) - row_number() OVER (PARTITION BY date ORDER BY predicted_y DESC, instrument_id) + 1) AS sc FROM c), e AS (SELECT date, instrument_id, sc / sum(sc) OVER (PARTITION BY date) AS weight FROM d) {tidied_sql(['weight'], 'e')}""")
def long_only_weights(spark, sf_dir):
    return tidied(portfolio.long_only(_traded(spark, sf_dir)[0], 4, "rank", None, 0.1).select(*KEYS, "weight"))


_swaps = f"""{_pred.replace('WITH panel', 'WITH RECURSIVE panel')}, {_market},
sa AS (SELECT *, greatest(floor(round((count(*) OVER (PARTITION BY date, sector) / count(*) OVER (PARTITION BY date) + 0.15) * 6, 9)), 1) AS most, row_number() OVER (PARTITION BY date, sector ORDER BY predicted_y DESC, instrument_id) AS us FROM merged WHERE predicted_y IS NOT NULL),
sn AS MATERIALIZED (SELECT date, instrument_id, sector, most, predicted_y AS p, coalesce(size_exposure_z, 0) AS z, row_number() OVER (PARTITION BY date ORDER BY us > most, predicted_y DESC, instrument_id) AS u FROM sa),
swaps AS (SELECT date, 0 AS k, list(instrument_id) AS held FROM sn WHERE u <= 6 GROUP BY date UNION ALL
  SELECT date, k + 1, list_append(list_filter(held, lambda x: x <> old), new) FROM (
    WITH g AS MATERIALIZED (SELECT date, any_value(k) AS k, any_value(s.held) AS held, round(sum(z) / count(*), 12) AS gap, count(*) AS n, list(sector) AS sectors FROM swaps s JOIN sn USING (date) WHERE list_contains(s.held, instrument_id) GROUP BY date HAVING abs(round(sum(z) / count(*), 12)) > 0.1),
    d AS (SELECT g.*, instrument_id AS old, z AS oz, p AS op, sector AS os, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN gap > 0 THEN -z ELSE z END, p, instrument_id) AS place FROM g JOIN sn USING (date) WHERE list_contains(held, instrument_id)),
    a AS (SELECT date, instrument_id AS new, z AS nz, p AS np, sector AS ns, most, len(list_filter(sectors, lambda x: x = sector)) AS there, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN gap > 0 THEN z ELSE -z END, p DESC, instrument_id) AS i FROM g JOIN sn USING (date) WHERE NOT list_contains(held, instrument_id)),
    c AS (SELECT *, round(abs(gap + (nz - oz) / n) + greatest(op - np, 0) * 5, 12) AS cost FROM d JOIN a USING (date) WHERE i <= 80 AND abs(gap + (nz - oz) / n) < abs(gap) - 1e-12 AND there + 1 - (os = ns)::INT <= most)
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY cost >= abs(gap), CASE WHEN cost < abs(gap) THEN place END, cost, place, i) AS best FROM c) WHERE best = 1 AND k < 50),
lw AS (SELECT date, max_by(held, k) AS held FROM swaps GROUP BY date)"""


@query("size_swaps", f"{_swaps} SELECT date, instrument_id, list_contains(held, instrument_id) AS chosen FROM sn JOIN lw USING (date)")
def size_swaps(spark, sf_dir):
    return portfolio.swap_towards_neutral_size(_traded(spark, sf_dir)[0], 6, 0.1, 0.15)


_lo_cfg = portfolio.Config(hold=6, step=2, delay=1, top_k=6, weights="rank")
_sleeves_sql = f"""{_swaps}, sd AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM merged)), md AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM market)),
hw AS (SELECT sd.date AS signal, sd.t // 2 AS k, e.date AS ex, z.date AS en FROM sd JOIN md USING (date) JOIN md e ON e.t = md.t + 1 JOIN md z ON z.t = md.t + 6 WHERE sd.t % 2 = 1),
bs AS (SELECT k, signal, ex, en, instrument_id, sector, count(*) OVER (PARTITION BY k) - row_number() OVER (PARTITION BY k ORDER BY p DESC, instrument_id) + 1 AS sc FROM hw JOIN sn ON sn.date = signal JOIN lw ON lw.date = signal WHERE list_contains(held, instrument_id)),
bw AS MATERIALIZED (SELECT *, sc / sum(sc) OVER (PARTITION BY k) AS weight FROM bs),
uw AS (SELECT k, instrument_id, sum(w) AS w, sum(o) AS o FROM (SELECT k, instrument_id, weight AS w, 0.0::DOUBLE AS o FROM bw UNION ALL SELECT k + 3, instrument_id, 0.0, weight FROM bw) GROUP BY 1, 2),
tr AS (SELECT k, sum(greatest(w - o, 0)) AS buy, sum(greatest(o - w, 0)) AS sell FROM uw GROUP BY 1)"""
_lo_columns = ["gross_return", "buy_cost", "sell_cost", "net_return", "benchmark_return", "turnover", "buy_turnover", "sell_turnover", "transaction_cost_bps", "active_size_exposure", "excess_return", "portfolio_nav", "benchmark_nav"]


@query("long_only_ledger", f"""{_sleeves_sql}, dl AS (SELECT k, m.date, sum(weight * daily_close_return) AS g FROM bw JOIN market m ON m.instrument_id = bw.instrument_id AND m.date > ex AND m.date <= en WHERE daily_close_return IS NOT NULL GROUP BY 1, 2),
dc AS (SELECT date, g, CASE WHEN date = min(date) OVER (PARTITION BY k) THEN buy / 3 * 8 / 1e4 ELSE 0 END AS b, CASE WHEN date = min(date) OVER (PARTITION BY k) THEN sell / 3 * 12 / 1e4 ELSE 0 END AS s FROM dl JOIN tr USING (k)),
pd AS (SELECT date, sum(g) AS gross_return, sum(b) AS buy_cost, sum(s) AS sell_cost, sum(g / 3 - b - s) AS net_return FROM dc GROUP BY 1),
us AS (SELECT date, avg(size_exposure_z) AS uz, avg((size_exposure_z IS NOT NULL)::INT) AS cover FROM merged GROUP BY 1),
xs AS (SELECT k, ex, CASE WHEN any_value(cover) >= 0.9 THEN sum(weight * size_exposure_z) / sum(weight) FILTER (size_exposure_z IS NOT NULL) END - any_value(uz) AS active FROM bw JOIN merged m ON m.date = signal AND m.instrument_id = bw.instrument_id JOIN us ON us.date = signal GROUP BY 1, 2),
ev AS (SELECT ex AS date, sum((buy + sell) / 2 / 3) AS turnover, sum(buy / 3) AS buy_turnover, sum(sell / 3) AS sell_turnover, sum((buy * 8 + sell * 12) / 3) AS transaction_cost_bps, avg(active) AS active FROM xs JOIN tr USING (k) GROUP BY 1),
bn AS (SELECT date, coalesce(avg(daily_close_return), 0) AS benchmark_return FROM market GROUP BY 1),
lo AS (SELECT pd.*, benchmark_return, coalesce(turnover, 0) AS turnover, coalesce(buy_turnover, 0) AS buy_turnover, coalesce(sell_turnover, 0) AS sell_turnover, coalesce(transaction_cost_bps, 0) AS transaction_cost_bps, coalesce(last_value(active IGNORE NULLS) OVER w, 0) AS active_size_exposure,
  net_return - benchmark_return AS excess_return, product(1 + net_return) OVER w AS portfolio_nav, product(1 + benchmark_return) OVER w AS benchmark_nav FROM pd LEFT JOIN ev USING (date) LEFT JOIN bn USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) {tidied_sql(_lo_columns, 'lo', 'date')}""")
def long_only_ledger(spark, sf_dir):
    rows, market = _traded(spark, sf_dir)
    return tidied(portfolio.long_only_ledger(rows, market, _lo_cfg, 8.0, 12.0, 0.15, 0.1).select("date", *_lo_columns))


_sector_means = ["average_portfolio_weight", "average_universe_weight", "average_active_weight", "average_abs_active_weight"]


@query("long_only_sectors", f"""{_sleeves_sql}, un AS (SELECT date, sector, count(*) / sum(count(*)) OVER (PARTITION BY date) AS u FROM merged WHERE date IN (SELECT signal FROM hw) GROUP BY 1, 2), ow AS (SELECT signal AS date, sector, sum(weight) AS w FROM bw GROUP BY 1, 2),
sm AS (SELECT sector, avg(coalesce(w, 0)) AS average_portfolio_weight, avg(u) AS average_universe_weight, avg(coalesce(w, 0) - u) AS average_active_weight, avg(abs(coalesce(w, 0) - u)) AS average_abs_active_weight FROM un LEFT JOIN ow USING (date, sector) GROUP BY 1) {tidied_sql(_sector_means, 'sm', 'sector')}""")
def long_only_sectors(spark, sf_dir):
    rows, market = _traded(spark, sf_dir)
    return tidied(portfolio.sector_summary(stored(portfolio.long_only_sleeves(rows, market, _lo_cfg, 0.15, 0.1)), rows))


@query("window_counts", f"""{_pred}, hi AS (SELECT max(date) AS e FROM pred), wn AS (SELECT 'last_' || m || 'm' AS mode, ((e - to_months(m))::DATE + 1)::DATE AS start, e AS "end" FROM hi, (SELECT unnest([3, 6, 12]) AS m) UNION ALL SELECT 'none', DATE '1900-01-01', DATE '1900-02-01')
SELECT mode, start, "end", count(date) AS rows, count(DISTINCT instrument_id) AS instruments, min(date) AS first_date, max(date) AS last_date FROM wn LEFT JOIN pred ON date BETWEEN start AND "end" GROUP BY 1, 2, 3""")
def window_counts(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    none = spark.sql("SELECT 'none' AS mode, DATE '1900-01-01' AS start, DATE '1900-02-01' AS end")
    return tidied(calendar.window_counts(rows, calendar.recent_windows(rows).unionByName(none)))


# ---- sources, joins, audits ----

from quantloom.operators import compare, formulas, joins, models, quality_audit, relation, selection  # noqa: E402
from quantloom.sources import panel_io  # noqa: E402

_load = ["open", "high", "low", "close", "vwap", "turnover", "next_open"]


@query("load_adjusted_panel", f"""WITH {tp.panel_sql()}, a AS (SELECT instrument_id::VARCHAR AS instrument_id, date, CASE WHEN adjustment > 0 THEN adjustment END AS f, open, high, low, close, vwap, turnover, volume, market_cap FROM panel),
b AS (SELECT instrument_id, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close, vwap * f AS vwap, turnover, CASE WHEN market_cap IS NULL THEN 'missing' ELSE 'reported' END AS market_cap_source FROM a),
x AS (SELECT *, lead(open) OVER (PARTITION BY instrument_id ORDER BY date) AS next_open FROM b) {tidied_sql(_load, 'x', 'instrument_id, date, market_cap_source')}""")
def load_adjusted_panel(spark, sf_dir):
    return tidied(panel_io.load_panel(tp.panel(spark, sf_dir), "vendor_adjusted").select(*KEYS, "market_cap_source", *_load))


@query("key_violations", f"WITH {tp.panel_sql()} SELECT 'duplicate_keys' AS kind, (SELECT count(*) - count(DISTINCT (instrument_id, date)) FROM panel) AS rows UNION ALL SELECT 'close_not_positive', count(*) FILTER (close <= 0) FROM panel UNION ALL SELECT 'negative_volume', count(*) FILTER (volume < 0) FROM panel")
def key_violations(spark, sf_dir):
    return tidied(panel_io.violations(tp.panel(spark, sf_dir)))


@query("liquidity_screen", f"""WITH {tp.panel_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM panel WHERE close > 0 AND volume > 0), g AS (SELECT instrument_id, count(*) AS valid_days, max_by(close, date) AS last_close, avg(close * volume) AS mean_turnover, quantile_cont(close * volume, 0.5) AS median_turnover FROM k WHERE k <= 60 GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY median_turnover DESC, instrument_id) AS liquidity_rank FROM g WHERE valid_days >= 40) SELECT instrument_id, valid_days, {tidy_sql('last_close')} AS last_close, {tidy_sql('mean_turnover')} AS mean_turnover, {tidy_sql('median_turnover')} AS median_turnover, liquidity_rank FROM r WHERE liquidity_rank <= 50""")
def liquidity_screen(spark, sf_dir):
    return tidied(panel_io.liquidity(tp.panel(spark, sf_dir), top=50))


@query("universe_filter", f"""WITH {tp.panel_sql()}, s AS (SELECT s_suppkey AS instrument_id FROM supplier WHERE s_acctbal > 0) SELECT instrument_id, date FROM panel SEMI JOIN s USING (instrument_id) WHERE date >= DATE '1995-01-01' AND date <= DATE '1996-12-31'""")
def universe_filter(spark, sf_dir):
    members = tp.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("long").alias("instrument_id"))
    return panel_io.only(tp.panel(spark, sf_dir), members, "1995-01-01", "1996-12-31").select(*KEYS)


@query("failed_symbols", f"WITH {tp.panel_sql()} SELECT s_suppkey::BIGINT AS instrument_id, 'no rows' AS reason FROM supplier WHERE s_suppkey NOT IN (SELECT instrument_id FROM panel WHERE date < DATE '1992-03-01')")
def failed_symbols(spark, sf_dir):
    asked = tp.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("instrument_id"))
    return panel_io.failed(asked, tp.panel(spark, sf_dir).where("date < '1992-03-01'"))


_fund = """st AS (SELECT *, coalesce(accepted_date, filing_date, report_date + 90) AS effective_date FROM fundamentals),
fq AS (SELECT *, CASE WHEN count(revenue) OVER w >= 4 THEN sum(revenue) OVER w END AS revenue_ttm, CASE WHEN count(net_income) OVER w >= 4 THEN sum(net_income) OVER w END AS nt, CASE WHEN count(equity) OVER w >= 2 THEN avg(equity) OVER w END AS ea, CASE WHEN count(assets) OVER w >= 2 THEN avg(assets) OVER w END AS aa,
  lag(revenue, 4) OVER o AS y4, lag(revenue, 1) OVER o AS q1 FROM st WINDOW o AS (PARTITION BY instrument_id ORDER BY report_date), w AS (PARTITION BY instrument_id ORDER BY report_date ROWS 3 PRECEDING)),
fr AS (SELECT instrument_id, report_date, effective_date, revenue_ttm, nt / CASE WHEN abs(ea) > 1e-8 THEN ea END AS roe, nt / CASE WHEN abs(aa) > 1e-8 THEN aa END AS roa, (revenue - y4) / CASE WHEN abs(y4) > 1e-8 THEN abs(y4) END AS yoy, (revenue - q1) / CASE WHEN abs(q1) > 1e-8 THEN abs(q1) END AS qoq FROM fq)"""
_fcols = ["revenue_ttm", "roe", "roa", "yoy", "qoq"]


def _quarters(spark, sf_dir):
    f = tp.fundamentals(spark, sf_dir)
    keys = ["instrument_id", "report_date", "filing_date", "accepted_date"]
    return joins.quarterly(joins.statements([f.select(*keys, "revenue", "net_income"), f.select(*keys, "assets", "equity")]))


@query("quarterly_statements", f"WITH {tp.FUNDAMENTALS_SQL}, {_fund} {tidied_sql(_fcols, 'fr', 'instrument_id, report_date, effective_date')}")
def quarterly_statements(spark, sf_dir):
    return tidied(_quarters(spark, sf_dir).select("instrument_id", "report_date", "effective_date", *_fcols))


@query("as_of_fundamentals", f"""WITH {tp.panel_sql()}, {tp.FUNDAMENTALS_SQL}, {_fund}, j AS (SELECT p.instrument_id, p.date, {', '.join(f'f.{x}' for x in _fcols)}, row_number() OVER (PARTITION BY p.instrument_id, p.date ORDER BY f.effective_date DESC, f.report_date DESC) AS k FROM panel p LEFT JOIN fr f ON f.instrument_id = p.instrument_id AND f.effective_date <= p.date)
{tidied_sql(_fcols, 'j')} WHERE k = 1""")
def as_of_fundamentals(spark, sf_dir):
    return tidied(joins.as_of(tp.panel(spark, sf_dir), _quarters(spark, sf_dir), _fcols).select(*KEYS, *_fcols))


@query("fundamental_context", f"""WITH {tp.panel_sql()}, {tp.FUNDAMENTALS_SQL}, {_fund}, j AS (SELECT p.instrument_id, p.date, f.roe, f.roa, f.yoy, f.qoq, row_number() OVER (PARTITION BY p.instrument_id, p.date ORDER BY f.effective_date DESC, f.report_date DESC) AS k FROM panel p LEFT JOIN fr f ON f.instrument_id = p.instrument_id AND f.effective_date <= p.date),
c AS (SELECT instrument_id, date, roe, (coalesce(roe, 0) + coalesce(roa, 0)) / nullif((roe IS NOT NULL)::INT + (roa IS NOT NULL)::INT, 0) AS profitability_combo, (coalesce(yoy, 0) + coalesce(qoq, 0)) / nullif((yoy IS NOT NULL)::INT + (qoq IS NOT NULL)::INT, 0) AS growth_combo FROM j WHERE k = 1),
r AS (SELECT *, CASE WHEN roe IS NOT NULL THEN (rank() OVER (PARTITION BY date, roe IS NULL ORDER BY roe) + (count(*) OVER (PARTITION BY date, roe) - 1) / 2) / count(roe) OVER (PARTITION BY date) END AS roe_rank FROM c) {tidied_sql(['profitability_combo', 'growth_combo', 'roe_rank'], 'r')}""")
def fundamental_context(spark, sf_dir):
    df = joins.as_of(tp.panel(spark, sf_dir), _quarters(spark, sf_dir), _fcols)
    return tidied(features.fundamental_context(df).select(*KEYS, "profitability_combo", "growth_combo", "roe_rank"))


@query("macro_merge", f"""WITH {tp.panel_sql()}, {tp.MACRO_SQL}, d AS (SELECT date, last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix FROM (SELECT DISTINCT date FROM panel) LEFT JOIN macro USING (date)), j AS (SELECT instrument_id, date, vix FROM panel LEFT JOIN d USING (date)) {tidied_sql(['vix'], 'j')}""")
def macro_merge(spark, sf_dir):
    return tidied(joins.merge_macro(tp.panel(spark, sf_dir), tp.macro(spark, sf_dir), ["vix"]).select(*KEYS, "vix"))


@query("macro_coverage", f"""WITH {tp.panel_sql()}, {tp.MACRO_SQL}, d AS (SELECT date, last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix FROM (SELECT DISTINCT date FROM panel) LEFT JOIN macro USING (date)), j AS (SELECT date, vix FROM panel LEFT JOIN d USING (date))
SELECT 'vix' AS "column", (SELECT count(vix) FROM macro) AS macro_rows, (SELECT {tidy_sql('avg((vix IS NOT NULL)::INT)')} FROM macro) AS macro_share, count(vix) AS merged_rows, {tidy_sql('avg((vix IS NOT NULL)::INT)')} AS merged_share, min(date) FILTER (vix IS NOT NULL) AS first_date, max(date) FILTER (vix IS NOT NULL) AS last_date FROM j""")
def macro_coverage(spark, sf_dir):
    macro = tp.macro(spark, sf_dir).select("date", "vix")
    return tidied(joins.macro_coverage(macro, joins.merge_macro(tp.panel(spark, sf_dir), macro, ["vix"])))


_ca = f"""ca AS (SELECT instrument_id, date, close AS raw_close, close * adjustment AS adjusted_close, adjustment, lag(adjustment) OVER w AS a, lag(close) OVER w AS r, lag(close * adjustment) OVER w AS d FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY date)),
cb AS (SELECT *, (adjustment - a) / CASE WHEN abs(a) > 1e-8 THEN abs(a) END AS adjustment_change, raw_close / CASE WHEN abs(r) > 1e-8 THEN r END - 1 AS raw_return, adjusted_close / CASE WHEN abs(d) > 1e-8 THEN d END - 1 AS adjusted_return FROM ca),
cc AS (SELECT *, CASE WHEN abs(adjusted_return) > 0.2 AND NOT abs(raw_return) > 0.2 THEN 'adjusted_only_jump' WHEN abs(raw_return) > 0.2 AND NOT abs(adjusted_return) > 0.2 THEN 'raw_jump_explained' WHEN abs(raw_return) > 0.2 THEN 'both_jump' ELSE 'quiet' END AS flag FROM cb WHERE abs(adjustment_change) > 1e-6)"""


@query("corporate_actions", f"WITH {tp.panel_sql()}, {_ca} SELECT instrument_id, date, flag, CASE flag WHEN 'adjusted_only_jump' THEN 1 WHEN 'both_jump' THEN 2 ELSE 3 END::BIGINT AS priority, {tidy_sql('adjustment_change')} AS adjustment_change, {tidy_sql('raw_return')} AS raw_return, {tidy_sql('adjusted_return')} AS adjusted_return FROM cc")
def corporate_actions(spark, sf_dir):
    return tidied(quality_audit.corporate_actions(tp.panel(spark, sf_dir)).select(*KEYS, "flag", "priority", "adjustment_change", "raw_return", "adjusted_return"))


@query("corporate_action_summary", f"WITH {tp.panel_sql()}, {_ca} SELECT flag, count(*) AS events, count(DISTINCT instrument_id) AS instruments, {tidy_sql('max(abs(adjustment_change))')} AS largest_change FROM cc GROUP BY flag")
def corporate_action_summary(spark, sf_dir):
    return tidied(quality_audit.corporate_action_summary(quality_audit.corporate_actions(tp.panel(spark, sf_dir))))


@query("coverage_audit", f"""WITH {tp.panel_sql(every='week')}, {_cal}, n AS (SELECT max(t) AS n FROM cal), g AS (SELECT instrument_id, min(date) AS first_date, max(date) AS last_date, count(*) AS observations, min(t) - 1 AS late, any_value(n) - max(t) AS early, count(*) / any_value(n) AS coverage FROM pt, n GROUP BY 1)
SELECT instrument_id, first_date, last_date, observations, late, early, {tidy_sql('coverage')} AS coverage, concat_ws(';', CASE WHEN late >= 20 THEN 'late_start' END, CASE WHEN early >= 20 THEN 'early_end' END, CASE WHEN observations < 300 THEN 'short_history' END, CASE WHEN coverage < 0.8 THEN 'low_coverage' END) AS reasons FROM g""")
def coverage_audit(spark, sf_dir):
    return tidied(quality_audit.coverage(tp.panel(spark, sf_dir, "week"), least=300).select("instrument_id", "first_date", "last_date", "observations", "late", "early", "coverage", "reasons"), ("instrument_id",))


@query("panel_profile", f"""WITH {tp.panel_sql()}, x AS (SELECT *, close / lag(close) OVER w - 1 AS r, lag(close) OVER w = close AND volume > 0 AS st FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY date)), h AS (SELECT instrument_id, count(*) AS n FROM panel GROUP BY 1)
SELECT count(*) AS rows, count(DISTINCT instrument_id) AS instruments, count(DISTINCT date) AS dates, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS order_violations, count(*) FILTER (st) AS stale_closes, count(*) FILTER (abs(r) > 0.5) AS extreme_returns, (SELECT min(n) FROM h) AS shortest_history, (SELECT {tidy_sql('quantile_cont(n, 0.5)')} FROM h) AS median_history, (SELECT max(n) FROM h) AS longest_history FROM x""")
def panel_profile(spark, sf_dir):
    return tidied(quality_audit.profile(tp.panel(spark, sf_dir)).select("rows", "instruments", "dates", "order_violations", "stale_closes", "extreme_returns", "shortest_history", "median_history", "longest_history"))


@query("column_coverage", f"WITH {tp.MACRO_SQL} SELECT 'vix' AS column, count(vix) AS values, {tidy_sql('(count(vix) / count(*))')} AS share FROM macro UNION ALL SELECT 'us3m', count(us3m), {tidy_sql('(count(us3m) / count(*))')} FROM macro")
def column_coverage(spark, sf_dir):
    return tidied(quality_audit.column_coverage(tp.macro(spark, sf_dir), ["vix", "us3m"]))


# ---- relation graph ----

_rret = "rets AS (SELECT date, instrument_id, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, close / lag(close, 20) OVER w - 1 AS ret_20 FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY date))"


def _peer(n):
    return f"sum(weight * ret_{n}) / nullif(sum(CASE WHEN ret_{n} IS NOT NULL THEN weight END), 0) AS peer_ret_{n}, sum(CASE WHEN same_sector THEN weight * ret_{n} END) / nullif(sum(CASE WHEN same_sector THEN weight END), 0) AS sector_peer_ret_{n}"


@query("relation_features", f"""WITH {tp.panel_sql()}, {tp.EDGES_SQL}, {_rret}, f AS (SELECT e.date, e.target AS instrument_id, count(*) AS peers, sum(weight) AS weight_sum, {_peer(1)}, {_peer(5)}, max(CASE WHEN rank = 1 THEN ret_1 END) AS top_peer_ret_1, stddev_samp(ret_1) AS peer_std_1 FROM edges e LEFT JOIN rets r ON r.date = e.date AND r.instrument_id = e.source GROUP BY 1, 2)
SELECT instrument_id, date, peers, {', '.join(f'{tidy_sql(x)} AS {x}' for x in ('weight_sum', 'peer_ret_1', 'sector_peer_ret_1', 'peer_ret_5', 'sector_peer_ret_5', 'top_peer_ret_1', 'peer_std_1'))} FROM f""")
def relation_features(spark, sf_dir):
    out = relation.relation_features(tp.edges(spark, sf_dir), relation.market_returns(tp.panel(spark, sf_dir)))
    return tidied(out.select(*KEYS, "peers", "weight_sum", "peer_ret_1", "sector_peer_ret_1", "peer_ret_5", "sector_peer_ret_5", "top_peer_ret_1", "peer_std_1"))


@query("lagged_relations", f"""WITH {tp.panel_sql()}, {tp.EDGES_SQL}, g AS (SELECT date, instrument_id, lag(volume, 1) OVER w AS v1, lag(volume, 2) OVER w AS v2 FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY date)), f AS (SELECT e.date, target AS instrument_id, sum(weight * v1) / sum(CASE WHEN v1 IS NOT NULL THEN weight END) AS rel_volume_1, sum(weight * v2) / sum(CASE WHEN v2 IS NOT NULL THEN weight END) AS rel_volume_2 FROM edges e JOIN g ON g.date = e.date AND g.instrument_id = source GROUP BY 1, 2)
{tidied_sql(['rel_volume_1', 'rel_volume_2'], 'f')} WHERE rel_volume_1 IS NOT NULL OR rel_volume_2 IS NOT NULL""")
def lagged_relations(spark, sf_dir):
    return tidied(relation.lagged_relations(tp.edges(spark, sf_dir), tp.panel(spark, sf_dir).select(*KEYS, "volume"), ["volume"]).select(*KEYS, "rel_volume_1", "rel_volume_2"))


# ---- formulas and selection ----

_specs = {"f_spread": ("spread", ("rank", "volume"), ("rank", "vwap")), "f_ratio": ("ratio", "volume", ("tanh", "close")), "f_confirm": ("confirm", ("neg", "close"), ("spread", "open", "close")), "f_blend": ("blend", ("rank", "close"), ("abs", ("rank", "low")), 0.3), "f_square": ("signed_sq", ("interaction", ("rank", "high"), "volume"))}
_compiled = {k: formulas.compile_spec(s) for k, s in _specs.items()}
SQL["formula_candidates"] = factor_query(_compiled)


@query("formula_candidates")
def formula_candidates(spark, sf_dir):
    return tidied(formulas.evaluate(factors.prepare(tp.panel(spark, sf_dir)), _specs))


@query("formula_diagnostics")
def formula_diagnostics(spark, sf_dir):
    df = _panel(spark, sf_dir)
    signals = formulas.standardized(formulas.evaluate(factors.prepare(df), _specs), list(_specs))
    signals = signals.withColumns({x: F.round(x, 9) for x in _specs})  # differences of ranks that are equal stay equal
    return tidied(diagnostics.factor_summary(stored(signals.join(tp.predictions(df), ["instrument_id", "date"])), list(_specs)))


@query("formula_tokens", "SELECT p_partkey AS part, len(list_distinct(regexp_extract_all(p_name, '[A-Za-z_][A-Za-z0-9_]*'))) AS n FROM part")
def formula_tokens(spark, sf_dir):
    return tp.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.size(formulas.tokens(F.col("p_name"))).cast("long").alias("n"))


def _canonical(spark, sf_dir):
    """The canonical factors beside the next date's return."""
    df = _panel(spark, sf_dir)
    return stored(factors.factors(df, factors.CANONICAL).join(tp.predictions(df).drop("predicted_y"), list(KEYS)))


@query("select_features")
def select_features(spark, sf_dir):
    df = _canonical(spark, sf_dir)
    return tidied(selection.table(df, list(factors.CANONICAL), top=6))


@query("feature_scores", f"""{_pred}, {_long}, m AS (SELECT factor, quantile_cont(value, 0.5) AS md FROM lf GROUP BY 1), fp AS (SELECT lf.factor, date, y, coalesce(value, md) AS value FROM lf JOIN m USING (factor) WHERE y IS NOT NULL), ic AS (SELECT factor, date, {_corr.format(a='value', b='y')} AS ic FROM fp GROUP BY 1, 2)
SELECT factor AS feature, {tidy_sql('coalesce(abs(avg(ic)), 0)')} AS score FROM ic GROUP BY 1""")
def feature_scores(spark, sf_dir):
    return tidied(selection.scores(_signals(spark, sf_dir), _sig))


@query("dynamic_combination")
def dynamic_combination(spark, sf_dir):
    rows = diagnostics.long_form(_signals(spark, sf_dir).where("y is not null"), ["volume", "vwap"], ("date", "instrument_id", "y")).withColumnRenamed("value", "predicted_y")
    spreads = diagnostics.long_short_by_date(rows, 0.3, by=("factor",)).select("factor", "date", "spread")
    return tidied(formulas.dynamic_combination(spreads))


SQL["dynamic_combination"] = f"""{_pred}, u AS (SELECT p.date, p.instrument_id, y, 'volume' AS factor, volume AS v FROM panel p JOIN pred USING (date, instrument_id) WHERE y IS NOT NULL UNION ALL SELECT p.date, p.instrument_id, y, 'vwap', vwap FROM panel p JOIN pred USING (date, instrument_id) WHERE y IS NOT NULL),
k AS (SELECT *, floor(count(*) OVER (PARTITION BY factor, date) * 0.3) AS k, row_number() OVER (PARTITION BY factor, date ORDER BY v DESC, instrument_id) AS a, row_number() OVER (PARTITION BY factor, date ORDER BY v, instrument_id) AS b FROM u),
s AS (SELECT factor, date, avg(y) FILTER (a <= k) - avg(y) FILTER (b <= k) AS spread FROM k GROUP BY 1, 2),
r AS (SELECT *, greatest(avg(spread) OVER w / CASE WHEN stddev_pop(spread) OVER w > 1e-12 THEN stddev_pop(spread) OVER w END, 0) AS ir FROM s WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN sum(coalesce(ir, 0)) OVER d > 1e-12 THEN coalesce(ir, 0) / sum(coalesce(ir, 0)) OVER d ELSE 1.0 / count(*) OVER d END AS w FROM r WINDOW d AS (PARTITION BY date))
SELECT date, {tidy_sql('sum(w * spread)')} AS combined FROM t GROUP BY date"""


# ---- models and comparisons ----


@query("ridge_predictions")
def ridge_predictions(spark, sf_dir):
    train, test = calendar.split(_canonical(spark, sf_dir))
    train = stored(calendar.purge(train.where("y is not null"), 1))
    chosen = selection.fit(train, list(factors.CANONICAL), top=5)
    model = models.fit(selection.transform(train, chosen, (*KEYS, "y")), chosen.features, "ridge")
    return tidied(models.predict(model, selection.transform(test, chosen, (*KEYS, "y"))).select(*KEYS, "y", "predicted_y"))


@query("model_weights", f"{_pred}, {_ic} SELECT model, {tidy_sql('(CASE WHEN s > 0 THEN 0.5 * g / s + 0.5 / n ELSE 1.0 / n END)::DOUBLE')} AS weight FROM (SELECT *, sum(g) OVER () AS s, count(*) OVER () AS n FROM (SELECT model, CASE WHEN score > 0 THEN score ELSE 0 END AS g FROM (SELECT 'a' AS model, avg(ic) AS score FROM ic UNION ALL SELECT 'b', avg(rank_ic) FROM ic UNION ALL SELECT 'c', max(ic) FROM ic)))")
def model_weights(spark, sf_dir):
    ic = diagnostics.daily_ic(_predictions(spark, sf_dir)).agg(F.avg("ic").alias("a"), F.avg("rank_ic").alias("b"), F.max("ic").alias("c"))
    return tidied(models.model_weights(ic.unpivot([], ["a", "b", "c"], "model", "score")))


@query("ensemble", f"""{_pred} SELECT date, instrument_id, {tidy_sql('y')} AS y, {tidy_sql('((0.7 * predicted_y + 0.3 * predicted_y * predicted_y) / 1.0)')} AS predicted_y FROM pred""")
def ensemble(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    both = p.withColumn("model", F.lit("a")).unionByName(p.withColumn("model", F.lit("b")).withColumn("predicted_y", F.col("predicted_y") * F.col("predicted_y"))).unionByName(p.withColumn("model", F.lit("c")))
    weights = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", -1.0)], "model string, weight double")
    return tidied(models.ensemble(both, weights))


_views = """x AS (SELECT year(date)::VARCHAR AS w, r_name AS experiment, avg(close) AS total_return, avg(volume) AS sharpe FROM panel JOIN region ON r_name = sector GROUP BY 1, 2)"""


def _view_rows(spark, sf_dir):
    return tp.panel(spark, sf_dir).groupBy(F.year("date").cast("string").alias("w"), F.col("sector").alias("experiment")).agg(F.avg("close").alias("total_return"), F.avg("volume").alias("sharpe"))


@query("experiment_views", f"WITH {tp.panel_sql()}, {_views} SELECT experiment, {tidy_sql('avg(total_return)')} AS avg_total_return, {tidy_sql('min(total_return)')} AS min_total_return, {tidy_sql('avg(sharpe)')} AS avg_sharpe, {tidy_sql('min(sharpe)')} AS min_sharpe, count(*) AS windows, count(*) FILTER (total_return > 0) AS positive_windows, {tidy_sql('avg((total_return > 0)::INT)')} AS positive_share FROM x GROUP BY 1")
def experiment_views(spark, sf_dir):
    return tidied(compare.views(_view_rows(spark, sf_dir), ["experiment"], ["total_return", "sharpe"]))


_deltas = "dl AS (SELECT a.w, a.experiment, a.total_return - b.total_return AS delta_total_return, a.sharpe - b.sharpe AS delta_sharpe FROM x a JOIN x b ON a.w = b.w AND b.experiment = 'ASIA' WHERE a.experiment <> 'ASIA')"


@query("experiment_deltas", f"WITH {tp.panel_sql()}, {_views}, {_deltas} {tidied_sql(['delta_total_return', 'delta_sharpe'], 'dl', 'w, experiment')}")
def experiment_deltas(spark, sf_dir):
    return tidied(compare.deltas(_view_rows(spark, sf_dir), ["w"], ["total_return", "sharpe"], "experiment", "ASIA"))


@query("experiment_verdicts", f"WITH {tp.panel_sql()}, {_views}, {_deltas}, v AS (SELECT experiment, avg(delta_total_return) AS a, avg(delta_sharpe) AS b, count(*) AS windows, count(*) FILTER (delta_total_return > 0) AS positive_windows FROM dl GROUP BY 1) SELECT experiment, windows, positive_windows, ((a > 0)::INT + (b > 0)::INT)::BIGINT AS positive_core, (a > 0)::INT + (b > 0)::INT >= 2 AND positive_windows >= 2 AND positive_windows / windows >= 0.5 AS accepted FROM v")
def experiment_verdicts(spark, sf_dir):
    d = compare.deltas(_view_rows(spark, sf_dir), ["w"], ["total_return", "sharpe"], "experiment", "ASIA")
    return tidied(compare.verdicts(d, ["experiment"], ["delta_total_return", "delta_sharpe"]).select("experiment", "windows", "positive_windows", "positive_core", "accepted"))


@query("experiment_checks", f"WITH {tp.panel_sql()}, {_views}, a AS (SELECT experiment, avg(total_return) AS t, avg(sharpe) AS s FROM x GROUP BY 1), c AS (SELECT experiment, (t > 1500)::INT + (s < 190)::INT AS passed FROM a) SELECT experiment, passed::BIGINT AS passed, 2::BIGINT AS checks, row_number() OVER (ORDER BY passed DESC, experiment) AS place FROM c")
def experiment_checks(spark, sf_dir):
    a = _view_rows(spark, sf_dir).groupBy("experiment").agg(F.avg("total_return").alias("t"), F.avg("sharpe").alias("s"))
    return tidied(compare.acceptance_ranking(compare.acceptance(a, {"return": ("t", ">", 1500.0), "risk": ("s", "<", 190.0)})))
