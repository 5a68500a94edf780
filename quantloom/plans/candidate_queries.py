"""Registered queries of candidates, the strict path and small merges, and their SQL; written apart from the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.tables import stored
from quantloom.operators import calendar, candidates, diagnostics, factors, models
from quantloom.sources import tables

from . import queries as base
from . import testpanel as tp
from .queries import KEYS, SQL, _corr, _fic, _long, _pred, _sig, query, tidied, tidied_sql
from .testpanel import tidy_sql

# ---- summaries of factors ----

_part = lambda p, x: f"avg({x}) AS {p}_mean, quantile_cont({x}, 0.5) AS {p}_median, stddev_pop({x}) AS {p}_std, avg({x}) / CASE WHEN stddev_pop({x}) > 1e-12 THEN stddev_pop({x}) END AS {p}_icir, avg(({x} > 0)::INT) AS {p}_positive_ratio, count({x}) AS {p}_n_dates"
_factor_summary = f"""{_pred}, {_long}, {_fic}, si AS (SELECT factor, {_part('ic', 'ic')}, {_part('rank_ic', 'rank_ic')} FROM fic GROUP BY factor),
cv AS (SELECT factor, avg((value IS NOT NULL)::INT) AS coverage FROM lf GROUP BY factor),
qa AS (SELECT factor, date, y, count(*) OVER d AS n, max(value) OVER d > min(value) OVER d AS varied, row_number() OVER (PARTITION BY factor, date ORDER BY value, instrument_id) AS k FROM lf WHERE y IS NOT NULL AND value IS NOT NULL WINDOW d AS (PARTITION BY factor, date)),
qb AS (SELECT factor, date, least(greatest(ceil(k / n * 5), 1), 5) AS g, avg(y) AS r FROM qa WHERE n >= 5 AND varied GROUP BY 1, 2, 3),
qc AS (SELECT factor, g, avg(r) AS r FROM qb GROUP BY 1, 2), qd AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY r)::DOUBLE AS k FROM qc),
qe AS (SELECT factor, max_by(r, g) - min_by(r, g) AS spread, {_corr.format(a='g::DOUBLE', b='k')} AS monotonicity FROM qd GROUP BY factor),
ta AS (SELECT *, count(*) OVER (PARTITION BY factor, date) AS n FROM lf WHERE value IS NOT NULL),
tb AS (SELECT factor, instrument_id, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2) / n AS p, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, instrument_id) <= ceil(n * 0.2) AS top, dense_rank() OVER (PARTITION BY factor ORDER BY date) AS k FROM ta WHERE n >= 5),
tc AS (SELECT a.factor, a.k, avg(abs(a.p - b.p)) AS change, sum((a.top AND b.top)::INT) AS stay, count(*) AS common FROM tb a JOIN tb b ON a.factor = b.factor AND a.instrument_id = b.instrument_id AND b.k + 1 = a.k GROUP BY 1, 2),
td AS (SELECT factor, k + 1 AS k, sum(top::INT) AS were FROM tb GROUP BY 1, 2),
te AS (SELECT factor, avg(change) AS rank_turnover, avg(stay / nullif(were, 0)) AS retention, count(*) AS transitions FROM tc JOIN td USING (factor, k) WHERE common >= 2 GROUP BY factor),
summary AS (SELECT * FROM cv LEFT JOIN si USING (factor) LEFT JOIN qe USING (factor) LEFT JOIN te USING (factor))"""
_summary_columns = ["coverage", *(f"{p}_{x}" for p in ("ic", "rank_ic") for x in ("mean", "median", "std", "icir", "positive_ratio")), "spread", "monotonicity", "rank_turnover", "retention"]
SQL["factor_summary"] = tidied_sql(_summary_columns, "summary", "factor, ic_n_dates, rank_ic_n_dates, transitions").replace("SELECT", f"{_factor_summary} SELECT", 1)

SQL["return_attribution"] = f"""{base._ledger_sql(base._cfg)}, own AS (SELECT instrument_id, sum(w * r / {base._cfg.sleeves}) AS contribution, count(DISTINCT sd) AS sleeves FROM hd WHERE sd IN (FROM ok) GROUP BY 1)
SELECT instrument_id, {tidy_sql('contribution')} AS contribution, sleeves, {tidy_sql('(abs(contribution) / sum(abs(contribution)) OVER ())')} AS share FROM own"""

_cut = lambda a, b: f"{b} AS (SELECT *, CASE WHEN fixed OR w > cap THEN cap ELSE w * (1 - cap * count(*) FILTER (fixed OR w > cap) OVER s) / sum(w) FILTER (NOT (fixed OR w > cap)) OVER s END AS v, fixed OR w > cap AS f FROM {a} WINDOW s AS (PARTITION BY date, side))"
_pass = lambda a, b: f"{_cut(a, a + '_cut')}, {b} AS (SELECT date, instrument_id, side, cap, v AS w, f AS fixed FROM {a}_cut)"
SQL["capped_weights"] = f"""{_pred}, {base._market}, {base._books_sql(4)}, r0 AS (SELECT date, instrument_id, side, count(*) OVER s - row_number() OVER (PARTITION BY date, side ORDER BY CASE WHEN side = 'long' THEN predicted_y ELSE -predicted_y END DESC, instrument_id) + 1 AS sc, greatest(0.3, 1.0 / count(*) OVER s) AS cap FROM books WINDOW s AS (PARTITION BY date, side)),
w0 AS (SELECT date, instrument_id, side, cap, sc / sum(sc) OVER (PARTITION BY date, side) AS w, false AS fixed FROM r0), {_pass('w0', 'w1')}, {_pass('w1', 'w2')}, {_pass('w2', 'w3')}, {_pass('w3', 'w4')}
SELECT date, instrument_id, side, {tidy_sql("(CASE WHEN side = 'long' THEN w ELSE -w END)")} AS weight FROM w4"""


_names = list(base._specs)
_in_day = lambda x: f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, 0.01) OVER d), quantile_cont({x}, 0.99) OVER d) END AS {x}"
_unit = lambda x: f"CASE WHEN stddev_pop({x}) OVER d > 1e-12 THEN ({x} - avg({x}) OVER d) / CASE WHEN stddev_pop({x}) OVER d > 1e-12 THEN stddev_pop({x}) OVER d END END"
_form_long = f"""{base.PREPARED}, {base.ctes(base._compiled, 'prepared', KEYS)}, fw AS (SELECT instrument_id, date, {', '.join(map(_in_day, _names))} FROM factor_values WINDOW d AS (PARTITION BY date)), fs AS (SELECT instrument_id, date, {', '.join(f'round({_unit(x)}, 9) AS {x}' for x in _names)} FROM fw WINDOW d AS (PARTITION BY date)),
lf AS (SELECT s.date, s.instrument_id, y, u.f AS factor, u.v AS value FROM fs s JOIN pred USING (date, instrument_id), LATERAL (SELECT unnest({_names}) AS f, unnest([{', '.join(_names)}]) AS v) u)"""
SQL["formula_diagnostics"] = tidied_sql(_summary_columns, "summary", "factor, ic_n_dates, rank_ic_n_dates, transitions").replace("SELECT", f"{_factor_summary.replace(_long, _form_long)} SELECT", 1)


# ---- rewards ----

_metrics = "pearson_ic_mean, spearman_ic_mean, pearson_ic_ir, spearman_ic_ir, pearson_ic_positive_ratio, spearman_ic_positive_ratio, long_short_spread, group_monotonic_spearman".split(", ")


def _candidates(spark, sf_dir):
    """(method, candidate tables) with the metrics of three signals before and after the middle of the dates."""
    rows = base._signals(spark, sf_dir)
    rows = stored(calendar.halves(rows))
    parts = []
    for half, prefix in ((1, "train_"), (2, "oos_")):
        s = diagnostics.factor_summary(rows.where(F.col("half") == half), _sig)
        named = ["ic_mean", "rank_ic_mean", "ic_icir", "rank_ic_icir", "ic_positive_ratio", "rank_ic_positive_ratio", "spread", "monotonicity"]
        parts.append(s.select(F.col("factor").alias("candidate_id"), *(F.col(a).alias(prefix + b) for a, b in zip(named, _metrics, strict=True))))
    both = parts[0].join(parts[1], "candidate_id")
    both = both.withColumns({"formula": F.col("candidate_id"), "complexity": F.length("candidate_id").cast("double"), "passes_oos_filter": F.col("oos_pearson_ic_mean") > 0})
    return stored(candidates.tagged_runs({"a": both, "b": both.where("candidate_id <> 'vwap'").withColumn("financial_logic_score", F.lit(0.5))}))


def _half_sql(half, prefix):
    """The summary of one half of the dates as a table."""
    body = _factor_summary.split(f"{_pred}, ", 1)[1].replace(_long, _long.replace("JOIN pred USING (date, instrument_id)", f"JOIN pred USING (date, instrument_id) JOIN hv USING (date)").replace(", LATERAL", ", LATERAL", 1), 1)
    body = body.replace(" u)", f" u WHERE half = {half})", 1)
    return f"{prefix} AS MATERIALIZED (WITH {body} SELECT factor, ic_mean, rank_ic_mean, ic_icir, rank_ic_icir, ic_positive_ratio, rank_ic_positive_ratio, spread, monotonicity FROM summary)"


def _z(x):
    return f"coalesce({x}, 0)"


def _reward_sql(mode, p, logic):
    x = {m: _z(f"{p}.{a}") for m, a in zip(_metrics, ["ic_mean", "rank_ic_mean", "ic_icir", "rank_ic_icir", "ic_positive_ratio", "rank_ic_positive_ratio", "spread", "monotonicity"], strict=True)}
    over = lambda m: f"greatest({x[m]} - 0.5, 0)"
    size = "greatest(length(t.factor) - 1, 0)"
    if mode == "predictive_ic":
        return f"({x['pearson_ic_mean']} + 0.5 * {x['spearman_ic_mean']} + 0.75 * {x['long_short_spread']} + 0.02 * {x['group_monotonic_spearman']} + 0.05 * {over('pearson_ic_positive_ratio')} + 0.03 * {over('spearman_ic_positive_ratio')} + 0.02 * {logic} - 0.003 * {size})"
    cut = lambda m, k: f"greatest(least({x[m]}, {k}), -{k})"
    return f"(0.25 * {x['pearson_ic_mean']} + 0.75 * {x['spearman_ic_mean']} + 1.2 * {x['long_short_spread']} + 0.05 * {x['group_monotonic_spearman']} + 0.025 * {cut('pearson_ic_ir', 3)} + 0.035 * {cut('spearman_ic_ir', 3)} + 0.04 * {over('pearson_ic_positive_ratio')} + 0.06 * {over('spearman_ic_positive_ratio')} + 0.04 * {logic} - 0.012 * {size})"


_rewards = ["selection_predictive_ic_reward", "oos_predictive_ic_reward", "selection_incremental_proxy_reward", "oos_incremental_proxy_reward"]
_four = lambda logic: ", ".join(f"{_reward_sql(m, p, logic)} AS {k}_{m}_reward" for m in ("predictive_ic", "incremental_proxy") for k, p in (("selection", "t"), ("oos", "o")))
_cands = f"""{_pred}, hc AS (SELECT date, CASE WHEN t <= (SELECT max(t) FROM cal) // 2 THEN 1 ELSE 2 END AS half FROM cal), hv AS (SELECT * FROM hc), {_half_sql(1, 'first_half')}, {_half_sql(2, 'second_half')},
cands AS (SELECT 'a' AS method, t.factor AS candidate_id, o.ic_mean AS oos_pearson_ic_mean, o.rank_ic_mean AS oos_spearman_ic_mean, o.spread AS oos_long_short_spread, {_four('0')} FROM first_half t JOIN second_half o USING (factor)
  UNION ALL SELECT 'b', t.factor, o.ic_mean, o.rank_ic_mean, o.spread, {_four('0.5')} FROM first_half t JOIN second_half o USING (factor) WHERE t.factor <> 'vwap')"""


@query("candidate_rewards", f"{_cands} {tidied_sql(_rewards, 'cands', 'method, candidate_id')}")
def candidate_rewards(spark, sf_dir):
    return tidied(_candidates(spark, sf_dir).select("method", "candidate_id", *_rewards))


_oos = ["oos_pearson_ic_mean", "oos_spearman_ic_mean", "oos_long_short_spread"]


@query("method_rewards", f"""{_cands}, ml AS (SELECT *, 'predictive_ic' AS reward_mode, selection_predictive_ic_reward AS s, oos_predictive_ic_reward AS o FROM cands UNION ALL SELECT *, 'incremental_proxy', selection_incremental_proxy_reward, oos_incremental_proxy_reward FROM cands),
mk AS (SELECT *, row_number() OVER (PARTITION BY method, reward_mode ORDER BY s DESC, candidate_id) AS k FROM ml)
SELECT method, reward_mode, count(*) AS selected_top_k, {tidy_sql('avg(s)')} AS selection_score_mean, {tidy_sql('avg(o)')} AS oos_reward_mean, {tidy_sql('avg(oos_pearson_ic_mean)')} AS oos_pearson_ic_mean, {tidy_sql('avg(oos_spearman_ic_mean)')} AS oos_spearman_ic_mean, {tidy_sql('avg(oos_long_short_spread)')} AS oos_long_short_spread_mean, max_by(candidate_id, -k) AS top_candidate_id, {tidy_sql('max_by(s, -k)')} AS top_selection_reward, {tidy_sql('max_by(o, -k)')} AS top_oos_reward FROM mk WHERE k <= 2 GROUP BY 1, 2""")
def method_rewards(spark, sf_dir):
    return tidied(candidates.method_rewards(_candidates(spark, sf_dir), 2, _oos))


@query("method_summary", f"""{_cands}, ml AS (SELECT *, 'predictive_ic' AS reward_mode, selection_predictive_ic_reward AS s FROM cands UNION ALL SELECT *, 'incremental_proxy', selection_incremental_proxy_reward FROM cands),
mk AS (SELECT *, row_number() OVER (PARTITION BY method, reward_mode ORDER BY s DESC, candidate_id) AS k FROM ml)
SELECT method, reward_mode, {tidy_sql('avg(s)')} AS selection_score_mean, {tidy_sql('avg((oos_pearson_ic_mean > 0)::INT)')} AS oos_pass_ratio, max_by(candidate_id, -k) AS top_formula, max_by(len(candidate_id), -k)::DOUBLE AS top_complexity FROM mk WHERE k <= 2 GROUP BY 1, 2""")
def method_summary(spark, sf_dir):
    found = candidates.method_rewards(_candidates(spark, sf_dir), 2, _oos, "passes_oos_filter", ("formula", "complexity"))
    return tidied(found.select("method", "reward_mode", "selection_score_mean", "oos_pass_ratio", "top_formula", "top_complexity"))


@query("run_overview", f"""{_cands} SELECT method, count(*) AS candidate_count, count(*) FILTER (oos_pearson_ic_mean > 0) AS oos_pass_count, {tidy_sql('(1 - count(DISTINCT candidate_id) / count(*))')} AS duplicate_formula_ratio, {', '.join(f"{tidy_sql(f'max({x})')} AS best_{x}" for x in ('oos_predictive_ic_reward', 'oos_incremental_proxy_reward', *_oos))} FROM cands GROUP BY method""")
def run_overview(spark, sf_dir):
    return tidied(candidates.run_overview(_candidates(spark, sf_dir)))


# ---- folds, scores, families ----


@query("fold_scores", f"""WITH {tp.panel_sql()}, f AS (SELECT sector, year(date) AS y, avg(close) AS a, -avg(volume) AS b FROM panel GROUP BY 1, 2) SELECT sector, {tidy_sql('avg(a)')} AS a, count(b) AS windows, {tidy_sql('avg(b)')} AS score_mean, {tidy_sql('stddev_pop(b)')} AS score_std, {tidy_sql('min(b)')} AS score_min, {tidy_sql('(avg(b) - 0.5 * stddev_pop(b))')} AS stable_score FROM f GROUP BY sector""")
def fold_scores(spark, sf_dir):
    f = tp.panel(spark, sf_dir).groupBy("sector", F.year("date").alias("w")).agg(F.avg("close").alias("a"), F.avg("volume").alias("rmse"))
    return tidied(candidates.fold_scores(f.withColumn("score", candidates.metric_score(f, "rmse")), ["sector"], "score", ["a"]), ("sector",))


@query("family_penalties", r"""WITH p AS (SELECT p_partkey AS part, p_name, list_distinct(list_filter(list_transform(string_split(replace(p_type, ' ', '+'), '+'), lambda x: lower(trim(x))), lambda x: x <> '')) AS l FROM part)
SELECT part, array_to_string(list_sort(l), ',') AS families, CASE WHEN list_has_any(l, ['brass', 'large']) THEN 0.25 ELSE 0.0 END::DOUBLE AS penalty, CASE WHEN concat_ws('+', CASE WHEN p_name LIKE '%green%' OR p_name LIKE '%blue%' THEN 'cold' END, CASE WHEN p_name LIKE '%red%' THEN 'warm' END) = '' THEN 'other' ELSE concat_ws('+', CASE WHEN p_name LIKE '%green%' OR p_name LIKE '%blue%' THEN 'cold' END, CASE WHEN p_name LIKE '%red%' THEN 'warm' END) END AS hues FROM p""")
def family_penalties(spark, sf_dir):
    kind = F.replace("p_type", F.lit(" "), F.lit("+"))
    hues = candidates.families_of(F.col("p_name"), {"warm": ("red",), "cold": ("green", "blue")})
    return tp.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.array_join(F.array_sort(candidates.metadata_list(kind)), ",").alias("families"), candidates.family_overlap(kind, F.array(F.lit("Brass, x"), F.lit("LARGE")), 0.25).alias("penalty"), hues.alias("hues"))


# ---- fits in closed form ----

_PICKED = ["volume", "vwap"]


def _ridge_sql(rows, out, train, apply):
    """Ridge on two features: the two normal equations solved by hand."""
    z = lambda x: f"(({x} - m.m_{x}) / m.s_{x})"
    return f"""{out}_m AS (SELECT avg(volume) AS m_volume, stddev_samp(volume) AS s_volume, avg(vwap) AS m_vwap, stddev_samp(vwap) AS s_vwap, avg(y) AS m_y FROM {rows} WHERE {train} AND y IS NOT NULL),
{out}_g AS (SELECT sum({z('volume')} * {z('volume')}) + 1 AS a, sum({z('volume')} * {z('vwap')}) AS b, sum({z('vwap')} * {z('vwap')}) + 1 AS c, sum({z('volume')} * (y - m_y)) AS p, sum({z('vwap')} * (y - m_y)) AS q FROM {rows}, {out}_m m WHERE {train} AND y IS NOT NULL),
{out} AS (SELECT r.date, r.instrument_id, r.y, m_y + {z('volume')} * (c * p - b * q) / (a * c - b * b) + {z('vwap')} * (a * q - b * p) / (a * c - b * b) AS predicted_y FROM {rows} r, {out}_m m, {out}_g WHERE {apply})"""


_rows_sql = f"{_pred}, rw AS (SELECT p.date, p.instrument_id, p.t, p.volume, p.vwap, y FROM pt p JOIN pred USING (date, instrument_id)), nd AS (SELECT max(t) AS n FROM cal), sp AS (SELECT *, t > floor(n * 0.8) AS is_test, row_number() OVER (PARTITION BY instrument_id, t > floor(n * 0.8) ORDER BY date DESC) AS back FROM rw, nd)"


@query("ridge_two_features", f"{_rows_sql}, {_ridge_sql('sp', 'fit', 'NOT is_test AND back > 1', 'is_test')} {tidied_sql(['y', 'predicted_y'], 'fit')}")
def ridge_two_features(spark, sf_dir):
    train, test = calendar.split(base._signals(spark, sf_dir).drop("predicted_y"))
    model = models.fit(calendar.purge(train, 1), _PICKED, "ridge")
    return tidied(models.predict(model, test).select(*KEYS, "y", "predicted_y"))


_cross = f"{_rows_sql}, rb AS (SELECT rw.*, block FROM rw JOIN (SELECT date, ntile(4) OVER (ORDER BY date) AS block FROM (SELECT DISTINCT date FROM rw)) USING (date) WHERE y IS NOT NULL), " + ", ".join(_ridge_sql("rb", f"x{b}", f"block < {b}", f"block = {b}") for b in (2, 3, 4)) + ", cross_fit AS (SELECT *, y - predicted_y AS residual FROM (FROM x2 UNION ALL FROM x3 UNION ALL FROM x4))"


@query("crossfit_residuals", f"{_cross} {tidied_sql(['predicted_y', 'residual'], 'cross_fit')}")
def crossfit_residuals(spark, sf_dir):
    return tidied(models.crossfit_residuals(base._signals(spark, sf_dir).drop("predicted_y"), _PICKED, "ridge", 4).select(*KEYS, "predicted_y", "residual"))


_res = f"""{_cross}, rl AS (SELECT c.date, c.instrument_id, residual AS y, predicted_y, 'turnover' AS factor, turnover AS value FROM cross_fit c JOIN panel USING (date, instrument_id) UNION ALL SELECT c.date, c.instrument_id, residual, predicted_y, 'low', low FROM cross_fit c JOIN panel USING (date, instrument_id)),
rr AS (SELECT *, count(*) OVER (PARTITION BY factor, date) AS n, rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2 AS rs, rank() OVER (PARTITION BY factor, date ORDER BY y) + (count(*) OVER (PARTITION BY factor, date, y) - 1) / 2 AS rt, row_number() OVER (PARTITION BY factor, date ORDER BY value, instrument_id) AS k FROM rl),
ri AS (SELECT factor, date, CASE WHEN count(*) >= 5 THEN {_corr.format(a='value', b='y')} END AS ic, CASE WHEN count(*) >= 5 THEN {_corr.format(a='rs', b='rt')} END AS rank_ic, CASE WHEN count(*) >= 5 THEN {_corr.format(a='value', b='predicted_y')} END AS near FROM rr GROUP BY 1, 2),
rg AS (SELECT factor, g, avg(r) AS r FROM (SELECT factor, date, least(greatest(ceil(k / n * 5), 1), 5) AS g, avg(y) AS r FROM rr GROUP BY 1, 2, 3) GROUP BY 1, 2),
rf AS (SELECT factor, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg(near) AS near FROM ri GROUP BY 1), re AS (SELECT factor, max_by(r, g) - min_by(r, g) AS spread FROM rg GROUP BY 1)
SELECT factor AS candidate, CASE WHEN ic < 0 THEN -1 ELSE 1 END::BIGINT AS direction, {tidy_sql('abs(ic)')} AS ic, {tidy_sql('(CASE WHEN ic < 0 THEN -rank_ic ELSE rank_ic END)')} AS rank_ic, {tidy_sql('(CASE WHEN ic < 0 THEN -spread ELSE spread END)')} AS spread, {tidy_sql('near')} AS baseline_corr, {tidy_sql('(abs(ic) * (1 - abs(near)))')} AS score FROM rf JOIN re USING (factor)"""


@query("residual_candidates", _res)
def residual_candidates(spark, sf_dir):
    rows = base._signals(spark, sf_dir)
    left = models.crossfit_residuals(rows.drop("predicted_y"), _PICKED, "ridge", 4)
    return tidied(candidates.residual_scores(stored(left), ["turnover", "low"]))


_turned = lambda x, rest="-{0}": f"CASE WHEN ic_mean < 0 THEN {rest.format(x)} ELSE {x} END"
_left = _factor_summary.split(f"{_pred}, ", 1)[1].replace(_long, "lf AS (SELECT date, instrument_id, y, factor, value FROM rl)", 1)
_residuals = _res.split(",\nrr AS (", 1)[0]
_inc_columns = [*candidates.RESIDUAL, *candidates.RESIDUAL_SHARES, "baseline_corr", "score", "incremental_score"]


@query("residual_incremental", f"""{_residuals}, ls AS MATERIALIZED (WITH {_left} SELECT * FROM summary),
ln AS (SELECT factor, round(corr(value, predicted_y), 10) AS near FROM rl WHERE value IS NOT NULL AND predicted_y IS NOT NULL GROUP BY 1),
lt AS (SELECT factor, CASE WHEN ic_mean < 0 THEN -1 ELSE 1 END AS direction, {', '.join(f"{_turned(x)} AS {x}" for x in candidates.RESIDUAL)}, {', '.join(f"{_turned(x, '1 - {0}')} AS {x}" for x in candidates.RESIDUAL_SHARES)}, CASE WHEN ic_mean < 0 THEN -near ELSE near END AS baseline_corr FROM ls JOIN ln USING (factor)),
lw AS (SELECT *, ic_mean + 0.5 * rank_ic_mean + 0.75 * spread + 0.02 * monotonicity + 0.05 * greatest(ic_positive_ratio - 0.5, 0) + 0.03 * greatest(rank_ic_positive_ratio - 0.5, 0) AS score FROM lt)
{tidied_sql(_inc_columns, '(SELECT *, score * (1 - least(abs(baseline_corr), 1)) AS incremental_score FROM lw)', 'factor AS candidate, direction::BIGINT AS direction')}""")
def residual_incremental(spark, sf_dir):
    left = models.crossfit_residuals(base._signals(spark, sf_dir).drop("predicted_y"), _PICKED, "ridge", 4)
    return tidied(candidates.residual_incremental(stored(left), ["turnover", "low"]))


@query("validation_scores", f"""{_res.rsplit('SELECT factor AS candidate', 1)[0].rstrip()}, rd AS (SELECT factor, count(ic) AS ic_days FROM ri GROUP BY 1)
SELECT factor AS candidate, {tidy_sql('ic')} AS ic, {tidy_sql('rank_ic')} AS rank_ic, ic_days, {tidy_sql('spread')} AS long_short_return, {tidy_sql('(0.5 * coalesce(ic, 0) + 0.3 * coalesce(rank_ic, 0) + 0.2 * coalesce(spread, 0))')} AS score FROM rf JOIN re USING (factor) JOIN rd USING (factor)""")
def validation_scores(spark, sf_dir):
    left = models.crossfit_residuals(base._signals(spark, sf_dir).drop("predicted_y"), _PICKED, "ridge", 4)
    return tidied(candidates.validation_scores(stored(left), ["turnover", "low"]))


@query("forward_selection")
def forward_selection(spark, sf_dir):
    rows = base._signals(spark, sf_dir)
    days = [(date(1994, 6, 1), date(1994, 9, 1), date(1995, 12, 1)), (date(1995, 10, 1), date(1996, 1, 1), date(1997, 6, 1))]
    pool = {"vwap": "price", "turnover": "size+price", "low": "price", "market_cap": "size"}
    return tidied(candidates.forward_selection(rows, ["volume"], pool, days, 3, overlap=0.001, redundancy=0.001))


# ---- the strict path ----


def _made(df):
    return df.withColumns({"mean_5": C.rolling_mean(F.col("close"), 5), "place": F.rank().over(C.section().orderBy("volume")).cast("double")})


_feat = lambda rows, name: f"{name} AS (SELECT *, avg(close) OVER w AS mean_5, rank() OVER (PARTITION BY date ORDER BY volume)::DOUBLE AS place FROM {rows} WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS 4 PRECEDING))"
_strict = f"""{_pred}, nd AS (SELECT max(t) AS n FROM cal), sa AS (SELECT p.date, p.instrument_id, p.close, p.volume, pr.y, p.t > floor(n * 0.8) AS is_test FROM pt p JOIN pred pr USING (date, instrument_id), nd),
sb AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, is_test ORDER BY date DESC) AS back FROM sa), st AS (SELECT * FROM sb WHERE NOT is_test AND back > 5), sc AS (SELECT * FROM sb WHERE is_test OR back <= 12), {_feat('st', 'sf')}, {_feat('sc', 'sg')},
strict AS (SELECT 'train' AS part, date, instrument_id, y, mean_5, place FROM sf WHERE y IS NOT NULL UNION ALL SELECT 'test', date, instrument_id, y, mean_5, place FROM sg WHERE is_test AND y IS NOT NULL)"""


@query("strict_features", f"{_strict} {tidied_sql(['y', 'mean_5', 'place'], 'strict', 'part, date, instrument_id')}")
def strict_features(spark, sf_dir):
    train, test = candidates.strict_features(base._signals(spark, sf_dir), _made, 5, history=12)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return tidied(both.select("part", *KEYS, "y", "mean_5", "place"))


_recent = """wn AS (SELECT 'last_' || m || 'm' AS mode, (h - to_months(m) + INTERVAL 1 DAY)::DATE AS start, h AS "end" FROM (SELECT max(date) AS h FROM pred), (SELECT unnest([6, 24]) AS m))"""


@query("window_metrics", f"""{_pred}, {base._ic}, {_recent}, wp AS (SELECT mode, start, "end", count(*) AS rows, count(DISTINCT instrument_id) AS instruments, min(date) AS first_date, max(date) AS last_date, sqrt(avg((predicted_y - y) ** 2)) AS rmse, avg(abs(predicted_y - y)) AS mae FROM pred JOIN wn ON date BETWEEN start AND "end" GROUP BY 1, 2, 3),
wi AS (SELECT mode, avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean FROM ic JOIN wn ON date BETWEEN start AND "end" GROUP BY 1),
wg AS (SELECT date, least(greatest(ceil(row_number() OVER (PARTITION BY date ORDER BY predicted_y, instrument_id) / count(*) OVER (PARTITION BY date) * 5), 1), 5) AS g, y FROM pred WHERE y IS NOT NULL),
wr AS (SELECT mode, g, avg(r) AS r FROM (SELECT date, g, avg(y) AS r FROM wg GROUP BY 1, 2) JOIN wn ON date BETWEEN start AND "end" GROUP BY 1, 2), ws AS (SELECT mode, max_by(r, g) - min_by(r, g) AS spread FROM wr GROUP BY 1)
{tidied_sql(['rmse', 'mae', 'ic_mean', 'rank_ic_mean', 'spread'], 'wp LEFT JOIN wi USING (mode) LEFT JOIN ws USING (mode)', 'mode, start, "end", rows, instruments, first_date, last_date')}""")
def window_metrics(spark, sf_dir):
    p = base._predictions(spark, sf_dir)
    return tidied(candidates.window_metrics(p, calendar.recent_windows(p, (6, 24))))


# ---- small merges ----


@query("prediction_actuals", f"{_pred} SELECT a.date, a.instrument_id, {tidy_sql('a.predicted_y')} AS predicted_y, {tidy_sql('b.y')} AS y FROM pred a LEFT JOIN (SELECT * FROM pred WHERE instrument_id % 3 <> 0) b USING (date, instrument_id)")
def prediction_actuals(spark, sf_dir):
    p = base._predictions(spark, sf_dir)
    actual = p.where("instrument_id % 3 <> 0")
    return tidied(tables.with_actuals(p, actual.unionByName(actual)))


@query("prepared_panel", f"WITH {tp.panel_sql()}, {base._cal}, y AS (SELECT a.instrument_id, a.date, a.sector, b.close / a.close - 1 AS y FROM pt a LEFT JOIN pt b ON b.instrument_id = a.instrument_id AND b.t = a.t + 5) {tidied_sql(['y'], 'y', 'instrument_id, date, sector')} WHERE date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'")
def prepared_panel(spark, sf_dir):
    return tidied(tables.prepared(base._panel(spark, sf_dir), date(1994, 1, 1), date(1995, 6, 30), 5).select(*KEYS, "sector", "y"))


@query("selected_edges", f"WITH {tp.panel_sql()}, {tp.EDGES_SQL}, k AS (SELECT source, target, count(*) AS n FROM edges GROUP BY 1, 2 HAVING count(*) > 1) SELECT e.date, e.source, e.target, {tidy_sql('e.weight')} AS weight FROM edges e SEMI JOIN k USING (source, target)")
def selected_edges(spark, sf_dir):
    e = stored(tp.edges(spark, sf_dir))
    return tidied(tables.selected_edges(e, e.groupBy("source", "target").count().where("count > 1")).select("date", "source", "target", "weight"))


@query("candidate_pool", "SELECT 'a' AS run, p_partkey AS part, p_size::DOUBLE AS size, try_cast(p_name AS DOUBLE) AS number, p_size % 2 = 0 AS flag FROM part UNION ALL SELECT 'b', p_partkey, NULL, try_cast(p_partkey AS DOUBLE), false FROM part")
def candidate_pool(spark, sf_dir):
    p = tp.read(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("part"), F.col("p_size").cast("string").alias("size"), F.col("p_name").alias("number"), F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no").alias("flag"))
    return tables.candidate_pool({"a": a, "b": p.select(F.col("p_partkey").alias("part"), F.col("p_partkey").cast("string").alias("number"))}, ["size", "number"], ["flag"])


@query("panel_instruments", f"WITH {tp.panel_sql()} SELECT DISTINCT instrument_id FROM panel")
def panel_instruments(spark, sf_dir):
    return tables.instruments(tp.panel(spark, sf_dir))


@query("close_series", f"SELECT o_orderdate AS date, o_orderpriority AS ticker, {tidy_sql('(o_totalprice::DOUBLE * CASE o_orderpriority WHEN $$1-URGENT$$ THEN 0.1 ELSE 1 END)')} AS close FROM orders")
def close_series(spark, sf_dir):
    o = tp.read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker"), F.col("o_totalprice").alias("close"))
    return tidied(tables.closes(o, {"1-URGENT": 0.1}))


@query("feature_source", f"WITH {tp.panel_sql()}, s AS (SELECT sector AS feature, max(close) AS score FROM panel GROUP BY 1) SELECT feature, {tidy_sql('score')} AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, feature) AS k FROM s) WHERE k <= 3")
def feature_source(spark, sf_dir):
    df = tp.panel(spark, sf_dir)
    return tidied(tables.feature_source(df.select(F.col("sector").alias("feature")), df.select(F.col("sector").alias("feature"), F.col("close").alias("score")), 3))


# ---- factors written out by hand: no part of their SQL comes from the expressions that Spark evaluates ----

_pct = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY date) END"
_by_hand = f"""WITH {tp.panel_sql()}, h1 AS (SELECT *, vwap - close AS gap, CASE WHEN high - low > 1e-8 THEN ((close - low) - (high - close)) / (high - low) END AS place, lag(close) OVER i AS c1, lag(close, 5) OVER i AS c5, lag(close, 6) OVER i AS c6, lag(close, 20) OVER i AS c20, lag(volume, 3) OVER i AS v3,
  avg(close) OVER (i ROWS 2 PRECEDING) AS m3, avg(close) OVER (i ROWS 5 PRECEDING) AS m6, avg(close) OVER (i ROWS 6 PRECEDING) AS m7, avg(close) OVER (i ROWS 11 PRECEDING) AS m12, avg(close) OVER (i ROWS 23 PRECEDING) AS m24
  FROM panel WINDOW i AS (PARTITION BY instrument_id ORDER BY date)),
h2 AS (SELECT *, max(gap) OVER (i ROWS 2 PRECEDING) AS g_most, min(gap) OVER (i ROWS 2 PRECEDING) AS g_least, volume - v3 AS dv, open - avg(vwap) OVER (i ROWS 9 PRECEDING) AS o_gap, abs(close - vwap) AS c_gap, vwap - max(vwap) OVER (i ROWS 14 PRECEDING) AS below, CASE WHEN close > c1 THEN 1.0 ELSE 0.0 END AS up,
  CASE WHEN count(c5) OVER (i ROWS 229 PRECEDING) >= 2 THEN corr(vwap, c5) OVER (i ROWS 229 PRECEDING) END AS near
  FROM h1 WINDOW i AS (PARTITION BY instrument_id ORDER BY date)),
by_hand AS (SELECT instrument_id, date,
  -(place - lag(place) OVER i) AS alpha002, ({_pct('g_most')} + {_pct('g_least')}) * {_pct('dv')} AS alpha007, -{_pct('o_gap')} * {_pct('c_gap')} AS alpha012, close - c5 AS alpha014, open / c1 - 1 AS alpha015, CASE WHEN isfinite(power(greatest({_pct('below')}, 1e-6), coalesce(close - c5, 0))) THEN power(greatest({_pct('below')}, 1e-6), coalesce(close - c5, 0)) END AS alpha017, close / c5 AS alpha018, (close - c6) / c6 * 100 AS alpha020, m7 - close + near AS alpha026, (close - c6) / c6 * volume AS alpha029,
  (close - m12) / m12 * 100 AS alpha031, (m3 + m6 + m12 + m24) / (4 * close) AS alpha046, sum(up) OVER (i ROWS 11 PRECEDING) / 12 * 100 AS alpha053, sum(up) OVER (i ROWS 19 PRECEDING) / 20 * 100 AS alpha058, m6 / close AS alpha065, (close - m6) / m6 * 100 AS alpha066, (close - m24) / m24 * 100 AS alpha071, (close - c20) / c20 * 100 AS alpha088,
  stddev_samp(turnover) OVER (i ROWS 19 PRECEDING) AS alpha095, stddev_samp(volume) OVER (i ROWS 9 PRECEDING) AS alpha097, stddev_samp(volume) OVER (i ROWS 19 PRECEDING) AS alpha100, close - c20 AS alpha106 FROM h2 WINDOW i AS (PARTITION BY instrument_id ORDER BY date))"""
_hand = [f"alpha{n:03d}" for n in (2, 7, 12, 14, 15, 17, 18, 20, 26, 29, 31, 46, 53, 58, 65, 66, 71, 88, 95, 97, 100, 106)]


@query("factors_by_hand", f"{_by_hand} {tidied_sql(_hand, 'by_hand')}")
def factors_by_hand(spark, sf_dir):
    return tidied(factors.factors(tp.panel(spark, sf_dir), _hand).select(*KEYS, *_hand))
