"""Registered queries of candidate search at scale: correlations of signals, scores in parts, staged scores, selection by any
metric, penalty grids; their SQL is written apart from the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quantloom.functions.tables import stored
from quantloom.operators import alpha_scores, boosting, calendar, factors, linear_grid, models, preprocess, relation, signals, staged

from . import queries as base
from . import testpanel as tp
from .queries import _corr, _pred, query, tidied, tidied_sql
from .testpanel import tidy_sql

# ---- correlations of signals ----

_TEN = ["open", "high", "low", "close", "volume", "turnover", "vwap", "adjustment", "market_cap", "predicted_y"]
_zed = lambda x: f"({x} - avg({x}) OVER d) / CASE WHEN stddev_pop({x}) OVER d > 1e-12 THEN stddev_pop({x}) OVER d END"
_ten = f"""{_pred}, tz AS (SELECT p.date, p.instrument_id, {', '.join(f'{_zed(x)} AS {x}' for x in _TEN)} FROM panel p JOIN pred USING (date, instrument_id) WINDOW d AS (PARTITION BY date)),
te AS (SELECT a, b, corr FROM ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM tz WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(_TEN) for b in _TEN[i + 1:])}))"""


def _ten_signals(spark, sf_dir):
    return stored(base._signals(spark, sf_dir).select("date", "instrument_id", *(preprocess.zscore(F.col(x)).alias(x) for x in _TEN)))


@query("signal_edges", f"{_ten} SELECT a, b, {tidy_sql('corr')} AS corr FROM te WHERE abs(corr) > 0.2")
def signal_edges(spark, sf_dir):
    return tidied(signals.correlation_edges(_ten_signals(spark, sf_dir), _TEN, 0.2, block=4))


_places = f"pl AS (SELECT candidate_id, row_number() OVER (ORDER BY score DESC, candidate_id) AS place FROM (SELECT unnest({_TEN}) AS candidate_id, unnest([{', '.join(f'avg({x} * {x} * {x})' for x in _TEN)}]) AS score FROM tz))"


@query("signal_choice", f"""{_ten.replace('WITH panel', 'WITH RECURSIVE panel')}, {_places}, nb AS (SELECT x.place AS p, list(y.place) AS near FROM te JOIN pl x ON x.candidate_id IN (a, b) JOIN pl y ON y.candidate_id IN (a, b) AND y.place < x.place WHERE abs(corr) > 0.2 GROUP BY 1),
walk AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS taken UNION ALL SELECT w.place + 1, CASE WHEN list_has_any(coalesce(near, []), taken) THEN taken ELSE list_append(taken, w.place + 1) END FROM walk w LEFT JOIN nb ON p = w.place + 1 WHERE w.place < {len(_TEN)})
SELECT candidate_id, list_contains(taken, pl.place) AS kept, CASE WHEN NOT list_contains(taken, pl.place) THEN (SELECT q.candidate_id FROM pl q WHERE q.place = list_min(list_intersect(near, taken))) END AS close_to
FROM pl LEFT JOIN nb ON p = pl.place, (SELECT taken FROM walk WHERE place = {len(_TEN)})""")
def signal_choice(spark, sf_dir):
    rows = _ten_signals(spark, sf_dir)
    score = rows.agg(*(F.avg(F.pow(x, F.lit(3.0))).alias(x) for x in _TEN))
    pool = score.unpivot([], _TEN, "candidate_id", "score")
    return signals.greedy_rounds(pool, signals.correlation_edges(rows, _TEN, 0.2), "score")


# ---- scores in parts ----

#: candidate_id, formula, family, complexity, depth, field_count, financial_logic_score
_META = [("volume", "rank(volume)", "size", 1.0, 1.0, 1.0, 0.5), ("vwap", "vwap", "price", 1.0, 0.0, 1.0, 0.4), ("turnover", "rank(volume) * vwap", "size", 3.0, 2.0, 2.0, 0.8), ("low", "low - close", "price", 2.0, 1.0, 2.0, 0.6), ("adjustment", "adjustment", "other", 1.0, 0.0, 1.0, 0.1)]
_META_COLUMNS = "candidate_id string, formula string, family string, complexity double, depth double, field_count double, financial_logic_score double"
_ids = [m[0] for m in _META]
_key = "'7|' || factor || '|' || instrument_id || '|' || date"
_hex = lambda k, at: f"(('0x' || substr(md5({k}), {at}, 12))::BIGINT / 281474976710656.0::DOUBLE)"
_unit = lambda x: f"coalesce(CASE WHEN {x} IS NOT NULL AND count({x}) OVER () > 1 THEN (rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2) / count({x}) OVER () END, 0.5)"
_parts_sql = ", ".join(f"({' + '.join(_unit(x if x[0] != '-' else f'(-{x[1:]})') for x in xs)}) / {len(xs)} AS {p}_score" for p, xs in alpha_scores.RANKED.items())
_rank2 = lambda x: f"rank() OVER (PARTITION BY factor, variant, date ORDER BY {x}) + (count(*) OVER (PARTITION BY factor, variant, date, {x}) - 1) / 2"
_steady = lambda x: f"1 - CASE WHEN {x}_f IS NOT NULL AND {x}_s IS NOT NULL AND {x} IS NOT NULL THEN least(abs({x}_f - {x}_s) / greatest(abs({x}), 1e-8), 2) END"
_held = lambda a, b: f"CASE WHEN abs({b}) > 1e-8 THEN least(greatest({a} / {b}, -2), 2) END"
_of = lambda x, v, s: f"max({x}) FILTER (variant = '{v}' AND scope = '{s}')"
_alpha = f"""{_pred}, lf AS (SELECT p.date, p.instrument_id, y, u.f AS factor, u.v AS value FROM panel p JOIN pred USING (date, instrument_id), LATERAL (SELECT unnest({_ids}) AS f, unnest([{', '.join(_ids)}]) AS v) u),
dr AS (SELECT lf.*, s, {_key} AS k FROM lf JOIN (SELECT factor, stddev_pop(value) AS s FROM lf GROUP BY 1) USING (factor)),
vr AS (SELECT factor, date, instrument_id, y, 'base' AS variant, value FROM dr UNION ALL SELECT factor, date, instrument_id, y, 'gaussian', value + 0.05 * (CASE WHEN abs(s) > 1e-12 THEN s ELSE 1 END) * sqrt(-2 * ln(1 - {_hex('k', 1)})) * cos(2 * pi() * {_hex('k', 13)}) FROM dr UNION ALL SELECT factor, date, instrument_id, y, 'dropout', CASE WHEN {_hex("k || '|2'", 1)} >= 0.1 THEN value END FROM dr),
wz AS (SELECT factor, date, instrument_id, y, variant, CASE WHEN value IS NOT NULL THEN least(greatest(value, quantile_cont(value, 0.01) OVER d), quantile_cont(value, 0.99) OVER d) END AS value FROM vr WINDOW d AS (PARTITION BY factor, variant, date)),
us AS MATERIALIZED (SELECT factor, date, instrument_id, y, variant, {_zed('value')} AS value FROM wz WINDOW d AS (PARTITION BY factor, variant, date)),
up AS (SELECT *, {_rank2('value')} AS rs, {_rank2('y')} AS rt, count(*) OVER x AS n, max(value) OVER x > min(value) OVER x AS varied, row_number() OVER (PARTITION BY factor, variant, date ORDER BY value, instrument_id) AS k FROM us WHERE y IS NOT NULL AND value IS NOT NULL WINDOW x AS (PARTITION BY factor, variant, date)),
ui AS (SELECT factor, variant, date, CASE WHEN count(*) >= 5 THEN {_corr.format(a='value', b='y')} END AS ic, CASE WHEN count(*) >= 5 THEN {_corr.format(a='rs', b='rt')} END AS rank_ic FROM up GROUP BY 1, 2, 3),
ug AS (SELECT factor, variant, date, least(greatest(ceil(k / n * 5), 1), 5) AS g, avg(y) AS r FROM up WHERE n >= 5 AND varied GROUP BY 1, 2, 3, 4),
sc AS (SELECT date, unnest(['all', CASE WHEN t <= (SELECT max(t) FROM cal) // 2 THEN 'first' ELSE 'second' END]) AS scope FROM cal),
um AS (SELECT factor, variant, scope, avg(ic) AS ic, avg(rank_ic) AS rank_ic, avg((ic > 0)::INT) AS ic_positive_ratio, avg((rank_ic > 0)::INT) AS rank_ic_positive_ratio FROM ui JOIN sc USING (date) GROUP BY 1, 2, 3),
ue AS (SELECT factor, variant, scope, max_by(r, g) - min_by(r, g) AS spread FROM (SELECT factor, variant, scope, g, avg(r) AS r FROM ug JOIN sc USING (date) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
ud AS (SELECT factor, variant, date, max_by(r, g) - min_by(r, g) AS d, row_number() OVER (PARTITION BY factor, variant ORDER BY date) - 1 AS k FROM ug GROUP BY 1, 2, 3 HAVING max(g) > min(g)),
ua AS (SELECT factor, variant, 'all' AS scope, avg(d) / CASE WHEN stddev_samp(d) > 1e-12 THEN stddev_samp(d) END * sqrt(252 / 5.0::DOUBLE) AS sharpe_apart FROM ud WHERE k % 5 = 0 GROUP BY 1, 2),
mm AS (SELECT factor AS candidate_id, {', '.join(f"{_of(x, 'base', 'all')} AS {x}" for x in ('ic', 'rank_ic', 'spread', 'sharpe_apart', 'ic_positive_ratio', 'rank_ic_positive_ratio'))}, {', '.join(f"{_of(x, v, s)} AS {x}_{t}" for x in ('ic', 'spread') for v, s, t in (('base', 'first', 'f'), ('base', 'second', 's'), ('gaussian', 'all', 'g'), ('dropout', 'all', 'd')))} FROM um LEFT JOIN ue USING (factor, variant, scope) LEFT JOIN ua USING (factor, variant, scope) GROUP BY 1),
bt AS (SELECT factor, date, instrument_id, value, {_rank2('value')} AS rk, count(*) OVER (PARTITION BY factor, date) AS n, row_number() OVER (PARTITION BY factor, date ORDER BY value DESC, instrument_id) AS pos FROM us WHERE variant = 'base' AND value IS NOT NULL),
bl AS (SELECT factor, avg(d) AS rank_turnover FROM (SELECT factor, abs(rk / n - lag(rk / n) OVER (PARTITION BY factor, instrument_id ORDER BY date)) AS d FROM bt) GROUP BY 1),
bk AS (SELECT *, dense_rank() OVER (PARTITION BY factor ORDER BY date) AS k FROM bt WHERE pos <= greatest(ceil(n * 0.2), 1)),
br AS (SELECT factor, avg(stay / were) AS retention FROM (SELECT o.factor, o.k, count(*) AS were, count(b.instrument_id) AS stay FROM bk o LEFT JOIN bk b ON b.factor = o.factor AND b.k = o.k + 1 AND b.instrument_id = o.instrument_id WHERE o.k < (SELECT max(k) FROM bk z WHERE z.factor = o.factor) GROUP BY 1, 2) GROUP BY 1),
me AS (SELECT * FROM (VALUES {', '.join(map(str, _META))}) v({', '.join(c.split()[0] for c in _META_COLUMNS.split(', '))})),
tk AS (SELECT candidate_id, list_distinct(regexp_extract_all(formula, '[A-Za-z_][A-Za-z0-9_]*')) AS l FROM me),
nv AS (SELECT x.candidate_id, 1 - coalesce(max(len(list_intersect(x.l, y.l)) / len(list_distinct(x.l || y.l))), 0) AS formula_novelty FROM tk x JOIN tk y ON x.candidate_id <> y.candidate_id GROUP BY 1),
uq AS (SELECT a AS candidate_id, 1 - coalesce(round(max(abs(c)), 10), 0) AS signal_uniqueness FROM (SELECT x.factor AS a, corr(x.value, z.value) AS c FROM us x JOIN us z ON x.date = z.date AND x.instrument_id = z.instrument_id AND x.factor <> z.factor WHERE x.variant = 'base' AND z.variant = 'base' AND x.value IS NOT NULL AND z.value IS NOT NULL GROUP BY x.factor, z.factor) GROUP BY 1),
al AS (SELECT me.*, mm.* EXCLUDE (candidate_id), rank_turnover, retention, formula_novelty, signal_uniqueness, 1.0::DOUBLE / count(*) OVER (PARTITION BY family) AS family_uniqueness,
  {_steady('ic')} AS temporal_ic_consistency, {_steady('spread')} AS temporal_spread_consistency, {_held('ic_g', 'ic')} AS gaussian_ic_retention, {_held('spread_g', 'spread')} AS gaussian_spread_retention, {_held('ic_d', 'ic')} AS dropout_ic_retention, {_held('spread_d', 'spread')} AS dropout_spread_retention
  FROM me JOIN mm USING (candidate_id) JOIN bl ON bl.factor = candidate_id JOIN br ON br.factor = candidate_id JOIN nv USING (candidate_id) JOIN uq USING (candidate_id)),
ap AS (SELECT *, {_parts_sql} FROM al), az AS (SELECT *, {' + '.join(f'{w} * {p}_score' for p, w in alpha_scores.PARTS.items())} AS alpha_score FROM ap)"""
_alpha_columns = ["ic", "rank_ic", "spread", "sharpe_apart", "gaussian_ic_retention", "dropout_spread_retention", "temporal_ic_consistency", "formula_novelty", "signal_uniqueness", "rank_turnover", "retention", *(f"{p}_score" for p in alpha_scores.RANKED), "alpha_score"]


@query("alpha_scores", f"{_alpha} {tidied_sql(_alpha_columns, 'az', 'candidate_id')}")
def alpha_score_table(spark, sf_dir):
    meta = spark.createDataFrame(_META, _META_COLUMNS)
    return tidied(alpha_scores.alpha_scores(base._signals(spark, sf_dir), meta).select("candidate_id", *_alpha_columns))


# ---- penalty grids and selection by any metric ----

_GRID = {"ridge": [{"alpha": 0.1}, {"alpha": 1.0}, {"alpha": 100.0}], "lasso": [{"alpha": 0.01}, {"alpha": 0.5}], "elastic_net": [{"alpha": 0.02, "l1_ratio": 0.3}, {"alpha": 0.5, "l1_ratio": 0.7}]}
_cells = [(m, k, p["alpha"], {"ridge": 0.0, "lasso": 1.0}.get(m, p.get("l1_ratio"))) for m, ps in _GRID.items() for k, p in enumerate(ps)]
_shrunk = lambda own, diag: f"sign({own}) * greatest(abs({own}) - absolute, 0) / ({diag} + squared)"
_fold = f"""{_pred.replace('WITH panel', 'WITH RECURSIVE panel')}, f AS (SELECT fold, n - (4 - fold) * (n // 4) AS e, n - (4 - fold) * (n // 4) + n // 4 AS v FROM (SELECT max(t) AS n FROM cal), (SELECT unnest(range(1, 4)) AS fold)),
fr AS (SELECT p.date, p.instrument_id, p.volume AS a, p.vwap AS b, y, fold, CASE WHEN t <= e THEN 'train' ELSE 'valid' END AS part FROM pt p JOIN pred USING (date, instrument_id) JOIN f ON t <= v),
fk AS (SELECT *, row_number() OVER (PARTITION BY fold, part, instrument_id ORDER BY date DESC) AS back FROM fr),
fm AS (SELECT fold, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM fk WHERE part = 'train' AND back > 1 AND y IS NOT NULL GROUP BY 1),
fg AS (SELECT fold, n, ma, mb, my, sa, sb, sum((a - ma) / sa * (a - ma) / sa) / n AS aa, sum((a - ma) / sa * (b - mb) / sb) / n AS ab, sum((b - mb) / sb * (b - mb) / sb) / n AS bb, sum((a - ma) / sa * (y - my)) / n AS ay, sum((b - mb) / sb * (y - my)) / n AS yb FROM fk JOIN fm USING (fold) WHERE part = 'train' AND back > 1 AND y IS NOT NULL GROUP BY fold, n, ma, mb, my, sa, sb),
cell AS (SELECT fg.*, model, candidate, CASE WHEN model = 'ridge' THEN 0 ELSE alpha * share END AS absolute, CASE WHEN model = 'ridge' THEN alpha / n ELSE alpha * (1 - share) END AS squared FROM fg, (VALUES {', '.join(f"('{m}', {k}, {a}::DOUBLE, {s}::DOUBLE)" for m, k, a, s in _cells)}) c(model, candidate, alpha, share)),
turn AS (SELECT fold, model, candidate, aa, ab, bb, ay, yb, absolute, squared, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0 AS k FROM cell UNION ALL
  SELECT fold, model, candidate, aa, ab, bb, ay, yb, absolute, squared, na, {_shrunk('(yb - ab * na)', 'bb')}, k + 1 FROM (SELECT *, {_shrunk('(ay - ab * wb)', 'aa')} AS na FROM turn WHERE k < 200)),
fw AS (SELECT c.fold, c.model, c.candidate, my, ma, mb, wa / sa AS ca, wb / sb AS cb FROM cell c JOIN turn t ON (c.fold, c.model, c.candidate) = (t.fold, t.model, t.candidate) AND t.k = 200),
fv AS (SELECT fold, model, candidate, date, instrument_id, y, round(my + ca * (a - ma) + cb * (b - mb), 12) AS p FROM fk JOIN fw USING (fold) WHERE part = 'valid' AND y IS NOT NULL),
fq AS (SELECT *, rank() OVER (d ORDER BY p) + (count(*) OVER (PARTITION BY fold, model, candidate, date, p) - 1) / 2 AS rs, rank() OVER (d ORDER BY y) + (count(*) OVER (PARTITION BY fold, model, candidate, date, y) - 1) / 2 AS rt, least(greatest(ceil(row_number() OVER (d ORDER BY p, instrument_id) / count(*) OVER d * 5), 1), 5) AS g FROM fv WINDOW d AS (PARTITION BY fold, model, candidate, date)),
fi AS (SELECT fold, model, candidate, avg(ic) AS pearson_ic_mean, avg(rank_ic) AS spearman_ic_mean FROM (SELECT fold, model, candidate, date, {_corr.format(a='p', b='y')} AS ic, {_corr.format(a='rs', b='rt')} AS rank_ic FROM fq GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
fe AS (SELECT fold, model, candidate, sqrt(avg((p - y) ** 2)) AS rmse, avg(abs(p - y)) AS mae, count(*) AS n_rows FROM fq GROUP BY 1, 2, 3),
fs AS (SELECT fold, model, candidate, max_by(r, g) - min_by(r, g) AS long_short_return FROM (SELECT fold, model, candidate, g, avg(r) AS r FROM (SELECT fold, model, candidate, date, g, avg(y) AS r FROM fq GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
grid AS (SELECT fold, model, candidate, pearson_ic_mean, spearman_ic_mean, rmse, mae, long_short_return, n_rows, (ca <> 0)::INT + (cb <> 0)::INT AS n_features FROM fi JOIN fe USING (fold, model, candidate) JOIN fs USING (fold, model, candidate) JOIN fw USING (fold, model, candidate))"""
_grid_metrics = ["pearson_ic_mean", "spearman_ic_mean", "rmse", "mae", "long_short_return"]


def _grid(spark, sf_dir):
    rows = base._signals(spark, sf_dir).drop("predicted_y")
    return linear_grid.penalty_grid(rows, ["volume", "vwap"], _GRID, 3, 1, 5)


@query("penalty_grid", f"{_fold} {tidied_sql(_grid_metrics, 'grid', 'fold::BIGINT AS fold, model, candidate::BIGINT AS candidate, n_rows, n_features::BIGINT AS n_features')}")
def penalty_grid(spark, sf_dir):
    return tidied(_grid(spark, sf_dir).select("fold", "model", "candidate", "n_rows", "n_features", *_grid_metrics))


@query("best_penalties", f"""{_fold}, gs AS (SELECT model, candidate, avg(0.5 * coalesce(pearson_ic_mean, 0) + 0.3 * coalesce(spearman_ic_mean, 0) + 0.2 * coalesce(long_short_return, 0)) AS m, stddev_pop(0.5 * coalesce(pearson_ic_mean, 0) + 0.3 * coalesce(spearman_ic_mean, 0) + 0.2 * coalesce(long_short_return, 0)) AS s FROM grid GROUP BY 1, 2)
SELECT model, candidate::BIGINT AS candidate, {tidy_sql('score')} AS score FROM (SELECT *, m - 0.5 * s AS score, row_number() OVER (PARTITION BY model ORDER BY round(m - 0.5 * s, 9) DESC, candidate) AS k FROM gs) WHERE k = 1""")
def best_penalties(spark, sf_dir):
    return tidied(linear_grid.best_params(_grid(spark, sf_dir), "composite_ic_rank_ls", 0.5).select("model", "candidate", "score"))


_POOL = {"vwap": "price", "turnover": "size+price", "low": "price", "market_cap": "size"}
_WINDOWS = [(date(1996, 6, 1), date(1996, 9, 1), date(1997, 12, 1)), (date(1998, 1, 1), date(1998, 4, 1), date(1999, 12, 1))]


@query("add_one_by_metric")
def add_one_by_metric(spark, sf_dir):
    rows = base._signals(spark, sf_dir)
    out = None
    for metric in ("composite_ic_rank_ls", "rmse", "spearman_ic_mean"):
        one = linear_grid.add_one(rows, ["volume"], list(_POOL), _WINDOWS, metric, penalty=0.5, groups=5).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return tidied(out)


@query("forward_by_metric")
def forward_by_metric(spark, sf_dir):
    rows = base._signals(spark, sf_dir)
    return tidied(linear_grid.forward_by_metric(rows, ["volume"], _POOL, _WINDOWS, 3, "composite_ic_rank_ls", overlap=0.001, redundancy=0.001, groups=5))


@query("individual_audit")
def individual_audit(spark, sf_dir):
    rows = base._signals(spark, sf_dir)
    return tidied(linear_grid.individual_audit(rows, ["volume"], list(_POOL), _WINDOWS[0], "composite_ic_rank_ls", horizon=1, groups=5))


# ---- boosted trees ----

_STUMPS, _STUMP = 3, ["m", "s", "v"]


def _stump(i):
    """Tree i of one split each, on sums by value: a value's rows and those below it go left, missing ones to either side."""
    return f"""g{i} AS (SELECT f, x, sum(y - margin) AS g, count(*)::DOUBLE AS n FROM r{i - 1}, LATERAL (SELECT unnest([1, 2, 3]) AS f, unnest([m, s, v]) AS x) GROUP BY 1, 2),
c{i} AS (SELECT f, x, missing, sum(g) FILTER (o.x2 <= x OR missing AND o.x2 IS NULL) AS gl, sum(n) FILTER (o.x2 <= x OR missing AND o.x2 IS NULL) AS nl, sum(g) AS gt, sum(n) AS nt FROM (SELECT f, x FROM g{i} WHERE x IS NOT NULL) JOIN (SELECT f, x AS x2, g, n FROM g{i}) o USING (f), (SELECT unnest([false, true]) AS missing) GROUP BY 1, 2, 3),
b{i} AS (SELECT * FROM c{i} WHERE nl < nt ORDER BY round(gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1), 9) DESC, f, x, missing LIMIT 1),
r{i} AS MATERIALIZED (SELECT date, instrument_id, y, m, s, v, margin + 0.5 * CASE WHEN coalesce(z <= x, missing) THEN gl / (nl + 1) ELSE (gt - gl) / (nt - nl + 1) END AS margin FROM (SELECT *, CASE f WHEN 1 THEN m WHEN 2 THEN s ELSE v END AS z FROM r{i - 1}, (SELECT f, x, missing, gl, nl, gt, nt FROM b{i})))"""


@query("boosted_stumps", f"""{_pred}, rp AS (SELECT p.date, p.instrument_id, greatest(least(y, 5), -5) AS y, month(p.date)::DOUBLE AS m, CASE WHEN p.instrument_id % 7 <> 3 THEN (p.instrument_id % 7)::DOUBLE END AS s, least(floor(volume / 40), 9) AS v FROM panel p JOIN pred USING (date, instrument_id) WHERE y IS NOT NULL),
r0 AS MATERIALIZED (SELECT *, avg(y) OVER () AS margin FROM rp), {', '.join(map(_stump, range(1, _STUMPS + 1)))} {tidied_sql(['y', 'predicted_y'], f'(SELECT *, margin AS predicted_y FROM r{_STUMPS})')}""")
def boosted_stumps(spark, sf_dir):
    rows = base._signals(spark, sf_dir).where("y is not null")
    rows = rows.select("date", "instrument_id", F.greatest(F.least("y", F.lit(5.0)), F.lit(-5.0)).alias("y"), F.month("date").cast("double").alias("m"), F.when(F.col("instrument_id") % 7 != 3, F.col("instrument_id") % 7).cast("double").alias("s"), F.least(F.floor(F.col("volume") / 40), F.lit(9)).cast("double").alias("v"))
    model = boosting.fit(rows, _STUMP, boosting.Settings(trees=_STUMPS, step=0.5, leaves=2))
    return tidied(boosting.predict(model, rows).select("date", "instrument_id", "y", "predicted_y"))


@query("boosted_predictions")
def boosted_predictions(spark, sf_dir):
    train, test = calendar.split(base._canonical(spark, sf_dir))
    names = list(factors.CANONICAL)
    model = models.fit(stored(calendar.purge(train.where("y is not null"), 1)), names, "boost_by_leaf", trees=10, leaves=8, step=0.1)
    return tidied(models.predict(model, test).select("date", "instrument_id", "y", "predicted_y"))


# ---- centralities ----


def _power(k):
    return f"""x{k} AS MATERIALIZED (SELECT date, node, y / avg(y) OVER (PARTITION BY date) AS x FROM (SELECT n.date, n.node, 0.15 + 0.85 * coalesce(g.s, 0) AS y FROM x{k - 1} n
  LEFT JOIN (SELECT e.date, e.source AS node, sum(share * x) AS s FROM es e JOIN x{k - 1} t ON t.date = e.date AND t.node = e.target GROUP BY 1, 2) g USING (date, node)))"""


_central = f"""WITH {tp.panel_sql()}, {tp.EDGES_SQL}, es AS (SELECT *, weight / sum(weight) OVER (PARTITION BY date, target) AS share FROM edges),
x0 AS (SELECT DISTINCT date, node, 1.0::DOUBLE AS x FROM (SELECT date, source AS node FROM es UNION ALL SELECT date, target FROM es)), {', '.join(map(_power, range(1, 5)))},
nb AS (SELECT es.date, es.target, sum(share * x) AS near FROM es JOIN x4 ON x4.date = es.date AND node = source GROUP BY 1, 2),
ce AS (SELECT es.*, x AS influence, near FROM es JOIN x4 ON x4.date = es.date AND node = source JOIN nb ON nb.date = es.date AND nb.target = es.target),
cp AS (SELECT date, target AS instrument_id, sum(weight * influence) / sum(weight) AS source_influence_centrality, avg(near) AS target_neighbor_centrality, coalesce(sum(weight) FILTER (same_sector), 0) AS sector_strength, coalesce(sum(weight) FILTER (same_sector), 0) AS quality_strength, 0.0::DOUBLE AS directed_strength FROM ce GROUP BY 1, 2),
cl AS (SELECT e.date, e.target AS instrument_id, sum(weight * v) / nullif(sum(weight) FILTER (v IS NOT NULL), 0) AS lead_lag_peer_ret_1 FROM edges e LEFT JOIN (SELECT date, instrument_id, lag(r) OVER (PARTITION BY instrument_id ORDER BY date) AS v FROM (SELECT date, instrument_id, close / nullif(lag(close) OVER (PARTITION BY instrument_id ORDER BY date), 0) - 1 AS r FROM panel)) p ON p.date = e.date AND p.instrument_id = e.source GROUP BY 1, 2)"""
_central_columns = ["source_influence_centrality", "target_neighbor_centrality", "sector_strength", "quality_strength", "directed_strength", "lead_lag_peer_ret_1"]


@query("relation_centrality", f"{_central} {tidied_sql(_central_columns, 'cp LEFT JOIN cl USING (date, instrument_id)')}")
def relation_centrality(spark, sf_dir):
    edges = relation.with_centralities(tp.edges(spark, sf_dir), rounds=4)
    out = relation.relation_features(edges, relation.market_returns(tp.panel(spark, sf_dir)), (1,))
    return tidied(out.select("instrument_id", "date", *_central_columns))


# ---- staged scores ----


_STAGED = ["open", "high", "low", "volume", "turnover", "vwap", "adjustment", "market_cap"]
_split = "hc AS (SELECT date, t <= (SELECT max(t) FROM cal) // 2 AS early FROM cal)"
_ranks = lambda by, x: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2"
_staged_sql = f"""{_pred}, {_split}, ls AS (SELECT p.date, p.instrument_id, y, predicted_y, early, u.f AS factor, u.v AS value FROM panel p JOIN pred USING (date, instrument_id) JOIN hc USING (date), LATERAL (SELECT unnest({_STAGED}) AS f, unnest([{', '.join(_STAGED)}]) AS v) u),
ic AS (SELECT factor, early, date, CASE WHEN count(*) >= 5 THEN {_corr.format(a='value', b='y')} END AS ic FROM ls WHERE y IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3),
pool AS (SELECT factor, avg(ic) AS pool_ic, row_number() OVER (ORDER BY round(abs(avg(ic)), 9) DESC, factor) AS place FROM ic WHERE early GROUP BY 1),
top AS (SELECT *, CASE WHEN pool_ic < 0 THEN -1 ELSE 1 END AS direction FROM pool WHERE place <= 3),
sh AS (SELECT ls.*, direction * value AS v FROM ls JOIN top USING (factor)),
sr AS (SELECT *, {_ranks('factor, date', 'v')} AS rk, count(*) OVER (PARTITION BY factor, date) AS n, row_number() OVER (PARTITION BY factor, date ORDER BY v DESC, instrument_id) AS pos FROM sh WHERE v IS NOT NULL),
tn AS (SELECT factor, early, avg(d) AS turn FROM (SELECT factor, early, abs(rk / n - lag(rk / n) OVER (PARTITION BY factor, early, instrument_id ORDER BY date)) AS d FROM sr) GROUP BY 1, 2),
tk AS (SELECT *, dense_rank() OVER (PARTITION BY factor, early ORDER BY date) AS k FROM sr WHERE pos <= greatest(ceil(n * 0.2), 1)),
rt AS (SELECT factor, early, avg(stay / were) AS kept FROM (SELECT o.factor, o.early, o.k, count(*) AS were, count(b.instrument_id) AS stay FROM tk o LEFT JOIN tk b ON b.factor = o.factor AND b.early = o.early AND b.k = o.k + 1 AND b.instrument_id = o.instrument_id WHERE o.k < (SELECT max(k) FROM tk z WHERE z.factor = o.factor AND z.early = o.early) GROUP BY 1, 2, 3) GROUP BY 1, 2),
gp AS (SELECT factor, early, date, y, least(greatest(ceil(row_number() OVER (PARTITION BY factor, date ORDER BY v, instrument_id) / count(*) OVER (PARTITION BY factor, date) * 5), 1), 5) AS g FROM sh WHERE y IS NOT NULL AND v IS NOT NULL),
sp AS (SELECT factor, early, max_by(r, g) - min_by(r, g) AS spread FROM (SELECT factor, early, g, avg(r) AS r FROM (SELECT factor, early, date, g, avg(y) AS r FROM gp GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) GROUP BY 1, 2),
nr AS (SELECT factor, round(corr(v, predicted_y), 10) AS oos_baseline_corr FROM sh WHERE NOT early AND v IS NOT NULL GROUP BY 1),
late AS (SELECT factor, avg(ic) AS ic FROM ic WHERE NOT early GROUP BY 1),
st AS (SELECT p.factor AS candidate_id, p.place, CASE WHEN p.place <= 3 THEN 'ok' ELSE 'not_shortlisted' END AS status, p.pool_ic, t.direction * l.ic AS oos_ic, a.turn AS train_rank_turnover, b.turn AS oos_rank_turnover, c.kept AS train_retention, d.kept AS oos_retention,
  e.spread - 2 * (1 - c.kept) * 20 / 1e4 AS train_net_spread, f.spread - 2 * (1 - d.kept) * 20 / 1e4 AS oos_net_spread, oos_baseline_corr
  FROM pool p LEFT JOIN top t USING (factor) LEFT JOIN late l ON l.factor = t.factor LEFT JOIN tn a ON a.factor = t.factor AND a.early LEFT JOIN tn b ON b.factor = t.factor AND NOT b.early LEFT JOIN rt c ON c.factor = t.factor AND c.early LEFT JOIN rt d ON d.factor = t.factor AND NOT d.early LEFT JOIN sp e ON e.factor = t.factor AND e.early LEFT JOIN sp f ON f.factor = t.factor AND NOT f.early LEFT JOIN nr ON nr.factor = t.factor
  UNION ALL SELECT 'no_such_signal', NULL, 'missing_signal', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)"""
_staged_columns = ["pool_ic", "oos_ic", "train_rank_turnover", "oos_rank_turnover", "train_retention", "oos_retention", "train_net_spread", "oos_net_spread", "oos_baseline_corr"]


@query("staged_scores", f"{_staged_sql} {tidied_sql(_staged_columns, 'st', 'candidate_id, place, status')}")
def staged_scores(spark, sf_dir):
    rows = base._signals(spark, sf_dir)
    return tidied(staged.staged_scores(rows, [*_STAGED, "no_such_signal"], 3), ("candidate_id",))
