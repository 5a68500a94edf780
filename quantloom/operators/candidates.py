"""Factor candidates on validation: rewards, run and method summaries, residual scoring, selection by added score."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT
from quantloom.functions.tables import stored

from . import diagnostics

#: Weights of metrics in both rewards.
PREDICTIVE = {"pearson_ic_mean": 1.0, "spearman_ic_mean": 0.50, "long_short_spread": 0.75, "group_monotonic_spearman": 0.02}
INCREMENTAL = {"pearson_ic_mean": 0.25, "spearman_ic_mean": 0.75, "long_short_spread": 1.20, "group_monotonic_spearman": 0.05}
#: Metrics cut to plus or minus a limit, and their weights, in the incremental reward.
BOUNDED = {"pearson_ic_ir": (3.0, 0.025), "spearman_ic_ir": (3.0, 0.035), "non_overlap_sharpe_horizon_adj": (5.0, 0.010)}
#: Weights of positive shares over one half (Pearson, Spearman), logic score, complexity over one, correlation.
EXTRAS = {"predictive_ic": (0.05, 0.03, 0.02, 0.003, 0.03), "incremental_proxy": (0.04, 0.06, 0.04, 0.012, 0.12)}
#: Weights of the composite selection score; metrics of which less is better.
COMPOSITE = {"pearson_ic_mean": 0.50, "spearman_ic_mean": 0.30, "long_short_return": 0.20}
#: Weights of the score of a signal against a residual, and of its positive shares over one half.
RESIDUAL = {"ic_mean": 1.0, "rank_ic_mean": 0.5, "spread": 0.75, "monotonicity": 0.02}
RESIDUAL_SHARES = {"ic_positive_ratio": 0.05, "rank_ic_positive_ratio": 0.03}
LESS_IS_BETTER = ("rmse", "mae", "portfolio_max_drawdown")


def _metric(df: DataFrame, name: str, default: float = 0.0):
    """The column as a finite double, ``default`` where it is missing, null or not finite."""
    if name not in df.columns:
        return F.lit(default)
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(default)


def reward(df: DataFrame, mode: str, prefix: str = ""):
    """The reward of each candidate row by ``mode`` (predictive_ic or incremental_proxy) from the metrics with a prefix;
    financial_logic_score, formula_complexity and max_signal_corr_abs come without one."""
    if mode not in EXTRAS:
        raise ValueError(mode)
    m = lambda name: _metric(df, prefix + name)
    pearson, spearman, logic, complexity, corr = EXTRAS[mode]
    parts = [w * m(x) for x, w in (PREDICTIVE if mode == "predictive_ic" else INCREMENTAL).items()]
    if mode == "incremental_proxy":
        parts += [w * F.greatest(F.least(m(x), F.lit(k)), F.lit(-k)) for x, (k, w) in BOUNDED.items()]
    over = lambda name: F.greatest(m(name) - 0.5, F.lit(0.0))
    parts += [pearson * over("pearson_ic_positive_ratio"), spearman * over("spearman_ic_positive_ratio"), logic * _metric(df, "financial_logic_score")]
    own = next((x for x in (f"{prefix}max_signal_corr_abs", "validation_max_signal_corr_abs", "max_signal_corr_abs") if x in df.columns), "max_signal_corr_abs")
    size = "formula_complexity" if "formula_complexity" in df.columns else "complexity"
    parts += [-complexity * F.greatest(_metric(df, size, 1.0) - 1, F.lit(0.0)), -corr * _metric(df, own)]
    return reduce(lambda a, b: a + b, parts)


def tagged_runs(runs: dict[str, DataFrame], prefix: str = "train_") -> DataFrame:
    """Candidate tables of several runs as one, with method and both rewards by the metrics they were selected by and by
    those out of sample. Columns that a run lacks are null."""
    out = None
    for method, df in runs.items():
        found = {f"{kind}_{mode}_reward": reward(df, mode, p) for mode in EXTRAS for kind, p in (("selection", prefix), ("oos", "oos_"))}
        one = df.withColumns(found).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def method_rewards(candidates: DataFrame, top: int, metrics=("oos_pearson_ic_mean", "oos_spearman_ic_mean", "oos_long_short_spread"), passes: str | None = None, about=()) -> DataFrame:
    """(method, reward_mode, selected_top_k, means, top candidate): of each method's best ``top`` by each selection reward. ``passes``
    is a boolean column whose share (null: no) becomes oos_pass_ratio, ``about`` names columns told of the top candidate."""
    modes = F.explode(F.array(*(F.struct(F.lit(x).alias("reward_mode"), F.col(f"selection_{x}_reward").alias("s"), F.col(f"oos_{x}_reward").alias("o")) for x in EXTRAS))).alias("r")
    kept = dict.fromkeys(["method", "candidate_id", *metrics, *about, *([passes] if passes else [])])
    rows = candidates.select(*kept, modes).select(*kept, "r.*")
    w = Window.partitionBy("method", "reward_mode").orderBy(F.desc_nulls_last("s"), "candidate_id")
    rows = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    first = lambda x: F.max(F.when(F.col("_k") == 1, F.col(x)))
    return rows.groupBy("method", "reward_mode").agg(
        F.count("*").alias("selected_top_k"), F.avg("s").alias("selection_score_mean"), F.avg("o").alias("oos_reward_mean"), *(F.avg(x).alias(f"{x}_mean" if not x.endswith("_mean") else x) for x in metrics),
        *([F.avg(F.coalesce(F.col(passes).cast("double"), F.lit(0.0))).alias("oos_pass_ratio")] if passes else []), *(first(x).alias(f"top_{x}") for x in about),
        first("candidate_id").alias("top_candidate_id"), first("s").alias("top_selection_reward"), first("o").alias("top_oos_reward"),
    )


def run_overview(candidates: DataFrame) -> DataFrame:
    """By method: candidates, selected ones, share of repeated formulas, and the best rewards and metrics out of sample."""
    n = F.count("*")
    best = [F.max(x).alias(f"best_{x}") for x in ("oos_predictive_ic_reward", "oos_incremental_proxy_reward", "oos_pearson_ic_mean", "oos_spearman_ic_mean", "oos_long_short_spread")]
    passed = F.sum(F.coalesce(F.col("passes_oos_filter").cast("long"), F.lit(0)))
    return candidates.groupBy("method").agg(n.alias("candidate_count"), passed.alias("oos_pass_count"), (1 - F.countDistinct("formula") / n).alias("duplicate_formula_ratio"), *best)


def metric_score(df: DataFrame, metric: str):
    """The selection score of a metrics row: a metric turned so that more is better, a weighted mean by the name of
    composite_ic_rank_ls, -1e9 where it is missing."""
    if metric == "composite_ic_rank_ls":
        return reduce(lambda a, b: a + b, (w * _metric(df, x) for x, w in COMPOSITE.items()))
    x = F.col(metric).cast("double") if metric in df.columns else F.lit(None).cast("double")
    return F.when(x.isNull() | F.isnan(x), -1e9).otherwise(-x if metric in LESS_IS_BETTER else x)


def fold_scores(folds: DataFrame, by, score: str, metrics=(), penalty: float = 0.5) -> DataFrame:
    """By experiment over validation windows: means of metrics; mean, deviation (of all) and least of the score; the mean
    less the penalty times the deviation."""
    mean, dev = F.avg(score), F.stddev_pop(score)
    return folds.groupBy(*by).agg(*(F.avg(x).alias(x) for x in metrics), F.count(score).alias("windows"), mean.alias("score_mean"), dev.alias("score_std"), F.min(score).alias("score_min"), (mean - penalty * dev).alias("stable_score"))


def metadata_list(column):
    """The lower-cased entries of a list joined by commas or plus signs, without repeats; none for null."""
    parts = F.transform(F.split(F.replace(F.coalesce(column, F.lit("")), F.lit("+"), F.lit(",")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def family_overlap(candidate, selected, penalty: float):
    """The penalty where a candidate's families share one with any of the selected lists (an array of strings)."""
    own = metadata_list(candidate)
    return F.when(F.exists(selected, lambda s: F.arrays_overlap(metadata_list(s), own)), F.lit(float(penalty))).otherwise(0.0)


def families_of(formula, keywords: dict[str, tuple[str, ...]]):
    """All families of which the formula holds a keyword, in order of names, joined by +; other if none."""
    found = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (formula.contains(k) for k in words)), F.lit(name)) for name, words in sorted(keywords.items()))))
    return F.when(F.size(found) > 0, F.array_join(found, "+")).otherwise("other")


def residual_scores(df: DataFrame, candidates, target: str = "residual", baseline: str = "predicted_y", groups: int = 5, least: int = 5) -> DataFrame:
    """(candidate, direction, ic, rank_ic, spread, baseline_corr, score): how each candidate ranks what a baseline leaves,
    turned by the sign of its mean coefficient; the score is the coefficient times one minus the size of the mean
    correlation with the baseline's predictions. All candidates in one pass."""
    rows = diagnostics.long_form(df, candidates, (DATE, INSTRUMENT, target, baseline))
    ic = diagnostics.daily_ic(rows, "value", target, ("factor",), least).groupBy("factor").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"))
    near = diagnostics.daily_ic(rows, "value", baseline, ("factor",), least).groupBy("factor").agg(F.avg("ic").alias("baseline_corr"))
    ends = diagnostics.spread(diagnostics.group_returns(rows, groups, "value", target, ("factor",)), ("factor",)).select("factor", "spread")
    out = ic.join(near, "factor", "left").join(ends, "factor", "left")
    sign = F.when(F.col("ic") < 0, -1).otherwise(1)
    turned = {x: sign * F.col(x) for x in ("ic", "rank_ic", "spread")}
    out = out.withColumn("direction", sign).withColumns(turned).withColumnRenamed("factor", "candidate")
    return out.withColumn("score", F.col("ic") * (1 - F.abs(F.coalesce("baseline_corr", F.lit(0.0)))))


def residual_incremental(df: DataFrame, candidates, target: str = "residual", baseline: str = "predicted_y", groups: int = 5, least: int = 5) -> DataFrame:
    """(candidate, direction, metrics..., baseline_corr, score, incremental_score): each candidate against what a baseline leaves,
    turned by the sign of its mean coefficient (positive shares become their rest). The score is the weighted sum of RESIDUAL and
    RESIDUAL_SHARES, null where a metric is; times one less the size of the correlation with the baseline's predictions over
    all rows it is the incremental score (0 where there is none)."""
    s = diagnostics.factor_summary(df, candidates, target, groups, least)
    near = diagnostics.long_form(df, candidates, (DATE, INSTRUMENT, baseline)).where(F.col("value").isNotNull() & F.col(baseline).isNotNull())
    near = near.groupBy("factor").agg(F.round(F.corr("value", baseline), 10).alias("_c"))
    down = F.col("ic_mean") < 0
    out = s.join(near, "factor", "left").withColumn("direction", F.when(down, -1).otherwise(1))
    turned = {x: F.when(down, -F.col(x)).otherwise(F.col(x)) for x in RESIDUAL} | {x: F.when(down, 1 - F.col(x)).otherwise(F.col(x)) for x in RESIDUAL_SHARES}
    out = out.withColumns({x: c for x, c in turned.items() if x != "ic_mean"}).withColumn("ic_mean", turned["ic_mean"])
    out = out.withColumn("baseline_corr", F.when(F.isnan("_c"), None).otherwise(F.col("direction") * F.col("_c")))
    score = sum(w * F.col(x) for x, w in RESIDUAL.items()) + sum(w * F.greatest(F.col(x) - 0.5, F.lit(0.0)) for x, w in RESIDUAL_SHARES.items())
    out = out.withColumn("score", F.when(F.least(*(F.col(x).isNotNull() for x in RESIDUAL_SHARES)), score))
    out = out.withColumn("incremental_score", F.col("score") * F.coalesce(1 - F.least(F.abs("baseline_corr"), F.lit(1.0)), F.lit(0.0)))
    return out.select(F.col("factor").alias("candidate"), "direction", *RESIDUAL, *RESIDUAL_SHARES, "baseline_corr", "score", "incremental_score")


def validation_scores(df: DataFrame, candidates, target: str = "residual", groups: int = 5, least: int = 5) -> DataFrame:
    """(candidate, ic, rank_ic, long_short_return, ic_days, score): each candidate against a validation residual as it is; the score
    is the composite one, missing parts 0."""
    rows = diagnostics.long_form(df, candidates, (DATE, INSTRUMENT, target))
    ic = diagnostics.daily_ic(rows, "value", target, ("factor",), least).groupBy("factor").agg(F.avg("ic").alias("ic"), F.avg("rank_ic").alias("rank_ic"), F.count("ic").alias("ic_days"))
    ends = diagnostics.spread(diagnostics.group_returns(rows, groups, "value", target, ("factor",)), ("factor",)).select("factor", F.col("spread").alias("long_short_return"))
    part = dict(zip(COMPOSITE, ("ic", "rank_ic", "long_short_return"), strict=True))
    score = sum(w * F.coalesce(F.col(part[x]), F.lit(0.0)) for x, w in COMPOSITE.items())
    return ic.join(ends, "factor", "left").withColumn("score", score).withColumnRenamed("factor", "candidate")


def signed_columns(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """``df`` with res_<candidate>: each chosen candidate (candidate, direction; a row per candidate) times its direction."""
    return df.withColumns({f"res_{r.candidate}": F.col(r.candidate) * r.direction for r in chosen.select("candidate", "direction").collect()})


# ---- selection by added score ----


def moments(df: DataFrame, features, target: str = "y") -> tuple[list, np.ndarray]:
    """(dates, sums [dates, k, k]): sums of products of 1, the features and the target over the complete rows of each
    date, in one aggregation. Every linear fit and its daily coefficients follow from them, so selection reads the rows
    once. A row per date and k (k + 1) / 2 numbers come to the driver: for lists of tens of features."""
    names = [F.lit(1.0), *map(F.col, features), F.col(target)]
    rows = df.dropna(subset=[*features, target])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    found = rows.groupBy(DATE).agg(*(F.sum(names[i] * names[j]).alias(f"m{i}_{j}") for i, j in pairs)).orderBy(DATE).collect()
    sums = np.zeros((len(found), len(names), len(names)))
    for d, r in enumerate(found):
        for i, j in pairs:
            sums[d, i, j] = sums[d, j, i] = r[f"m{i}_{j}"]
    return [r[DATE] for r in found], sums


def ridge_by_moments(total: np.ndarray, at: list[int], alpha: float = 1.0) -> np.ndarray:
    """Coefficients (of the columns ``at`` as they are) of a ridge fit on columns scaled to unit sample deviation."""
    n, y = total[0, 0], len(total) - 1
    mean = total[0] / n
    cov = total - n * np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov)[at] / max(n - 1, 1), 0))
    dev = np.where(dev > 1e-12, dev, np.inf)
    x = cov[np.ix_(at, at)] / np.outer(dev, dev)
    return np.linalg.solve(x + alpha * np.eye(len(at)), cov[at, y] / dev) / dev


def mean_daily_ic(sums: np.ndarray, at: list[int], coef: np.ndarray) -> float:
    """The mean over dates of the correlation of prediction and target."""
    n, y = sums[:, 0, 0], sums.shape[1] - 1
    mean = sums[:, 0, :] / n[:, None]
    cov = sums / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    both = cov[:, at, y] @ coef
    own = np.einsum("i,dij,j->d", coef, cov[:, at][:, :, at], coef)
    ok = (own > 1e-18) & (cov[:, y, y] > 1e-18) & (n >= 2)
    return float(np.mean(both[ok] / np.sqrt(own[ok] * cov[ok, y, y]))) if ok.any() else float("nan")


def window_scores(dates, sums, at: list[int], windows, alpha: float = 1.0) -> list[float]:
    """For each (train_end, valid_start, valid_end) the mean daily coefficient on validation of a fit on the dates before."""
    when, out = np.array(dates), []
    for end, start, stop in windows:
        train, valid = sums[when <= end], sums[(when >= start) & (when <= stop)]
        out.append(mean_daily_ic(valid, at, ridge_by_moments(train.sum(0), at, alpha)) if len(train) and len(valid) else float("nan"))
    return out


def add_one_scores(df: DataFrame, base, candidates, windows, alpha: float = 1.0, penalty: float = 0.5) -> DataFrame:
    """(candidate, score_mean, score_min, stable_score, gain): the baseline with each candidate alone, over all windows."""
    names = [*base, *candidates]
    dates, sums = moments(df, names)
    own = window_scores(dates, sums, list(range(1, len(base) + 1)), windows, alpha)
    rows = []
    for k, c in enumerate(candidates):
        s = np.array(window_scores(dates, sums, [*range(1, len(base) + 1), len(base) + 1 + k], windows, alpha))
        rows.append((c, float(np.nanmean(s)), float(np.nanmin(s)), float(np.nanmean(s) - penalty * np.nanstd(s)), float(np.nanmean(s) - np.nanmean(own))))
    return df.sparkSession.createDataFrame(rows, "candidate string, score_mean double, score_min double, stable_score double, gain double")


def forward_selection(df: DataFrame, base, candidates: dict[str, str], windows, steps: int, alpha: float = 1.0, penalty: float = 0.5, overlap: float = 0.0, redundancy: float = 0.0, least: float = 0.0) -> DataFrame:
    """(step, candidate, family, score, gain): step by step the candidate (name: families) that adds most to the stable score
    of the windows, less ``overlap`` if it shares a family with one taken and ``redundancy`` times its largest pooled
    correlation with those; until none adds more than ``least``. Ties: the first name."""
    names = [*base, *candidates]
    dates, sums = moments(df, names)
    stable = lambda at: (lambda s: np.nanmean(s) - penalty * np.nanstd(s))(np.array(window_scores(dates, sums, at, windows, alpha)))
    total = sums.sum(0)
    cov = total / total[0, 0] - np.outer(total[0], total[0]) / total[0, 0] ** 2
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = np.abs(cov / np.outer(dev, dev))
    split = lambda x: {y.strip().lower() for y in (x or "").replace("+", ",").split(",")} - {""}
    taken, rows, at = [], [], list(range(1, len(base) + 1))
    score = stable(at) if at else 0.0
    for step in range(1, steps + 1):
        best = None
        for c in candidates:
            if c in taken:
                continue
            i = names.index(c) + 1
            value = stable([*at, i]) - score
            if any(split(candidates[c]) & split(candidates[x]) for x in taken):
                value -= overlap
            if taken:
                value -= redundancy * max(corr[i, names.index(x) + 1] for x in taken)
            if not np.isnan(value) and (best is None or value > best[0]):
                best = value, c, i
        if best is None or best[0] <= least:
            break
        taken.append(best[1])
        at.append(best[2])
        score = stable(at)
        rows.append((step, best[1], candidates[best[1]], float(score), float(best[0])))
    return df.sparkSession.createDataFrame(rows, "step int, candidate string, family string, score double, gain double")


def audit_steps(df: DataFrame, base, chosen: list[str], train_end, alpha: float = 1.0) -> DataFrame:
    """(step, candidate, ic): the mean daily coefficient after ``train_end`` with the first 0, 1, ... chosen candidates."""
    names = [*base, *chosen]
    dates, sums = moments(df, names)
    when = np.array(dates)
    rows = []
    for step in range(len(chosen) + 1):
        at = list(range(1, len(base) + step + 1))
        if at:
            coef = ridge_by_moments(sums[when <= train_end].sum(0), at, alpha)
            rows.append((step, chosen[step - 1] if step else None, mean_daily_ic(sums[when > train_end], at, coef)))
    return df.sparkSession.createDataFrame(rows, "step int, candidate string, ic double")


# ---- views of grids ----


def anomaly_columns(grid: DataFrame, wanted) -> DataFrame:
    """Those of the wanted columns that the grid has."""
    return grid.select(*(x for x in wanted if x in grid.columns))


def grid_slice(grid: DataFrame, hold=(10,), top_k=(20, 50), cost_bps=(20.0,)) -> DataFrame:
    """The cells of a grid with these settings."""
    return grid.where(F.col("hold").isin(*hold) & F.col("top_k").isin(*top_k) & F.col("cost_bps").isin(*cost_bps))


def compact(grid: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under short names, in this order."""
    return grid.select(*(F.col(x).alias(y) for x, y in names.items()))


# ---- the strict path ----


def strict_features(df: DataFrame, features, horizon: int, test: float = 0.2, history: int = 260, start=None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with features made without a look ahead: split by date, training rows purged of labels that reach
    into the test dates, training features from those rows alone; test features from the last ``history`` training rows
    and the test rows, cut to the test dates. Rows without y go. ``features`` maps a panel to a panel with features."""
    from . import calendar

    raw, later = calendar.split(df, test, start)
    train = features(calendar.purge(raw, horizon))
    context = features(calendar.history_context(raw, later, history))
    days = later.select(DATE).distinct()
    return train.where("y is not null"), context.join(F.broadcast(days), DATE, "left_semi").where("y is not null")  # a row per date


def strict_group(df: DataFrame, features, columns, models: dict[str, list[dict]], horizon: int, folds: int = 3, top: int | None = None, test: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, fold scores, model weights) of one feature group: features on the strict path, walk-forward validation
    on the training dates, a final fit of each model with its best parameters, and their weighted mean on the test dates."""
    from . import models as M
    from . import selection

    train, later = (stored(x) for x in strict_features(df, features, horizon, test))
    found, best, weights = M.walk_forward(train, columns, models, folds, horizon, top)
    chosen = selection.fit(train, columns, top=top)
    a = stored(selection.transform(train, chosen, (DATE, INSTRUMENT, "y")))
    b = stored(selection.transform(later, chosen, (DATE, INSTRUMENT, "y")))
    out = None
    for r in best.collect():  # a row per model
        fit = M.fit(a, chosen.features, r.model, **models[r.model][r.candidate])
        one = M.predict(fit, b).select(DATE, INSTRUMENT, "y", "predicted_y").withColumn("model", F.lit(r.model))
        out = one if out is None else out.unionByName(one)
    return M.ensemble(out, weights), found, weights


def window_metrics(predictions: DataFrame, windows: DataFrame, groups: int = 5) -> DataFrame:
    """(mode, start, end, rows, instruments, first_date, last_date, rmse, mae, ic_mean, rank_ic_mean, spread) by window. Daily
    values are computed once; windows, which are few, only average them."""
    e = F.col("predicted_y") - F.col("y")
    span = F.col(DATE).between(F.col("start"), F.col("end"))
    key = ["mode", "start", "end"]
    own = predictions.join(F.broadcast(windows), span).groupBy(*key).agg(F.count("*").alias("rows"), F.countDistinct(INSTRUMENT).alias("instruments"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    ic = diagnostics.daily_ic(predictions).join(F.broadcast(windows), span).groupBy(*key).agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"))
    pairs = predictions.where("predicted_y is not null and y is not null").withColumn("group", diagnostics.quantile_group(F.col("predicted_y"), groups, DATE))
    day = pairs.groupBy(DATE, "group").agg(F.avg("y").alias("r")).join(F.broadcast(windows), span).groupBy(*key, "group").agg(F.avg("r").alias("r"))
    ends = day.groupBy(*key).agg((F.max_by("r", "group") - F.min_by("r", "group")).alias("spread"))
    return own.join(ic, key, "left").join(ends, key, "left")
