"""Linear models from sums of products: every penalty of every fold is fitted from one scan of the rows, and the predictions of all
trial models are ranked and grouped in one pass over the validation dates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT, order
from quantloom.functions.tables import stored

from . import calendar, candidates
from .signals import added

#: Rounds of coordinate descent at most, and the change of a coefficient (of standardised columns) that ends them.
ROUNDS, STILL = 10_000, 1e-12


@dataclass
class Sums:
    """Sums of products of 1, the columns (less ``centre``, over ``scale``) and y (less its centre) of each fold's training rows."""

    columns: list[str]
    centre: np.ndarray
    scale: np.ndarray
    y_centre: float
    folds: dict[int, np.ndarray]


def tagged(df: DataFrame, windows: list[tuple], horizon: int = 0) -> DataFrame:
    """``df`` with seg (how many of the training ends lie before the row), cuts (windows, from 1, whose training part the row
    ends within ``horizon`` rows of its instrument, so that its label reaches over the end) and valid (windows it validates).

    ``windows`` are (train_end, valid_start, valid_end) by training end; training takes all dates up to it."""
    later = F.lead(DATE, horizon).over(order()) if horizon else F.col(DATE)
    rows = df.withColumn("_later", later)
    day = F.col(DATE)
    end = [F.lit(w[0]) for w in windows]
    cut = [F.when((day <= e) & (F.col("_later").isNull() | (F.col("_later") > e)), F.lit(i + 1)) for i, e in enumerate(end)] if horizon else []
    valid = [F.when(day.between(F.lit(a), F.lit(b)), F.lit(i + 1)) for i, (_, a, b) in enumerate(windows)]
    seg = sum(((day > e).cast("int") for e in end), F.lit(0))
    none = F.array().cast("array<int>")
    return rows.withColumns({"seg": seg, "cuts": F.array_compact(F.array(*cut)) if cut else none, "valid": F.array_compact(F.array(*valid))}).drop("_later")


def fold_windows(df: DataFrame, n_folds: int) -> list[tuple]:
    """(train_end, valid_start, valid_end) of expanding folds over the dates of ``df``; a row per date comes to the driver."""
    days = [r[DATE] for r in calendar.calendar(df).orderBy(DATE).collect()]
    size = len(days) // (n_folds + 1)
    ends = [len(days) - (n_folds + 1 - f) * size for f in range(1, n_folds + 1)]
    return [(days[e - 1], days[e], days[e + size - 1]) for e in ends] if size else []


def _grams(columns, centre, scale, y_centre):
    def run(frames):
        found: dict[int, np.ndarray] = {}
        for f in frames:
            x = (f[columns].to_numpy(float) - centre) / scale
            z = np.column_stack([np.ones(len(f)), x, f["y"].to_numpy(float) - y_centre])
            keys = [(int(s), f["seg"].to_numpy() == s) for s in f["seg"].unique()]
            cuts = f["cuts"].map(lambda c: sum(1 << int(i) for i in c)).to_numpy(np.int64) if len(f) else np.zeros(0, np.int64)
            keys += [(-i, (cuts >> i) & 1 == 1) for i in range(1, int(cuts.max(initial=0)).bit_length())]
            for key, rows in keys:
                if rows.any():
                    one = z[rows].T @ z[rows]
                    found[key] = found[key] + one if key in found else one
        part = TaskContext.get().partitionId()
        if found:
            yield pd.DataFrame([(k, part, m.tobytes()) for k, m in found.items()], columns=["key", "part", "m"])

    return run


def fold_sums(rows: DataFrame, columns, n_windows: int) -> Sums:
    """The sums of each window's training rows (complete ones), from tagged rows: those of all segments before its end, less those
    of purged rows. One pass for means and deviations, so that large columns lose no digits, and one for the sums."""
    columns = list(columns)
    rows = rows.dropna(subset=[*columns, "y"]).select("seg", "cuts", F.col("y").cast("double").alias("y"), *(F.col(x).cast("double").alias(x) for x in columns))
    one = rows.agg(*(F.avg(x) for x in [*columns, "y"]), *(F.stddev_pop(x) for x in columns)).first()
    k = len(columns)
    centre = np.array([x or 0.0 for x in one[: k + 1]])
    scale = np.array([x if x and x > 0 else 1.0 for x in one[k + 1 :]])
    sums = added(rows.mapInPandas(_grams(columns, centre[:k], scale, centre[k]), "key int, part long, m binary"), ["key"], ["m"])
    by = {r.key: np.frombuffer(r.m, float).reshape(k + 2, k + 2) for r in sums.collect()}  # (k + 2)**2 numbers a fold, twice
    none = np.zeros((k + 2, k + 2))
    folds = {f: sum((by.get(s, none) for s in range(f)), none) - by.get(-f, none) for f in range(1, n_windows + 1)}
    return Sums(columns, centre[:k], scale, float(centre[k]), folds)


def descend(a: np.ndarray, b: np.ndarray, absolute: float, squared: float) -> np.ndarray:
    """The w that makes w'aw / 2 - b'w + absolute |w| + squared w'w / 2 least, by coordinates in turn."""
    w, left = np.zeros(len(b)), b.copy()
    for _ in range(ROUNDS):
        most = 0.0
        for j in range(len(b)):
            old, own = w[j], left[j] + a[j, j] * w[j]
            down = a[j, j] + squared
            w[j] = np.sign(own) * max(abs(own) - absolute, 0.0) / down if down > 0 else 0.0
            if w[j] != old:
                left -= a[:, j] * (w[j] - old)
                most = max(most, abs(w[j] - old))
        if most < STILL:
            break
    return w


def fit(sums: Sums, fold: int, at: list[int], model: str, alpha: float, l1_ratio: float = 0.5) -> tuple[np.ndarray, float] | None:
    """(coefficients of all columns as the sums have them, constant) of a model on the columns ``at``: ridge (alpha beside the sum
    of squares), lasso or elastic_net (alpha beside half the mean square), columns over their sample deviations in the fold."""
    g = sums.folds[fold]
    n, y = g[0, 0], len(g) - 1
    if n < 2:
        return None
    mean = g[0] / n
    cov = g - n * np.outer(mean, mean)
    i = np.array(at, int) + 1
    dev = np.sqrt(np.maximum(np.diag(cov)[i] / (n - 1), 0))
    dev = np.where(dev > 1e-12, dev, np.inf)
    a, b = cov[np.ix_(i, i)] / np.outer(dev, dev) / n, cov[i, y] / dev / n
    if model == "ridge":
        w = np.linalg.solve(a + np.eye(len(i)) * alpha / n, b)
    else:
        share = 1.0 if model == "lasso" else l1_ratio
        w = descend(a, b, alpha * share, alpha * (1 - share))
    out = np.zeros(len(sums.columns))
    out[at] = w / dev
    return out, float(mean[y] + sums.y_centre - out @ mean[1:y])


def mean_corr(a, b):
    """Correlations of the columns of a with b, null where either hardly varies."""
    n = len(b)
    da, db = a - a.mean(0), b - b.mean()
    sa, sb = np.sqrt((da * da).mean(0)), np.sqrt((db * db).mean())
    ok = (sa > 1e-9 * np.abs(a.mean(0))) & (sb > 1e-9 * abs(b.mean())) & (n >= 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(ok, np.round((da * db[:, None]).mean(0) / (sa * sb), 10), np.nan)


def _daily(columns, centre, scale, weights, groups):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = int(pdf["fold"].iloc[0])
        trials, w, c = weights[fold]
        pdf = pdf.sort_values(INSTRUMENT, kind="stable")
        y = pdf["y"].to_numpy(float)
        p = np.round((pdf[columns].to_numpy(float) - centre) / scale @ w + c, 12)
        n = len(y)
        place = np.empty(p.shape, np.int64)
        np.put_along_axis(place, np.argsort(p, axis=0, kind="stable"), np.arange(1, n + 1)[:, None], 0)
        group = np.clip(np.ceil(place / n * groups), 1, groups)
        means = []
        for g in range(1, groups + 1):
            own = group == g
            count = own.sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                means.append(np.where(count > 0, (own * y[:, None]).sum(0) / count, np.nan))
        e = p - y[:, None]
        out = {"fold": fold, "trial": trials, DATE: pdf[DATE].iloc[0], "n": n, "ic": mean_corr(p, y), "rank_ic": mean_corr(pd.DataFrame(p).rank().to_numpy(), pd.Series(y).rank().to_numpy()), "sse": (e * e).sum(0), "sae": np.abs(e).sum(0)}
        out |= {f"g{g + 1}": m for g, m in enumerate(means)}
        return pd.DataFrame(out)

    return run


def trial_metrics(rows: DataFrame, sums: Sums, trials: list[tuple[int, int, np.ndarray, float]], groups: int = 10) -> DataFrame:
    """(fold, trial, pearson_ic_mean, spearman_ic_mean, rmse, mae, long_short_return, n_dates, n_rows) of trial models (trial,
    fold, coefficients, constant) on the rows that validate their fold. A date's cross-section is one group: predictions of
    all trials are one product with the matrix of coefficients, ranked and grouped there; rows are shuffled once by date."""
    folds = sorted({t[1] for t in trials})
    weights = {f: ([t[0] for t in trials if t[1] == f], np.column_stack([t[2] for t in trials if t[1] == f]), np.array([t[3] for t in trials if t[1] == f])) for f in folds}
    names = sums.columns
    valid = rows.dropna(subset=[*names, "y"]).select(F.explode("valid").alias("fold"), DATE, INSTRUMENT, F.col("y").cast("double").alias("y"), *(F.col(x).cast("double").alias(x) for x in names)).where(F.col("fold").isin(folds))
    day = rows.schema[DATE].dataType.simpleString()
    schema = f"fold int, trial int, {DATE} {day}, n long, ic double, rank_ic double, sse double, sae double, " + ", ".join(f"g{g} double" for g in range(1, groups + 1))
    days = stored(valid.groupBy("fold", DATE).applyInPandas(_daily(names, sums.centre, sums.scale, weights, groups), schema))
    clean = lambda x: F.when(~F.isnan(x), F.col(x))
    agg = [F.avg(clean("ic")).alias("pearson_ic_mean"), F.avg(clean("rank_ic")).alias("spearman_ic_mean"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), (F.sum("sae") / F.sum("n")).alias("mae"), F.count("*").alias("n_dates"), F.sum("n").alias("n_rows")]
    agg += [F.avg(clean(f"g{g}")).alias(f"g{g}") for g in range(1, groups + 1)]
    ends = F.coalesce(*(F.col(f"g{g}") for g in range(groups, 0, -1))) - F.coalesce(*(F.col(f"g{g}") for g in range(1, groups + 1)))
    return days.groupBy("fold", "trial").agg(*agg).withColumn("long_short_return", ends).drop(*(f"g{g}" for g in range(1, groups + 1)))


def param_candidates(base: dict | None, grid: list[dict] | None) -> list[dict]:
    """The parameters to try: those of the grid over the base, or the base alone."""
    return [{**(base or {}), **g} for g in grid] if grid else [dict(base or {})]


def penalty_grid(df: DataFrame, columns, models: dict[str, list[dict]], n_folds: int = 3, horizon: int = 1, groups: int = 10) -> DataFrame:
    """(fold, model, candidate, params, n_features, metrics...) of each parameter set of each linear model (ridge, lasso,
    elastic_net) in walk-forward folds: training rows purged by instrument, fitted from sums, validated in one pass.

    Rows with a null in a column or y are left out, but count in the purge; n_features are coefficients that are not zero."""
    windows = fold_windows(df, n_folds)
    rows = stored(tagged(df, windows, horizon).select(DATE, INSTRUMENT, "y", *columns, "seg", "cuts", "valid"))
    sums = fold_sums(rows, columns, len(windows))
    trials, names = [], []
    for fold in range(1, len(windows) + 1):
        for model, sets in models.items():
            for k, params in enumerate(sets):
                found = fit(sums, fold, list(range(len(columns))), model, params["alpha"], params.get("l1_ratio", 0.5))
                if found is not None:
                    names.append((len(trials), model, k, str(params), int((found[0] != 0).sum())))
                    trials.append((len(trials), fold, *found))
    spark = df.sparkSession
    told = spark.createDataFrame(names, "trial int, model string, candidate int, params string, n_features int")
    return told.join(trial_metrics(rows, sums, trials, groups), "trial").drop("trial")


def best_params(grid: DataFrame, metric: str = "pearson_ic_mean", penalty: float = 0.0) -> DataFrame:
    """(model, candidate, params, score): of each model the parameters with the best score over the folds (mean less penalty times
    deviation; ties: the first)."""
    scored = candidates.fold_scores(grid.withColumn("_s", candidates.metric_score(grid, metric)), ["model", "candidate", "params"], "_s", penalty=penalty)
    first = Window.partitionBy("model").orderBy(F.desc_nulls_last("stable_score"), "candidate")
    return scored.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("model", "candidate", "params", F.col("stable_score").alias("score"))


def _scored(rows, sums, sets: dict[str, list[int]], n_windows, metric, model, alpha, groups) -> dict[str, np.ndarray]:
    """Scores by window of the model on each set of columns: one pass."""
    trials, names = [], list(sets)
    for i, name in enumerate(names):
        for fold in range(1, n_windows + 1):
            found = fit(sums, fold, sets[name], model, alpha)
            if found is not None:
                trials.append((i, fold, *found))
    out = {name: np.full(n_windows, np.nan) for name in names}
    m = trial_metrics(rows, sums, trials, groups)
    for r in m.select("trial", "fold", candidates.metric_score(m, metric).alias("s")).collect():  # a row per trial and window
        out[names[r.trial]][r.fold - 1] = r.s
    return out


def _stable(scores: np.ndarray, penalty: float) -> float:
    return float(np.nanmean(scores) - penalty * np.nanstd(scores))


def add_one(df: DataFrame, base, pool, windows, metric: str = "pearson_ic_mean", model: str = "ridge", alpha: float = 1.0, penalty: float = 0.0, horizon: int = 0, groups: int = 10, least: float = 0.0) -> DataFrame:
    """(candidate, score_mean, score_min, stable_score, gain, positive_ratio): the base columns with each candidate alone, by any
    metric that candidates.metric_score knows, over all windows; gain is against the base, positive_ratio the share of windows
    that gain more than ``least``. One scan for the sums, one pass over the validation dates."""
    names = [*base, *pool]
    rows = stored(tagged(df, windows, horizon).select(DATE, INSTRUMENT, "y", *names, "seg", "cuts", "valid"))
    sums = fold_sums(rows, names, len(windows))
    own = list(range(len(base)))
    sets = ({"": own} if own else {}) | {c: [*own, len(base) + i] for i, c in enumerate(pool)}
    found = _scored(rows, sums, sets, len(windows), metric, model, alpha, groups)
    before = found.get("", np.zeros(len(windows)))
    out = [(c, float(np.nanmean(s)), float(np.nanmin(s)), _stable(s, penalty), _stable(s, penalty) - _stable(before, penalty), float(np.mean(s - before > least))) for c, s in found.items() if c]
    return df.sparkSession.createDataFrame(out, "candidate string, score_mean double, score_min double, stable_score double, gain double, positive_ratio double")


def individual_audit(df: DataFrame, base, pool, window: tuple, metric: str = "pearson_ic_mean", model: str = "ridge", alpha: float = 1.0, horizon: int = 0, groups: int = 10, least: float = 0.0) -> DataFrame:
    """(rank, candidate, metrics..., oos_selection_score, delta_vs_baseline, improves_baseline) out of sample: of the base columns alone
    (rank 0, no candidate) and with each candidate of ``pool`` in its order, all fitted on the training rows of ``window`` and
    predicted in one pass. For reports after a choice; a choice by it would use the rows held out."""
    names = [*base, *pool]
    rows = stored(tagged(df, [window], horizon).select(DATE, INSTRUMENT, "y", *names, "seg", "cuts", "valid"))
    sums = fold_sums(rows, names, 1)
    own = list(range(len(base)))
    sets = [own, *([*own, len(base) + i] for i in range(len(pool)))]
    fitted = [(i, fit(sums, 1, at, model, alpha)) for i, at in enumerate(sets)]
    m = trial_metrics(rows, sums, [(i, 1, *f) for i, f in fitted if f is not None], groups)
    told = df.sparkSession.createDataFrame(list(enumerate(["", *pool])), "trial int, candidate string")
    out = m.withColumn("oos_selection_score", candidates.metric_score(m, metric)).join(F.broadcast(told), "trial")  # a row per candidate
    before = F.max(F.when(F.col("trial") == 0, F.col("oos_selection_score"))).over(Window.partitionBy())
    out = out.withColumn("_before", before)
    return out.select(F.col("trial").alias("rank"), "candidate", *(x for x in m.columns if x not in ("fold", "trial")), "oos_selection_score", (F.col("oos_selection_score") - F.col("_before")).alias("delta_vs_baseline"), (F.col("oos_selection_score") > F.col("_before") + least).alias("improves_baseline"))


def forward_by_metric(df: DataFrame, base, pool: dict[str, str], windows, steps: int, metric: str = "pearson_ic_mean", model: str = "ridge", alpha: float = 1.0, penalty: float = 0.5, overlap: float = 0.0, redundancy: float = 0.0, most_corr: float = 1.0, per_family: int = 0, positive: float = 0.0, least: float = 0.0, horizon: int = 0, groups: int = 10) -> DataFrame:
    """(step, candidate, family, score, raw_score, gain, positive_ratio, max_corr): step by step the candidate of ``pool`` (name:
    families) with the best score by any metric: the mean over windows less ``penalty`` times their deviation, less ``overlap`` if
    it shares a family with one taken, less ``redundancy`` times its largest pooled correlation with those (over the last
    window's training rows). Left out: correlations over ``most_corr``, families that ``per_family`` taken ones have, candidates
    that gain more than ``least`` in fewer than the share ``positive`` of the windows. It ends when none gains over ``least``.
    Ties: the first name. Rows are read once for the sums; each step is one pass over the validation dates for all trials."""
    names = [*base, *pool]
    rows = stored(tagged(df, windows, horizon).select(DATE, INSTRUMENT, "y", *names, "seg", "cuts", "valid"))
    sums = fold_sums(rows, names, len(windows))
    g = sums.folds[len(windows)][:-1, :-1]
    cov = g[1:, 1:] / g[0, 0] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] ** 2
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.nan_to_num(np.abs(cov / np.outer(dev, dev)))
    split = lambda x: {y.strip().lower() for y in (x or "").replace("+", ",").split(",")} - {""}
    at, taken, out = list(range(len(base))), [], []
    now = _scored(rows, sums, {"": at}, len(windows), metric, model, alpha, groups)[""] if at else np.zeros(len(windows))
    score = _stable(now, penalty)
    for step in range(1, steps + 1):
        index = {c: len(base) + i for i, c in enumerate(pool)}
        near = {c: max((corr[index[c], index[t]] for t in taken), default=0.0) for c in pool}
        full = lambda c: per_family > 0 and sum(pool[t] == pool[c] for t in taken) >= per_family
        trying = {c: [*at, index[c]] for c in pool if c not in taken and (not taken or near[c] <= most_corr) and not full(c)}
        found = _scored(rows, sums, trying, len(windows), metric, model, alpha, groups) if trying else {}
        best = None
        for c, s in found.items():
            share = float(np.mean(s - now > least))
            raw = _stable(s, penalty)
            value = raw - (overlap if any(split(pool[c]) & split(pool[t]) for t in taken) else 0.0) - redundancy * near[c]
            if share >= positive and not np.isnan(value) and (best is None or value > best[0]):
                best = value, raw, c, share, s
        if best is None or best[0] - score <= least:
            break
        value, raw, c, share, now = best
        out.append((step, c, pool[c], float(value), raw, float(value - score), share, float(near[c])))
        taken.append(c)
        at.append(index[c])
        score = value
    return df.sparkSession.createDataFrame(out, "step int, candidate string, family string, score double, raw_score double, gain double, positive_ratio double, max_corr double")
