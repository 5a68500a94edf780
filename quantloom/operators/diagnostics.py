"""Prediction and factor diagnostics: information coefficients, quantile groups, turnover, correlation, decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, INSTRUMENT, correlation


def long_form(df: DataFrame, factors, keep=(DATE, INSTRUMENT)) -> DataFrame:
    """(keep..., factor, value): all factors in one pass."""
    return df.unpivot([*keep], list(factors), "factor", "value")


def avg_rank(x, *by):
    """Average rank among the non-null values of the columns ``by``, as a window."""
    w = Window.partitionBy(*by)
    n = F.count(x).over(w)
    low = F.rank().over(w.orderBy(x)) - (F.count(F.lit(1)).over(w) - n)
    up = F.count(x).over(w.orderBy(x).rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (low + up) / 2)


def daily_ic(df: DataFrame, signal: str = "predicted_y", target: str = "y", by=(), least: int = 2) -> DataFrame:
    """(by..., date, ic, rank_ic, n): Pearson and Spearman correlations on the complete pairs of each date."""
    keys = [*by, DATE]
    pairs = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    pairs = pairs.withColumns({"_rs": avg_rank(F.col(signal), *keys), "_rt": avg_rank(F.col(target), *keys)})
    return pairs.groupBy(*keys).agg(correlation(F.col(signal), F.col(target), least=least).alias("ic"), correlation(F.col("_rs"), F.col("_rt"), least=least).alias("rank_ic"), F.count("*").alias("n"))


def summarize_ic(ic: DataFrame, column: str = "ic", by=(), ddof: int = 1) -> DataFrame:
    """mean, median, std, icir, positive share and number of dates."""
    x = F.col(column)
    std = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    agg = [F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), std.alias("std"), (F.avg(x) / F.when(std > 1e-12, std)).alias("icir"), F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("positive_ratio"), F.count(x).alias("n_dates")]
    return ic.groupBy(*by).agg(*agg) if by else ic.agg(*agg)


def quantile_group(x, groups: int, *keys):
    """ceil(rank / n * groups) within the keys; ties in instrument order."""
    w = Window.partitionBy(*keys, x.isNotNull())
    n = F.count(x).over(w)
    g = F.ceil(F.row_number().over(w.orderBy(x, F.col(INSTRUMENT))) / n * groups)
    return F.when(x.isNotNull(), F.least(F.greatest(g, F.lit(1)), F.lit(groups)).cast("int"))


def safe_quantile_group(x, groups: int, *keys):
    """Null where there are fewer values than groups or all are equal."""
    w = Window.partitionBy(*keys)
    return F.when((F.count(x).over(w) >= groups) & (F.max(x).over(w) > F.min(x).over(w)), quantile_group(x, groups, *keys))


def group_returns(df: DataFrame, groups: int = 10, signal: str = "predicted_y", target: str = "y", by=(), safe: bool = False) -> DataFrame:
    """(by..., group, avg_return, n_dates): the target's mean in each date and group, then over the dates."""
    keys, cut = [*by, DATE], safe_quantile_group if safe else quantile_group
    pairs = df.where(F.col(signal).isNotNull() & F.col(target).isNotNull()).withColumn("group", cut(F.col(signal), groups, *keys))
    day = pairs.where("group is not null").groupBy(*keys, "group").agg(F.avg(target).alias("r"))
    return day.groupBy(*by, "group").agg(F.avg("r").alias("avg_return"), F.count("*").alias("n_dates"))


def spread(returns: DataFrame, by=()) -> DataFrame:
    """(by..., top, bottom, spread, monotonicity): the last group against the first; the rank correlation of group and return."""
    ranked = returns.withColumn("_r", avg_rank(F.col("avg_return"), *by))
    return ranked.groupBy(*by).agg(F.max_by("avg_return", "group").alias("top"), F.min_by("avg_return", "group").alias("bottom"), (F.max_by("avg_return", "group") - F.min_by("avg_return", "group")).alias("spread"), correlation(F.col("group").cast("double"), F.col("_r")).alias("monotonicity"))


def prediction_metrics(df: DataFrame, groups: int = 10) -> DataFrame:
    """One row: pooled correlation, errors, summaries of both coefficients, spread, monotonicity, coverage."""
    e = F.col("predicted_y") - F.col("y")
    pooled = df.agg(correlation(F.col("predicted_y"), F.col("y")).alias("pooled_corr"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("rows"), F.countDistinct(DATE).alias("dates"), F.countDistinct(INSTRUMENT).alias("instruments"), F.avg(F.when(e.isNotNull(), 1.0).otherwise(0.0)).alias("coverage"))
    ic = daily_ic(df)
    parts = [pooled]
    for name in ("ic", "rank_ic"):
        s = summarize_ic(ic, name)
        parts.append(s.select(*(F.col(x).alias(f"{name}_{x}") for x in s.columns)))
    parts.append(spread(group_returns(df, groups)).select(F.col("spread").alias("top_bottom_spread"), "monotonicity"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


def factor_ic(df: DataFrame, factors, target: str = "y", least: int = 2) -> DataFrame:
    """(factor, date, ic, rank_ic, n) of all factors in one pass."""
    return daily_ic(long_form(df, factors, (DATE, INSTRUMENT, target)), "value", target, ("factor",), least)


def horizon_ic(df: DataFrame, factors, horizons=(1, 5, 10)) -> DataFrame:
    """(factor, horizon, date, ic, rank_ic, n). Ranks are taken before pairs are formed here."""
    rows = long_form(df, factors, (DATE, INSTRUMENT, *(f"y_{n}d" for n in horizons)))
    rows = rows.withColumn("_r", avg_rank(F.col("value"), "factor", DATE))
    rows = rows.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("horizon"), F.col(f"y_{n}d").alias("y")) for n in horizons))).alias("_h")).select("factor", DATE, INSTRUMENT, "value", "_r", "_h.horizon", "_h.y")
    rows = rows.withColumn("_ry", avg_rank(F.col("y"), "factor", "horizon", DATE))
    return rows.groupBy("factor", "horizon", DATE).agg(correlation(F.col("value"), F.col("y")).alias("ic"), correlation(F.col("_r"), F.col("_ry")).alias("rank_ic"), F.count(F.when(F.col("value").isNotNull(), F.col("y"))).alias("n"))


def horizon_match(summary: DataFrame) -> DataFrame:
    """(factor, best_horizon, best_ic) by the size of the mean coefficient; ties: the shorter horizon."""
    best = F.struct(F.abs("mean"), -F.col("horizon"))
    return summary.groupBy("factor").agg(F.max_by("horizon", best).alias("best_horizon"), F.max_by("mean", best).alias("best_ic"))


def turnover(df: DataFrame, factors, top: float = 0.2, least: int = 2) -> DataFrame:
    """(factor, rank_turnover, retention, transitions): from each eligible date to the next one, the mean change of
    percentile rank of the names on both, and the share of the top names that stays on top."""
    rows = long_form(df, factors).where("value is not null")
    days = rows.groupBy("factor", DATE).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    days = days.withColumn("_k", F.row_number().over(Window.partitionBy("factor").orderBy(DATE)))  # a row per factor and date
    rows = rows.join(F.broadcast(days), ["factor", DATE])
    rows = rows.withColumns({"_p": avg_rank(F.col("value"), "factor", DATE) / F.col("_n"), "_place": F.row_number().over(Window.partitionBy("factor", DATE).orderBy(F.desc("value"), INSTRUMENT))})
    rows = rows.withColumn("_top", F.col("_place") <= F.ceil(F.col("_n") * top)).select("factor", INSTRUMENT, "_k", "_p", "_top")
    old = rows.select("factor", INSTRUMENT, (F.col("_k") + 1).alias("_k"), F.col("_p").alias("_q"), F.col("_top").alias("_was"))
    both = rows.join(old, ["factor", INSTRUMENT, "_k"])
    step = both.groupBy("factor", "_k").agg(F.avg(F.abs(F.col("_p") - F.col("_q"))).alias("change"), F.sum((F.col("_top") & F.col("_was")).cast("double")).alias("stay"), F.count("*").alias("common"))
    tops = old.groupBy("factor", "_k").agg(F.sum(F.col("_was").cast("double")).alias("were"))
    step = step.join(tops, ["factor", "_k"]).where(F.col("common") >= max(2, least // 2))
    return step.groupBy("factor").agg(F.avg("change").alias("rank_turnover"), F.avg(F.col("stay") / F.when(F.col("were") > 0, F.col("were"))).alias("retention"), F.count("*").alias("transitions"))


def row_turnover(df: DataFrame, factors) -> DataFrame:
    """(factor, rank_turnover): over each instrument's following rows, missing dates or not."""
    rows = long_form(df, factors).withColumn("_p", avg_rank(F.col("value"), "factor", DATE) / F.count("value").over(Window.partitionBy("factor", DATE)))
    before = F.lag("_p").over(Window.partitionBy("factor", INSTRUMENT).orderBy(DATE))
    return rows.withColumn("_d", F.abs(F.col("_p") - before)).groupBy("factor").agg(F.avg("_d").alias("rank_turnover"))


def factor_correlation(df: DataFrame, factors) -> DataFrame:
    """(a, b, corr) of all pairs a < b of per-date z-scores, pooled over all rows: sums of products, no sampling."""
    from .preprocess import zscore

    z = df.select(*(zscore(F.col(x)).alias(x) for x in factors))
    pairs = [(x, y) for i, x in enumerate(factors) for y in factors[i + 1 :]]
    row = z.agg(*(correlation(F.col(x), F.col(y)).alias(f"c{k}") for k, (x, y) in enumerate(pairs)))
    named = F.explode(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{k}").alias("corr")) for k, (x, y) in enumerate(pairs))))
    return row.select(named.alias("p")).select("p.*")


def clusters(pairs: DataFrame, scores: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(factor, cluster, representative): greedy from the best score on; a factor joins the first representative that it
    correlates with. The tables have a row per factor and pair of factors, so the walk is on the driver."""
    close = {(r.a, r.b) for r in pairs.where(F.abs("corr") >= threshold).collect()}
    out, leaders = [], []
    for r in scores.orderBy(F.desc(F.abs("score")), "factor").collect():
        lead = next((x for x in leaders if (x, r.factor) in close or (r.factor, x) in close), None)
        if lead is None:
            leaders.append(lead := r.factor)
        out.append((r.factor, leaders.index(lead) + 1, lead))
    return pairs.sparkSession.createDataFrame(out, "factor string, cluster int, representative string")


def decay_table(ic: DataFrame, every: str = "year", by=("factor",)) -> DataFrame:
    """(by..., period, mean, median, std, n) of the coefficients by year or quarter."""
    return ic.groupBy(*by, F.trunc(DATE, every).alias("period")).agg(F.avg("ic").alias("mean"), F.percentile("ic", 0.5).alias("median"), F.stddev_samp("ic").alias("std"), F.count("ic").alias("n"))


def long_short_by_date(df: DataFrame, fraction: float = 0.2, signal: str = "predicted_y", by=()) -> DataFrame:
    """(by..., date, top, bottom, spread): mean target of the floor(fraction * n) highest and lowest."""
    keys = [*by, DATE]
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(signal).isNotNull() & F.col("y").isNotNull())
    k = F.floor(F.count("*").over(w) * fraction)
    up, down = F.row_number().over(w.orderBy(F.desc(signal), INSTRUMENT)), F.row_number().over(w.orderBy(signal, INSTRUMENT))
    rows = rows.withColumns({"_k": k, "_u": up, "_d": down})
    out = rows.groupBy(*keys).agg(F.avg(F.when(F.col("_u") <= F.col("_k"), F.col("y"))).alias("top"), F.avg(F.when(F.col("_d") <= F.col("_k"), F.col("y"))).alias("bottom"))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def spread_summary(days: DataFrame, step: int = 5) -> DataFrame:
    """One row: mean and Sharpe ratio of all spreads, and of every step-th one with its compounded return."""
    t = days.withColumn("_t", F.row_number().over(Window.orderBy(DATE)) - 1)
    own = F.when(F.col("_t") % step == 0, F.col("spread"))
    ratio = lambda x, k: F.avg(x) / F.when(F.stddev_samp(x) > 1e-12, F.stddev_samp(x)) * F.sqrt(F.lit(float(k)))
    return t.agg(F.avg("spread").alias("mean"), ratio(F.col("spread"), 252).alias("sharpe"), F.avg(own).alias("mean_apart"), ratio(own, 252 / step).alias("sharpe_apart"), (F.product(F.when(own.isNotNull(), 1 + own)) - 1).alias("compounded"))


def book_turnover(df: DataFrame, fraction: float = 0.2, signal: str = "predicted_y") -> DataFrame:
    """(date, turnover): gross weight that changes from one date to the next in the equal-weight long/short book."""
    w = Window.partitionBy(DATE)
    rows = df.where(F.col(signal).isNotNull())
    days = rows.select(DATE).distinct().withColumn("_t", F.row_number().over(Window.orderBy(DATE)))  # a row per date
    rows = rows.withColumns({"_k": F.floor(F.count("*").over(w) * fraction), "_u": F.row_number().over(w.orderBy(F.desc(signal), INSTRUMENT)), "_d": F.row_number().over(w.orderBy(signal, INSTRUMENT))})
    book = rows.where((F.col("_u") <= F.col("_k")) | (F.col("_d") <= F.col("_k"))).join(F.broadcast(days), DATE).select("_t", INSTRUMENT, (F.when(F.col("_u") <= F.col("_k"), 1.0).otherwise(-1.0) / F.col("_k")).alias("w"))
    old = book.select((F.col("_t") + 1).alias("_t"), INSTRUMENT, F.col("w").alias("v"))
    step = book.join(old, ["_t", INSTRUMENT], "full").groupBy("_t").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))).alias("turnover"))
    return days.where("_t > 1").join(step, "_t").select(DATE, "turnover")


def cost_adjusted(spread, retention, bps: float = 20.0):
    return spread - 2 * (1 - retention) * bps / 1e4


def oriented(value, direction):
    """The value turned round where the direction is negative."""
    return F.when(direction < 0, -value).otherwise(value)


def bounded_retention(candidate, baseline):
    """candidate / baseline within +-2; null near a baseline of nothing."""
    ratio = C.safe_divide(candidate, baseline)
    return F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(-2.0)), F.lit(2.0)))


def factor_summary(df: DataFrame, factors, target: str = "y", groups: int = 5, least: int = 5) -> DataFrame:
    """One row per factor: coverage, both coefficients' summaries, spread, monotonicity, turnover."""
    rows = long_form(df, factors, (DATE, INSTRUMENT, target))
    ic = daily_ic(rows, "value", target, ("factor",), least)
    out = rows.groupBy("factor").agg(F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    for name in ("ic", "rank_ic"):
        s = summarize_ic(ic, name, ("factor",), ddof=0)
        out = out.join(s.select("factor", *(F.col(x).alias(f"{name}_{x}") for x in s.columns[1:])), "factor", "left")
    ret = spread(group_returns(rows, groups, "value", target, ("factor",), safe=True), ("factor",))
    return out.join(ret.select("factor", "spread", "monotonicity"), "factor", "left").join(turnover(df, factors, least=least), "factor", "left")


def top_k(df: DataFrame, column: str, k: int, by=(), ties=INSTRUMENT) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(column), ties))).where(F.col("_k") <= k).drop("_k")


def unit_rank(x):
    """Percentile rank over the whole table, nulls one half, and all if there is one value at most; a row per candidate."""
    w = Window.partitionBy()
    n = F.count(x).over(w)
    low = F.rank().over(w.orderBy(x)) - (F.count(F.lit(1)).over(w) - n)
    up = F.count(x).over(w.orderBy(x).rangeBetween(Window.unboundedPreceding, 0))
    return F.coalesce(F.when(x.isNotNull() & (n > 1), (low + up) / (2 * n)), F.lit(0.5))


