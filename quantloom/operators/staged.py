"""Scores of candidates in stages: a cheap measure of the whole pool, the dear ones for a shortlist alone, whose rows are read once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT, correlation
from quantloom.functions.tables import stored

from . import calendar, diagnostics
from .alpha_scores import tradability


def pool_scores(df: DataFrame, candidates, target: str = "y", least: int = 5) -> DataFrame:
    """(candidate_id, pool_ic) of all candidates from sums of products by date: one aggregation of the rows as they are, without
    ranks, groups or a row per candidate. Columns that are absent have none."""
    there = [x for x in candidates if x in df.columns]
    if not there:
        return df.sparkSession.createDataFrame([], "candidate_id string, pool_ic double")
    y = F.col(target)
    day = df.where(y.isNotNull()).groupBy(DATE).agg(*(correlation(F.col(x), y, least=least).alias(x) for x in there))
    one = day.agg(*(F.avg(x).alias(x) for x in there))
    return one.unpivot([], there, "candidate_id", "pool_ic")


def shortlist(pool: DataFrame, size: int, score: str = "pool_ic") -> DataFrame:
    """``pool`` with place (by size of the score, to nine digits; ties by id) and status: ok for the first ``size``, not_shortlisted
    for others."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round(F.abs(score), 9)), "candidate_id"))  # a row per candidate
    return pool.withColumn("place", place).withColumn("status", F.when(F.col(score).isNull(), "empty_metrics").when(F.col("place") <= size, "ok").otherwise("not_shortlisted"))


def staged_scores(df: DataFrame, candidates, size: int, target: str = "y", baseline: str = "predicted_y", groups: int = 5, top: float = 0.2, bps: float = 20.0, least: int = 5) -> DataFrame:
    """A row per candidate: candidate_id, place, status, pool_ic (on the first half of the dates); and for the ``size`` best by its
    size, turned by its sign: oos_ic on the second half, and on either half (train_, oos_) rank turnover, retention of the top
    names and the spread less what their change costs at ``bps``, and the correlation with the baseline's predictions on the
    second half.

    status: ok, not_shortlisted, empty_metrics (no date has ``least`` pairs), missing_signal (no such column). ``df`` is read twice,
    whatever the size of the pool: once for the pool's sums, once for the shortlist."""
    halves = calendar.halves(df)
    pool = stored(shortlist(pool_scores(halves.where("half = 1"), candidates, target, least), size))
    chosen = [(r.candidate_id, -1 if r.pool_ic < 0 else 1) for r in pool.where("status = 'ok'").collect()]  # ``size`` rows
    missing = [(x, None, "missing_signal", None) for x in candidates if x not in df.columns]
    all_ = pool.select("candidate_id", "place", "status", "pool_ic").unionByName(df.sparkSession.createDataFrame(missing, "candidate_id string, place int, status string, pool_ic double"))
    names = ["oos_ic", *(f"{p}_{x}" for p in ("train", "oos") for x in ("rank_turnover", "retention", "net_spread")), "oos_baseline_corr"]
    if not chosen:
        return all_.select("*", *(F.lit(None).cast("double").alias(x) for x in names))
    wide = halves.select(DATE, INSTRUMENT, "half", target, baseline, *((sign * F.col(x)).cast("double").alias(x) for x, sign in chosen))
    rows = stored(wide.unpivot([DATE, INSTRUMENT, "half", target, baseline], [x for x, _ in chosen], "factor", "value"))
    late = diagnostics.daily_ic(rows.where("half = 2"), "value", target, ("factor",), least).groupBy(F.col("factor").alias("candidate_id")).agg(F.avg("ic").alias("oos_ic"))
    near = rows.where("half = 2").groupBy(F.col("factor").alias("candidate_id")).agg(correlation(F.col("value"), F.col(baseline)).alias("oos_baseline_corr"))
    by_half = rows.withColumn("factor", F.concat_ws("|", F.col("half").cast("string"), "factor"))
    turn = tradability(by_half, top)
    ends = diagnostics.spread(diagnostics.group_returns(by_half, groups, "value", target, ("factor",)), ("factor",)).select(F.col("factor").alias("candidate_id"), "spread")
    both = turn.join(ends, "candidate_id", "left").withColumn("net_spread", diagnostics.cost_adjusted(F.col("spread"), F.col("retention"), bps))
    both = both.select(F.substring_index("candidate_id", "|", 1).alias("half"), F.expr("substr(candidate_id, 3)").alias("candidate_id"), "rank_turnover", "retention", "net_spread")
    pick = [F.max(F.when(F.col("half") == h, F.col(x))).alias(f"{p}_{x}") for h, p in (("1", "train"), ("2", "oos")) for x in ("rank_turnover", "retention", "net_spread")]
    parts = [late, both.groupBy("candidate_id").agg(*pick), near]
    return reduce(lambda a, b: a.join(b, "candidate_id", "left"), parts, all_).select(*all_.columns, *names)
