"""Experiment tables: views, deltas against baselines, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def views(df: DataFrame, keys, metrics, positive: str = "total_return") -> DataFrame:
    """By keys: mean and least value of each metric, number of windows, share of windows with a positive ``positive``."""
    agg = [f(x).alias(f"{k}_{x}") for x in metrics for k, f in (("avg", F.avg), ("min", F.min))]
    return df.groupBy(*keys).agg(*agg, F.count("*").alias("windows"), F.sum((F.col(positive) > 0).cast("long")).alias("positive_windows"), F.avg((F.col(positive) > 0).cast("double")).alias("positive_share"))


def deltas(df: DataFrame, keys, metrics, column: str, baseline) -> DataFrame:
    """Each row's metrics minus those of the row of the same keys whose ``column`` is the baseline (a value, or a column
    that names it). The baseline's own rows are left out."""
    name = F.col(baseline[1]) if isinstance(baseline, tuple) else F.lit(baseline)
    base = df.select(*keys, F.col(column).alias("_b"), *(F.col(x).alias(f"_{x}") for x in metrics))
    left = df.withColumn("_b", name).where(F.col(column) != F.col("_b"))
    return left.join(base, [*keys, "_b"]).select(*keys, column, *((F.col(x) - F.col(f"_{x}")).alias(f"delta_{x}") for x in metrics))


def interaction(df: DataFrame, keys, metric: str, first: tuple, second: tuple) -> DataFrame:
    """Difference of differences: (column, value, baseline) twice."""
    (a, a1, a0), (b, b1, b0) = first, second
    at = lambda x, y: F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col(metric)))
    return df.groupBy(*keys).agg(((at(a1, b1) - at(a0, b1)) - (at(a1, b0) - at(a0, b0))).alias("interaction"))


def verdicts(delta: DataFrame, by, core, least_core: int = 2, least_windows: int = 2, least_share: float = 0.5) -> DataFrame:
    """By experiment: how many core mean deltas are positive, in how many windows the first one is, and whether both suffice."""
    agg = delta.groupBy(*by).agg(*(F.avg(x).alias(x) for x in core), F.count("*").alias("windows"), F.sum((F.col(core[0]) > 0).cast("long")).alias("positive_windows"))
    good = sum((F.when(F.col(x) > 0, 1).otherwise(0) for x in core), F.lit(0))
    return agg.withColumn("positive_core", good).withColumn("accepted", (good >= least_core) & (F.col("positive_windows") >= least_windows) & (F.col("positive_windows") / F.col("windows") >= least_share))


def acceptance(df: DataFrame, checks: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(experiment, check, value, passed) of threshold checks {name: (column, '>' or '<', limit)}."""
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(c).cast("double").alias("value"), (F.col(c) > x if op == ">" else F.col(c) < x).alias("passed")) for n, (c, op, x) in checks.items()))
    return df.select("experiment", F.explode(rows).alias("r")).select("experiment", "r.*")


def acceptance_ranking(checks: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    out = checks.groupBy("experiment").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("checks"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("passed"), "experiment")))


def funnel(counts: DataFrame, stages) -> DataFrame:
    """(stage, n) from a row of counts."""
    return counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("n")) for s in stages))).alias("r")).select("r.*")


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("family").agg(F.count("*").alias("n"))


def monthly(df: DataFrame, keys, metric: str) -> DataFrame:
    return df.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.avg(metric).alias(metric), F.count("*").alias("n_dates"))
