"""Data-quality audits: corporate actions, coverage, panel profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, INSTRUMENT


def corporate_actions(df: DataFrame, least: float = 1e-6, jump: float = 0.2) -> DataFrame:
    """Events where the adjustment changes: raw and adjusted closes and returns, and what to look at first.

    adjusted_only_jump: the adjusted return is large though the raw one is not; raw_jump_explained: the other way round."""
    raw, adj = F.col("close"), F.col("close") * F.col("adjustment")
    rows = df.select(INSTRUMENT, DATE, raw.alias("raw_close"), adj.alias("adjusted_close"), "adjustment", C.delay(F.col("adjustment")).alias("_a"), C.delay(raw).alias("_r"), C.delay(adj).alias("_d"))
    change = C.safe_divide(F.col("adjustment") - F.col("_a"), F.abs("_a"))
    rows = rows.withColumns({"adjustment_change": change, "raw_return": C.safe_divide(F.col("raw_close"), F.col("_r")) - 1, "adjusted_return": C.safe_divide(F.col("adjusted_close"), F.col("_d")) - 1}).where(F.abs("adjustment_change") > least)
    big = lambda x: F.abs(F.col(x)) > jump
    flag = F.when(big("adjusted_return") & ~big("raw_return"), "adjusted_only_jump").when(big("raw_return") & ~big("adjusted_return"), "raw_jump_explained").when(big("raw_return"), "both_jump").otherwise("quiet")
    rows = rows.withColumn("flag", flag)
    return rows.withColumn("priority", F.when(F.col("flag") == "adjusted_only_jump", 1).when(F.col("flag") == "both_jump", 2).otherwise(3)).drop("_a", "_r", "_d")


def corporate_action_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("flag").agg(F.count("*").alias("events"), F.countDistinct(INSTRUMENT).alias("instruments"), F.max(F.abs("adjustment_change")).alias("largest_change"))


def coverage(df: DataFrame, gap: int = 20, least: int = 252, share: float = 0.8) -> DataFrame:
    """By instrument: first and last date, rows, share of the calendar dates between, and why to review it."""
    days = df.select(DATE).distinct().withColumn("t", F.row_number().over(Window.orderBy(DATE)))
    n = days.agg(F.max("t").alias("_n"))
    own = df.join(F.broadcast(days), DATE).groupBy(INSTRUMENT).agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count("*").alias("observations"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    own = own.join(F.broadcast(n)).withColumns({"coverage": F.col("observations") / F.col("_n"), "late": F.col("_a") - 1, "early": F.col("_n") - F.col("_b")})
    reasons = F.array_compact(F.array(F.when(F.col("late") >= gap, "late_start"), F.when(F.col("early") >= gap, "early_end"), F.when(F.col("observations") < least, "short_history"), F.when(F.col("coverage") < share, "low_coverage")))
    return own.withColumns({"reasons": F.array_join(reasons, ";"), "review": F.size(reasons) > 0}).drop("_a", "_b", "_n")


def profile(df: DataFrame, extreme: float = 0.5) -> DataFrame:
    """One row: duplicates, missing shares, price-order violations, stale closes, extreme returns, turnover that is not
    price times volume, unknown sectors, history lengths."""
    r = C.safe_divide(F.col("close"), C.delay(F.col("close"))) - 1
    rows = df.withColumns({"_r": r, "_stale": (C.delay(F.col("close")) == F.col("close")) & (F.col("volume") > 0)})
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    order = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    off = F.abs(F.col("turnover") - F.col("vwap") * F.col("volume")) > 1e-8 * F.abs("turnover")
    one = rows.agg(F.count("*").alias("rows"), F.countDistinct(INSTRUMENT).alias("instruments"), F.countDistinct(DATE).alias("dates"), *(F.avg(F.col(x).isNull().cast("double")).alias(f"missing_{x}") for x in ("open", "close", "volume", "market_cap")), yes(order).alias("order_violations"), yes(F.col("_stale")).alias("stale_closes"), yes(F.abs("_r") > extreme).alias("extreme_returns"), yes(off).alias("turnover_mismatches"), F.avg((F.coalesce("sector", F.lit("Unknown")) == "Unknown").cast("double")).alias("unknown_sector"))
    own = df.groupBy(INSTRUMENT).agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(DATE)).alias("d")).agg(F.sum("d").alias("duplicate_rows"), F.min("n").alias("shortest_history"), F.percentile("n", 0.5).alias("median_history"), F.max("n").alias("longest_history"))
    return one.join(F.broadcast(own))


def column_coverage(df: DataFrame, columns) -> DataFrame:
    """(column, values, share) of non-null values."""
    row = df.agg(F.count("*").alias("_n"), *(F.count(x).alias(x) for x in columns))
    return row.select("_n", F.explode(F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).alias("values")) for x in columns))).alias("r")).select("r.column", "r.values", (F.col("r.values") / F.col("_n")).alias("share"))
