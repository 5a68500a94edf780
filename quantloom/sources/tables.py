"""Small readers and merges of research tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT
from quantloom.operators import calendar, joins


def instruments(panel: DataFrame) -> DataFrame:
    return panel.select(INSTRUMENT).where(F.col(INSTRUMENT).isNotNull()).distinct()


def selected_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges whose (source, target) is among the pairs."""
    return edges.join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi")


def candidate_pool(runs: dict[str, DataFrame], doubles=(), flags=()) -> DataFrame:
    """Candidate tables of several runs as one, with run; columns that one lacks are null, numbers and
    flags are coerced, missing flags are false."""
    out = None
    for name, df in runs.items():
        one = df.withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out = out.withColumns({x: F.expr(f"try_cast(`{x}` AS DOUBLE)") for x in doubles})
    return out.withColumns({x: F.coalesce(F.lower(F.col(x).cast("string")).isin("true", "1", "yes", "y"), F.lit(False)) for x in flags})


def prepared(panel: DataFrame, start, end, horizon: int) -> DataFrame:
    """The rows of a range of dates with the horizon's label as y and unknown sectors named so. Labels are made before
    the range is cut."""
    rows = calendar.activate(calendar.add_forward_returns(panel, [horizon]), horizon)
    return calendar.between(rows, start, end).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def with_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions with y of the same key, null where there is none; of repeated keys of actuals the largest y counts, so
    rows never multiply."""
    y = actuals.groupBy(DATE, INSTRUMENT).agg(F.max("y").alias("y"))
    return predictions.drop("y").join(y, [DATE, INSTRUMENT], "left")


def closes(prices: DataFrame, scales: dict[str, float]) -> DataFrame:
    """(date, ticker, close): numeric closes times the ticker's scale, 1 by default; those that are no numbers go."""
    scale = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in scales.items() for x in kv)), F.col("ticker")), F.lit(1.0)) if scales else F.lit(1.0)
    return prices.select(DATE, "ticker", (F.expr("try_cast(close AS DOUBLE)") * scale).alias("close")).where("close is not null")


def merge_fundamentals_files(spark: SparkSession, panel_path: str, events_path: str, out_path: str, values) -> None:
    """Reads both tables, joins the values as of each date and writes the result."""
    joins.as_of(spark.read.parquet(panel_path), spark.read.parquet(events_path), values).write.parquet(out_path)


def feature_source(features: DataFrame, scores: DataFrame, top: int | None = None) -> DataFrame:
    """(feature, score): the listed features with their scores, each once, the best ``top``."""
    best = scores.groupBy("feature").agg(F.max("score").alias("score"))
    rows = features.select("feature").distinct().join(best, "feature", "left")
    if top is None:
        return rows
    return rows.withColumn("_k", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "feature"))).where(F.col("_k") <= top).drop("_k")  # a row per feature
