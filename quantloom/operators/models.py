"""Regressors on MLlib and boosted trees of second order: per-model fits, walk-forward validation, weights and ensembles."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT

from . import boosting, calendar, diagnostics, selection

#: Default parameters by model. Linear penalties are those of mean squared error over standardised features.
DEFAULTS = {
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 5e-4},
    "elastic_net": {"alpha": 8e-4, "l1_ratio": 0.5},
    "random_forest": {"trees": 40, "depth": 5},
    "gbt": {"trees": 20, "depth": 4, "step": 0.1},
}


def build(name: str, rows: int = 1, spread: float = 1.0, **params):
    """An estimator for (features, y). Ridge's alpha is a total over the rows. The estimator works on y over its deviation
    (``spread``) but takes the penalty as given, which weakens the squared part by that; so it is put up here."""
    p = DEFAULTS[name] | params
    if name in ("ridge", "lasso", "elastic_net"):
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic_net": p.get("l1_ratio", 0.5)}[name]
        alpha = p["alpha"] / max(rows, 1) if name == "ridge" else p["alpha"]
        absolute, squared = alpha * mix, alpha * (1 - mix) * spread
        total = absolute + squared
        return LinearRegression(featuresCol="scaled", labelCol="y", predictionCol="predicted_y", regParam=total, elasticNetParam=absolute / total if total else 0.0, standardization=False, solver="auto", maxIter=100)
    if name == "random_forest":
        return RandomForestRegressor(featuresCol="scaled", labelCol="y", predictionCol="predicted_y", numTrees=p["trees"], maxDepth=p["depth"], seed=7)
    return GBTRegressor(featuresCol="scaled", labelCol="y", predictionCol="predicted_y", maxIter=p["trees"], maxDepth=p["depth"], stepSize=p["step"], seed=7)


def fit(train: DataFrame, features, name: str, **params) -> PipelineModel | boosting.Boosted:
    """A model of y by name: one of DEFAULTS (MLlib) or of boosting.DEFAULTS, with parameters over its defaults."""
    if name in boosting.DEFAULTS:
        return boosting.fit(train, features, replace(boosting.DEFAULTS[name], **params))
    train = train.where("y is not null")
    rows, spread = train.agg(F.count("*"), F.stddev_pop("y")).first()
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), build(name, rows, spread or 1.0, **params)]).fit(train)


def predict(model: PipelineModel | boosting.Boosted, df: DataFrame) -> DataFrame:
    if isinstance(model, boosting.Boosted):
        return boosting.predict(model, df)
    return model.transform(df).drop("raw", "scaled")


def importance(model: PipelineModel | boosting.Boosted, features, weight: float = 1.0) -> DataFrame:
    """(feature, importance, share, weighted): sizes of coefficients, or the trees' importances (boosted trees: sums of gains)."""
    if isinstance(model, boosting.Boosted):
        values = [gain for gain, _ in boosting.importance(model)]
    else:
        last = model.stages[-1]
        values = [abs(float(x)) for x in (last.coefficients if hasattr(last, "coefficients") else last.featureImportances)]
    total = sum(values) or 1.0
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, v, v / total, v / total * weight) for f, v in zip(features, values, strict=True)], "feature string, importance double, share double, weighted double")


def coefficients(model: PipelineModel, features, only=None) -> list[tuple[str, float]]:
    last = model.stages[-1]
    return [(f, float(c)) for f, c in zip(features, last.coefficients, strict=True) if only is None or f in only]


def importance_summary(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("feature").agg(F.sum("weighted").alias("weighted"), F.count("*").alias("models"))


def param_grid(grid: dict[str, list], most: int | None = None) -> list[dict]:
    """All combinations of the values, at most ``most``."""
    found = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return found if most is None else found[:most]


def regression_metrics(df: DataFrame, by=()) -> DataFrame:
    e = F.col("predicted_y") - F.col("y")
    agg = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("rows")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def model_weights(scores: DataFrame, score: str = "score") -> DataFrame:
    """(model, weight): half equal, half in proportion to positive scores; all equal if none is positive and finite."""
    all_ = Window.partitionBy()
    good = F.when((F.col(score) > 0) & (F.col(score) < float("inf")), F.col(score)).otherwise(0.0)
    n, total = F.count(F.lit(1)).over(all_), F.sum(good).over(all_)
    return scores.select("model", F.when(total > 0, 0.5 * good / F.when(total > 0, total) + 0.5 / n).otherwise(1.0 / n).alias("weight"))


def finalize_weights(weights: DataFrame) -> DataFrame:
    """Weights of the models that are there, summing to one."""
    return weights.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def ensemble(predictions: DataFrame, weights: DataFrame, keys=(DATE, INSTRUMENT, "y")) -> DataFrame:
    """Weighted means of (keys, model, predicted_y); weights that are not positive are ignored, all of them: equal ones."""
    w = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(0.0)
    rows = predictions.join(F.broadcast(weights), "model").withColumn("_w", w)  # a row per model
    sw = F.sum("_w")
    return rows.groupBy(*keys).agg(F.when(sw > 0, F.sum(F.col("_w") * F.col("predicted_y")) / F.when(sw > 0, sw)).otherwise(F.avg("predicted_y")).alias("predicted_y"))


def walk_forward(df: DataFrame, features, models: dict[str, list[dict]], folds: int = 3, horizon: int = 1, top: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fold scores, best parameters per model, model weights). Each fold: selection on its purged training rows, a fit of
    each candidate, its mean daily coefficient on the fold's validation dates. Folds and candidates are few; each step
    inside is a Spark job."""
    walk = calendar.walk_forward(df, folds, horizon).where("y is not null").persist()
    rows = []
    for fold in range(1, folds + 1):
        train = walk.where((F.col("fold") == fold) & (F.col("part") == "train"))
        valid = walk.where((F.col("fold") == fold) & (F.col("part") == "valid"))
        chosen = selection.fit(train, features, top=top)
        if not chosen.features:
            continue
        a = selection.transform(train, chosen, (DATE, INSTRUMENT, "y"))
        b = selection.transform(valid, chosen, (DATE, INSTRUMENT, "y"))
        for name, candidates in models.items():
            for k, params in enumerate(candidates):
                scored = predict(fit(a, chosen.features, name, **params), b)
                mean = diagnostics.daily_ic(scored).agg(F.avg("ic"), F.avg("rank_ic")).first()
                err = regression_metrics(scored).first()
                rows.append((fold, name, k, str(params), mean[0], mean[1], err.rmse, err.mae, len(chosen.features)))
    walk.unpersist()
    spark = df.sparkSession
    found = spark.createDataFrame(rows, "fold int, model string, candidate int, params string, ic double, rank_ic double, rmse double, mae double, n_features int")
    mean = found.groupBy("model", "candidate", "params").agg(F.avg("ic").alias("score"), F.avg("rank_ic").alias("rank_ic"), F.avg("rmse").alias("rmse"))
    best = mean.withColumn("_k", F.row_number().over(Window.partitionBy("model").orderBy(F.desc_nulls_last("score"), "candidate"))).where("_k = 1").drop("_k")
    return found, best, model_weights(best)


def crossfit_residuals(df: DataFrame, features, name: str = "ridge", blocks: int = 4) -> DataFrame:
    """y - prediction of every block but the first, predicted from the blocks before it."""
    tagged = df.join(F.broadcast(calendar.date_blocks(df, blocks)), DATE).where("y is not null")
    out = None
    for b in range(2, blocks + 1):
        model = fit(tagged.where(F.col("block") < b), features, name)
        one = predict(model, tagged.where(F.col("block") == b)).withColumn("residual", F.col("y") - F.col("predicted_y"))
        out = one if out is None else out.unionByName(one)
    return out


def as_columns(df: DataFrame, vector: str, names) -> DataFrame:
    return df.withColumn("_a", vector_to_array(vector)).select("*", *(F.col("_a")[i].alias(n) for i, n in enumerate(names))).drop("_a")
