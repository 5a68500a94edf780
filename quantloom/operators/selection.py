"""Feature selection: missing share, variance, redundancy, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, correlation
from quantloom.functions.tables import stored

from .preprocess import impute, medians


@dataclass
class Selected:
    features: list[str]
    scores: DataFrame
    train: DataFrame


def profile(train: DataFrame, features) -> DataFrame:
    """(feature, missing, variance): the share of nulls, and the variance of the median-filled values over the square of
    their largest size, so that it neither overflows nor depends on the unit."""
    clean = train.select(*(C.finite(F.expr(f"try_cast(`{x}` AS DOUBLE)")).alias(x) for x in features))
    fill = medians(clean, features).select(*(F.col(x).alias(f"_m_{x}") for x in features))
    most = clean.agg(*(F.max(F.abs(x)).alias(f"_a_{x}") for x in features))
    rows = clean.join(F.broadcast(fill)).join(F.broadcast(most))
    agg = []
    for x in features:
        value = F.coalesce(F.col(x), F.col(f"_m_{x}")) / F.when(F.col(f"_a_{x}") > 0, F.col(f"_a_{x}")).otherwise(1.0)
        agg += [F.avg(F.col(x).isNull().cast("double")).alias(f"_n_{x}"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias(f"_v_{x}"), F.max(f"_a_{x}").alias(f"_s_{x}")]
    one = rows.agg(*agg)
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(f"_n_{x}").alias("missing"), F.col(f"_v_{x}").alias("scaled_variance"), F.coalesce(F.col(f"_s_{x}"), F.lit(0.0)).alias("largest")) for x in features))).alias("r")).select("r.*")


def pair_correlations(df: DataFrame, features) -> DataFrame:
    """(i, j, a, b, corr) of all pairs a before b, from one pass over the rows; the matrix has a row per feature. Pairs
    with a constant feature have none."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = []
    if len(features) > 1 and not df.isEmpty():
        vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df).select("_v")
        m = Correlation.corr(vectors, "_v").first()[0].toArray()
        rows = [(i, j, features[i], features[j], float(m[i, j])) for j in range(len(features)) for i in range(j) if m[i, j] == m[i, j]]
    return df.sparkSession.createDataFrame(rows, "i int, j int, a string, b string, corr double")


def scores(df: DataFrame, features, target: str = "y") -> DataFrame:
    """(feature, score): size of the mean daily correlation with the target."""
    features, y = list(features), F.col(target)
    day = df.groupBy(DATE).agg(*(F.struct(correlation(F.col(x), y).alias("ic"), F.count(F.when(y.isNotNull(), F.col(x))).alias("n")).alias(x) for x in features))
    ic = day.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), F.col(x).alias("v")) for x in features))).alias("r")).where("r.v.n > 0")
    return ic.groupBy("r.feature").agg(F.coalesce(F.abs(F.avg("r.v.ic")), F.lit(0.0)).alias("score"))


def table(train: DataFrame, features, target: str = "y", missing: float = 0.6, variance: float = 1e-12, corr: float = 0.95, top: int | None = None) -> DataFrame:
    """(feature, position, missing, scaled_variance, redundant_with, score, kept) of all features.

    Too many nulls or no variance: out. Of the rest, a feature goes if it correlates by more than ``corr`` with one
    before it, even one that goes itself; the best ``top`` scores stay, ties in feature order."""
    from pyspark.sql import Window

    features = list(features)
    train = stored(train.select(DATE, C.INSTRUMENT, target, *features))
    order = train.sparkSession.createDataFrame([(x, i) for i, x in enumerate(features)], "feature string, position int")
    info = order.join(F.broadcast(profile(train, features)), "feature").withColumn("usable", (F.col("missing") <= missing) & (F.col("scaled_variance") * F.col("largest") * F.col("largest") > variance))
    usable = info.where("usable").select("feature")
    filled = impute(train, train, features)
    most = filled.agg(*(F.max(F.abs(x)).alias(f"_a_{x}") for x in features))  # one row: correlations do not depend on the unit
    unit = {x: F.col(x) / F.when(F.col(f"_a_{x}") > 0, F.col(f"_a_{x}")).otherwise(1.0) for x in features}
    filled = filled.join(F.broadcast(most)).withColumns(unit).select(DATE, C.INSTRUMENT, target, *features)
    filled = stored(filled)
    near = pair_correlations(filled, features).where(F.abs("corr") > corr)
    near = near.join(usable.withColumnRenamed("feature", "a"), "a", "left_semi").join(usable.withColumnRenamed("feature", "b"), "b", "left_semi")
    first = near.groupBy(F.col("b").alias("feature")).agg(F.min_by("a", "i").alias("redundant_with"))
    out = info.join(first, "feature", "left").join(scores(filled, features, target), "feature", "left")
    out = out.withColumn("_ok", F.col("usable") & F.col("redundant_with").isNull())
    place = F.row_number().over(Window.partitionBy("_ok").orderBy(F.desc("score"), "position"))
    kept = F.col("_ok") & (place <= top) if top else F.col("_ok")
    return out.withColumn("kept", kept).select("feature", "position", "missing", "scaled_variance", "redundant_with", "score", "kept")


def fit(train: DataFrame, features, **options) -> Selected:
    found = table(train, features, **options)
    names = [r.feature for r in found.where("kept").orderBy("position").collect()]  # a row per feature
    return Selected(names, found, train)


def transform(df: DataFrame, selected: Selected, keep=()) -> DataFrame:
    """Selected features with training medians for nulls."""
    return impute(df, selected.train, selected.features).select(*keep, *selected.features)
