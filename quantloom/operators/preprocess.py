"""Per-date winsorising, z-scoring and neutralisation as window functions over the date and the date's sectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C


def winsorize(x, q: float = 0.01):
    """Clipped to the date's interpolated quantiles q and 1 - q."""
    low, high = (F.percentile(x, F.lit(p)).over(C.section()) for p in (q, 1 - q))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def zscore(x, *within):
    """(x - mean) / population deviation within the date; null if nothing varies."""
    w = C.section(*within)
    dev = F.stddev_pop(x).over(w)
    return (x - F.avg(x).over(w)) / F.when(dev > 1e-12, dev)


def safe_zscore(x, *within):
    """As zscore; only demeaned if nothing varies."""
    w = C.section(*within)
    dev = F.stddev_pop(x).over(w)
    return (x - F.avg(x).over(w)) / F.when(dev >= 1e-12, dev).otherwise(1.0)


def cross_sectional(x):
    """True on dates where x has two values at least and varies."""
    w = C.section()
    return (F.count(x).over(w) > 1) & (F.stddev_pop(x).over(w) > 1e-12)


def standardize(df: DataFrame, columns, q: float = 0.01, least: int = 0, demean: bool = False) -> DataFrame:
    """Winsorised z-scores. Dates with under ``least`` values stay; on dates without variation the score is null, or
    with ``demean`` the difference from the mean."""
    cut = df.withColumns({f"_c_{x}": winsorize(F.col(x), q) for x in columns})
    score = safe_zscore if demean else zscore
    out = {}
    for x in columns:
        z = score(F.col(f"_c_{x}"))
        out[x] = F.when(F.count(F.col(x)).over(C.section()) >= least, z).otherwise(F.col(x)) if least else z
    return cut.withColumns(out).drop(*(f"_c_{x}" for x in columns))


def neutralize(df: DataFrame, columns, cap: str | None = "market_cap", sector: str | None = "sector", coverage: float = 0.9) -> DataFrame:
    """Residuals of each column's regression on the date's sectors and, where ``coverage`` of the date has a positive
    market cap and two of them differ, on its standardised log.

    In closed form: columns and size are demeaned within (date, sector); the residual takes away size times the ratio
    of their products' sums. A column stays as it is on a date with no more complete rows than regressors."""
    size = F.when(F.col(cap) > 0, F.ln(cap)) if cap else F.lit(None).cast("double")
    group = F.coalesce(F.col(sector), F.lit("Unknown")) if sector else F.lit("-")
    df = df.withColumns({"_size": size, "_group": group})
    used = (F.avg(F.col("_size").isNotNull().cast("double")).over(C.section()) >= coverage) & (F.max("_size").over(C.section()) > F.min("_size").over(C.section()))
    df = df.withColumn("_used", F.coalesce(used, F.lit(False))).withColumn("_size", F.when(F.col("_used"), safe_zscore(F.col("_size"))))
    groups = F.size(F.collect_set("_group").over(C.section()))
    df = df.withColumn("_k", groups + F.col("_used").cast("int"))
    ok = {x: F.col(x).isNotNull() & (~F.col("_used") | F.col("_size").isNotNull()) for x in columns}
    inner = {}
    for x in columns:
        w = C.section("_group")
        v, s = F.when(ok[x], F.col(x)), F.when(ok[x], F.coalesce("_size", F.lit(0.0)))
        inner |= {f"_x_{x}": v - F.avg(v).over(w), f"_s_{x}": s - F.avg(s).over(w), f"_n_{x}": F.count(v).over(C.section())}
    df = df.withColumns(inner)
    out = {}
    for x in columns:
        a, b, w = F.col(f"_x_{x}"), F.col(f"_s_{x}"), C.section()
        bb = F.sum(b * b).over(w)
        beta = F.when(bb > 1e-12, F.sum(a * b).over(w) / bb).otherwise(0.0)
        out[x] = F.when((F.col("_k") <= 1) | (F.col(f"_n_{x}") <= F.col("_k")), F.col(x)).otherwise(a - beta * b)
    return df.withColumns(out).drop("_size", "_group", "_used", "_k", *inner)


def preprocess(df: DataFrame, columns, q: float = 0.01, scale: bool = True, neutral: bool = True) -> DataFrame:
    """Winsorised, standardised and neutralised columns; a column that does not vary on a date passes untouched there.
    The raw market cap stays the size exposure however often this is applied."""
    columns = list(columns)
    if not columns:
        return df
    df = df.withColumns({f"_v_{x}": cross_sectional(F.col(x)) for x in columns} | {f"_r_{x}": F.col(x) for x in columns})
    df = df.withColumns({x: F.when(F.col(f"_v_{x}"), F.col(x)) for x in columns})
    if scale:
        df = standardize(df, columns, q)
    if neutral:
        df = neutralize(df, columns)
    df = df.withColumns({x: F.when(F.col(f"_v_{x}"), F.col(x)).otherwise(F.col(f"_r_{x}")) for x in columns})
    return df.drop(*(f"_{k}_{x}" for x in columns for k in "vr"))


def exposure_summary(df: DataFrame) -> DataFrame:
    """One row per date: rows, share with a market cap, sectors."""
    return df.groupBy(C.DATE).agg(F.count("*").alias("rows"), F.avg((F.col("market_cap") > 0).cast("double")).alias("cap_coverage"), F.countDistinct(F.coalesce("sector", F.lit("Unknown"))).alias("sectors"))


def sanitize(x, most: float = 1e12):
    """Null for non-finite, clipped to +-most."""
    x = C.finite(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-most)), F.lit(most)))


def medians(train: DataFrame, columns, accuracy: int = 1000) -> DataFrame:
    """One row: each column's exact median on the training rows, 0 if it has none.

    A sketch gives two values that the middle lies between; the rows below the lower one are counted, and only those between
    (four ranks in ``accuracy``) are counted by value and ordered. Where the count shows that the middle is not between,
    the bounds are put wider. Runs jobs; the driver holds two bounds a column."""
    spark, columns, margin = train.sparkSession, list(columns), 2.0 / accuracy
    rows = train.select(*(F.col(x).cast("double").alias(x) for x in columns))
    found, left = {}, columns
    while left:
        shares = F.array(F.lit(max(0.0, 0.5 - margin)), F.lit(min(1.0, 0.5 + margin)))
        bounds = rows.agg(*(F.struct(F.percentile_approx(x, shares, F.lit(accuracy)).alias("q"), F.count(x).alias("n")).alias(x) for x in left)).first()
        found |= {x: 0.0 for x in left if not bounds[x].n}
        left = [x for x in left if bounds[x].n]
        if not left:
            break
        whole = margin >= 0.5
        place = {x: F.when(F.col(x) < F.lit(bounds[x].q[0]), -1).when(F.col(x) <= F.lit(bounds[x].q[1]), 0) for x in left} if not whole else {x: F.when(F.col(x).isNotNull(), 0) for x in left}
        under = rows.agg(*(F.count_if(place[x] == -1).alias(x) for x in left)).first()
        near = rows.select(F.explode(F.array_compact(F.array(*(F.when(place[x] == 0, F.struct(F.lit(x).alias("column"), F.col(x).alias("value"))) for x in left)))).alias("v"))
        near = near.groupBy("v.column", "v.value").agg(F.count("*").alias("k"))
        near = near.withColumn("upto", F.sum("k").over(Window.partitionBy("column").orderBy("value")))
        low = F.create_map(*(F.lit(y) for x in left for y in (x, (bounds[x].n + 1) // 2 - under[x])))[F.col("column")]
        high = F.create_map(*(F.lit(y) for x in left for y in (x, bounds[x].n // 2 + 1 - under[x])))[F.col("column")]
        at = near.groupBy("column").agg(F.min(F.when(F.col("upto") >= low, F.col("value"))).alias("a"), F.min(F.when(F.col("upto") >= high, F.col("value"))).alias("b"), F.first(low).alias("low"))
        found |= {r.column: r.a if r.a == r.b else 0.5 * r.a + 0.5 * r.b for r in at.collect() if r.low >= 1 and r.b is not None}
        left = [x for x in left if x not in found]
        margin = 0.5 if whole else margin * 10
    return spark.range(1).select(*(F.lit(found[x]).cast("double").alias(x) for x in columns))


def impute(df: DataFrame, train: DataFrame, columns) -> DataFrame:
    """Nulls replaced by the training medians: one row, broadcast."""
    m = medians(train, columns).select(*(F.col(x).alias(f"_m_{x}") for x in columns))
    return df.join(F.broadcast(m)).withColumns({x: F.coalesce(F.col(x), F.col(f"_m_{x}")) for x in columns}).drop(*(f"_m_{x}" for x in columns))
