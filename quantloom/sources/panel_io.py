"""Panel sources and sinks: reading and coercing bars, vendor layouts, universes and liquidity screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, INSTRUMENT

REQUIRED = (INSTRUMENT, DATE, "open", "high", "low", "close", "volume")
TEXT = ("sector", "market_cap_source", "fiscal_period")
DATES = (DATE, "effective_date", "accepted_date", "filing_date", "report_date")


def coerce(df: DataFrame) -> DataFrame:
    """Dates as dates, text as text, everything else as double; what cannot be read, and what is not finite, is null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if name == INSTRUMENT or name in TEXT:
            out.append(c.cast("string").alias(name))
        elif name in DATES:
            out.append((c if kind == "date" else F.try_to_timestamp(c.cast("string")).cast("date")).alias(name))
        else:
            out.append(C.finite(F.expr(f"try_cast(`{name}` AS DOUBLE)")).alias(name))
    return df.select(*out)


def load_panel(df: DataFrame, price_mode: str = "raw") -> DataFrame:
    """``df`` (as read from CSV or Parquet) as a panel: required columns checked, coerced, vwap, turnover (raw close times
    volume), adjustment, market_cap, its source and next_open filled in if absent. vendor_adjusted multiplies prices by
    a positive adjustment, else they are null."""
    if missing := [x for x in REQUIRED if x not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df = coerce(df)
    has = set(df.columns)
    new = {
        "vwap": F.col("vwap") if "vwap" in has else (F.col("high") + F.col("low") + F.col("close")) / 3,
        "adjustment": F.col("adjustment") if "adjustment" in has else F.lit(1.0),
        "market_cap": F.col("market_cap") if "market_cap" in has else F.lit(None).cast("double"),
        "turnover": F.coalesce("turnover", F.col("close") * F.col("volume")) if "turnover" in has else F.col("close") * F.col("volume"),
    }
    df = df.withColumns(new)
    source = F.when(F.col("market_cap").isNull(), "missing").otherwise("reported")
    df = df.withColumn("market_cap_source", F.coalesce("market_cap_source", source) if "market_cap_source" in has else source)
    if price_mode == "vendor_adjusted":
        factor = F.when(F.col("adjustment") > 0, F.col("adjustment"))
        df = df.withColumns({x: F.col(x) * factor for x in ("open", "high", "low", "close", "vwap")})
    elif price_mode != "raw":
        raise ValueError(price_mode)
    return df.withColumn("next_open", F.lead("open").over(C.order()))


def violations(df: DataFrame) -> DataFrame:
    """(kind, rows) of duplicate keys, closes that are not positive and negative volumes."""
    keys = df.groupBy(INSTRUMENT, DATE).count().agg(F.sum(F.when(F.col("count") > 1, F.col("count") - 1).otherwise(0)).alias("n")).select(F.lit("duplicate_keys").alias("kind"), F.coalesce("n", F.lit(0)).alias("rows"))
    rest = df.agg(F.sum((F.col("close") <= 0).cast("long")).alias("close_not_positive"), F.sum((F.col("volume") < 0).cast("long")).alias("negative_volume"))
    return keys.union(rest.select(F.expr("stack(2, 'close_not_positive', coalesce(close_not_positive, 0), 'negative_volume', coalesce(negative_volume, 0)) AS (kind, rows)")))


def load_predictions(df: DataFrame) -> DataFrame:
    """Predictions without nulls; a key that occurs twice raises."""
    df = df.select(DATE, INSTRUMENT, "y", "predicted_y").dropna()
    if not df.groupBy(DATE, INSTRUMENT).count().where("count > 1").isEmpty():
        raise ValueError("duplicate predictions")
    return df


def vendor_bars(df: DataFrame) -> DataFrame:
    """Vendor bars (symbol, date, open, high, low, close, adj_close, volume) as a panel: vwap of the four prices,
    adjustment adj_close / close, turnover, next_open; rows without prices go."""
    df = df.dropna(subset=["open", "high", "low", "close"])
    df = df.select(canonical_symbol(F.col("symbol")).alias(INSTRUMENT), F.to_date("date").alias(DATE), "open", "high", "low", "close", "volume", ((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).alias("vwap"), C.safe_divide(F.col("adj_close"), F.col("close")).alias("adjustment"), (F.col("close") * F.col("volume")).alias("turnover"))
    return df.withColumns({"next_open": F.lead("open").over(C.order()), "sector": F.lit("Unknown"), "market_cap": F.lit(None).cast("double")})


def wide_to_long(df: DataFrame, symbols, fields=("open", "high", "low", "close", "volume")) -> DataFrame:
    """Columns field_symbol of one row per date as one row per symbol and date; rows with all fields null go."""
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("symbol"), *(F.col(f"{f}_{s}").cast("double").alias(f) for f in fields)) for s in symbols)))
    return df.select(DATE, rows.alias("r")).select("r.symbol", DATE, *(f"r.{f}" for f in fields)).dropna(how="all", subset=list(fields))


def canonical_symbol(x):
    """Upper case, trimmed, dots as dashes."""
    return F.upper(F.regexp_replace(F.trim(x), r"\.", "-"))


def loose_bool(x):
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes")


def _flagged(name):
    return F.upper(F.trim(F.col(name).cast("string"))).isin("Y", "YES", "TRUE", "1")


def universe(listings: list[DataFrame], excluded: str = r"(?i)warrant|right|unit|preferred|depositary") -> DataFrame:
    """(symbol, name) of listing tables (symbol, name, etf, test): united, trimmed, plain symbols only, without funds, test
    issues and excluded kinds of paper; the first name of a symbol stays."""
    both = listings[0]
    for x in listings[1:]:
        both = both.unionByName(x, allowMissingColumns=True)
    both = both.select(canonical_symbol(F.col("symbol")).alias("symbol"), F.trim("name").alias("name"), _flagged("etf").alias("etf"), _flagged("test").alias("test"))
    both = both.where(F.col("symbol").rlike(r"^[A-Z]{1,5}(-[A-Z])?$") & ~F.coalesce("etf", F.lit(False)) & ~F.coalesce("test", F.lit(False)) & ~F.coalesce(F.col("name").rlike(excluded), F.lit(False)))
    return both.groupBy("symbol").agg(F.min("name").alias("name"))


def liquidity(df: DataFrame, rows: int = 60, least_days: int = 40, least_close: float = 0.0, top: int | None = None) -> DataFrame:
    """(instrument_id, valid_days, last_close, mean_turnover, median_turnover, liquidity_rank) over the last ``rows`` rows
    with a positive close and volume; thin ones go, the rank is by median turnover."""
    back = Window.partitionBy(INSTRUMENT).orderBy(F.desc(DATE))
    rows_ = df.where("close > 0 and volume > 0").withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= rows)
    value = F.col("close") * F.col("volume")
    out = rows_.groupBy(INSTRUMENT).agg(F.count("*").alias("valid_days"), F.max_by("close", DATE).alias("last_close"), F.avg(value).alias("mean_turnover"), F.percentile(value, 0.5).alias("median_turnover"))
    out = out.where((F.col("valid_days") >= least_days) & (F.col("last_close") >= least_close))
    place = [F.desc("median_turnover"), F.col(INSTRUMENT)]
    if top is not None:
        out = out.orderBy(*place).limit(top)  # so that one task numbers no more than these; without top, a row per instrument
    return out.withColumn("liquidity_rank", F.row_number().over(Window.orderBy(*place)))


def only(df: DataFrame, members: DataFrame, start=None, end=None) -> DataFrame:
    """Rows of the instruments in ``members`` within the dates; filters reach the scan."""
    if start is not None:
        df = df.where(F.col(DATE) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(DATE) <= F.lit(end))
    return df.join(members.select(INSTRUMENT).distinct(), INSTRUMENT, "left_semi")


def with_sector(df: DataFrame, sectors: DataFrame) -> DataFrame:
    """The sector of a map (instrument_id, sector) where the panel has none; Unknown where the map has none either."""
    own = F.col("sector") if "sector" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("_own", own).drop("sector")
    return df.join(sectors.select(INSTRUMENT, "sector"), INSTRUMENT, "left").withColumn("sector", F.coalesce("_own", "sector", F.lit("Unknown"))).drop("_own")


def failed(requested: DataFrame, present: DataFrame, reason: str = "no rows") -> DataFrame:
    """(instrument_id, reason) of the requested instruments that are not there."""
    return requested.select(INSTRUMENT).distinct().join(present.select(INSTRUMENT).distinct(), INSTRUMENT, "left_anti").withColumn("reason", F.lit(reason))


def merge_files(spark, paths: list[str], target: str) -> None:
    """Parquet batches as one table."""
    spark.read.parquet(*paths).write.mode("overwrite").parquet(target)
