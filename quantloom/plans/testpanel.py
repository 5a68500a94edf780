"""Panels made from the star-schema tables, in Spark and as SQL for the oracles: suppliers are instruments, months or
weeks are dates, unit prices of line items are prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, market_cap, sector."""
    names = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return names.select(F.col("s_suppkey").cast("long").alias("instrument_id"), F.col("s_acctbal").cast("double").alias("market_cap"), F.col("r_name").alias("sector"))


def panel(spark: SparkSession, sf_dir: str, every: str = "month") -> DataFrame:
    """instrument_id, date, open, high, low, close, volume, turnover, vwap, adjustment, market_cap, sector."""
    lines = read(spark, sf_dir, "lineitem")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    bars = lines.select(F.col("l_suppkey").cast("long").alias("instrument_id"), F.trunc("l_shipdate", every).alias("date"), price.alias("p"), key.alias("k"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("x"), F.col("l_discount").cast("double").alias("d"))
    bars = bars.groupBy("instrument_id", "date").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("q").alias("volume"), F.round(F.sum("x"), 2).alias("turnover"), (1 - F.round(F.sum("d"), 2) / F.count("*")).alias("adjustment")
    )
    bars = bars.withColumn("vwap", F.col("turnover") / F.col("volume"))
    return bars.join(suppliers(spark, sf_dir), "instrument_id").select("instrument_id", "date", "open", "high", "low", "close", "volume", "turnover", "vwap", "adjustment", "market_cap", "sector")


def panel_sql(name: str = "panel", every: str = "month") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT b.*, turnover / volume AS vwap, s_acctbal::DOUBLE AS market_cap, r_name AS sector FROM (
    SELECT l_suppkey::BIGINT AS instrument_id, date_trunc('{every}', l_shipdate)::DATE AS date,
      arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(l_quantity::DOUBLE) AS volume,
      round(sum(l_extendedprice::DOUBLE), 2) AS turnover, 1 - round(sum(l_discount::DOUBLE), 2) / count(*) AS adjustment
    FROM (SELECT *, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS p, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem)
    GROUP BY 1, 2) b
  JOIN supplier ON s_suppkey = instrument_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def tidy_sql(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1 THEN round({x}, 7) WHEN abs({x}) > 1e37 THEN (sign({x}) * 1e37::DOUBLE)::FLOAT::DOUBLE ELSE ({x})::FLOAT::DOUBLE END) + 0.0"


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements: instrument_id, report_date, filing_date, accepted_date, revenue, net_income, assets, equity."""
    lines = read(spark, sf_dir, "lineitem")
    quarter = F.date_sub(F.add_months(F.trunc("l_shipdate", "quarter"), 3), 1)
    x, d = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    out = lines.groupBy(F.col("l_suppkey").cast("long").alias("instrument_id"), quarter.alias("report_date")).agg(F.round(F.sum("l_extendedprice"), 2).cast("double").alias("revenue"), F.round(F.sum(x * d), 2).alias("net_income"), F.sum(F.col("l_quantity").cast("double")).alias("assets"), F.count("*").cast("double").alias("equity"))
    filing = F.when(F.col("instrument_id") % 3 != 0, F.date_add("report_date", 40))
    accepted = F.when(F.col("instrument_id") % 3 == 1, F.date_add("report_date", 45))
    return out.withColumns({"filing_date": filing, "accepted_date": accepted})


FUNDAMENTALS_SQL = """fundamentals AS MATERIALIZED (
  SELECT *, CASE WHEN instrument_id % 3 <> 0 THEN report_date + 40 END AS filing_date, CASE WHEN instrument_id % 3 = 1 THEN report_date + 45 END AS accepted_date FROM (
    SELECT l_suppkey::BIGINT AS instrument_id, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS report_date, round(sum(l_extendedprice), 2)::DOUBLE AS revenue,
      round(sum(l_extendedprice::DOUBLE * l_discount::DOUBLE), 2) AS net_income, sum(l_quantity::DOUBLE) AS assets, count(*)::DOUBLE AS equity FROM lineitem GROUP BY 1, 2))"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series: date, vix (mean order value), us10y, us3m."""
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg((F.round(F.sum("o_totalprice"), 2).cast("double") / F.count("*")).alias("vix"), F.count("*").cast("double").alias("us10y"), F.countDistinct("o_custkey").cast("double").alias("us3m"))


MACRO_SQL = """macro AS MATERIALIZED (
  SELECT date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice), 2)::DOUBLE / count(*) AS vix, count(*)::DOUBLE AS us10y, count(DISTINCT o_custkey)::DOUBLE AS us3m FROM orders GROUP BY 1)"""


def edges(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """Suppliers (source, target) that share a part in a quarter: date, source, target, weight, rank, same_sector. A part's suppliers
    meet in one list a quarter, and the pairs move once: counted and ranked where their target is."""
    from pyspark.sql import Window

    lines = read(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "quarter").alias("date"), "l_partkey", F.col("l_suppkey").cast("long").alias("s"))
    parts = lines.where("date is not null and l_partkey is not null").groupBy("date", "l_partkey").agg(F.collect_set("s").alias("s")).where(F.size("s") > 1)
    both = parts.select("date", "s", F.explode("s").alias("source")).select("date", "source", F.explode("s").alias("target")).where("source <> target")
    both = both.repartition("date", "target").groupBy("date", "source", "target").agg(F.count("*").cast("double").alias("weight"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("date", "target").orderBy(F.desc("weight"), "source"))).where(F.col("rank") <= top)
    sector = suppliers(spark, sf_dir).select("instrument_id", "sector").distinct()
    ranked = ranked.join(sector.select(F.col("instrument_id").alias("source"), F.col("sector").alias("a")), "source").join(sector.select(F.col("instrument_id").alias("target"), F.col("sector").alias("b")), "target")
    return ranked.select("date", "source", "target", "weight", "rank", (F.col("a") == F.col("b")).alias("same_sector"))


EDGES_SQL = """edges AS MATERIALIZED (
  WITH u AS (SELECT DISTINCT date_trunc('quarter', l_shipdate)::DATE AS date, l_partkey, l_suppkey::BIGINT AS s FROM lineitem),
  x AS (SELECT date, a.s AS source, b.s AS target, count(*)::DOUBLE AS weight FROM u a JOIN u b USING (date, l_partkey) WHERE a.s <> b.s GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY date, target ORDER BY weight DESC, source) AS rank FROM x),
  c AS (SELECT DISTINCT instrument_id, sector FROM panel)
  SELECT date, source, target, weight, rank, p.sector = q.sector AS same_sector FROM k JOIN c p ON p.instrument_id = source JOIN c q ON q.instrument_id = target WHERE rank <= 5)"""


def predictions(df: DataFrame, horizon: int = 1) -> DataFrame:
    """date, instrument_id, y, predicted_y: the forward return and a fixed score of the panel's own columns."""
    from quantloom.operators import calendar

    out = calendar.add_forward_returns(df, [horizon])
    score = F.round(F.pmod(F.col("volume") * 7 + F.floor("close"), F.lit(101)) / 101 + F.col("close") / (F.col("high") + F.col("low")), 9)
    return out.select("date", "instrument_id", F.col(f"y_{horizon}d").alias("y"), score.alias("predicted_y"))


def predictions_sql(horizon: int = 1) -> str:
    return f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM panel)),
pt AS (SELECT p.*, t FROM panel p JOIN cal USING (date)),
pred AS MATERIALIZED (SELECT a.date, a.instrument_id, b.close / a.close - 1 AS y, round(((a.volume * 7 + floor(a.close)) % 101) / 101 + a.close / (a.high + a.low), 9) AS predicted_y
  FROM pt a LEFT JOIN pt b ON a.instrument_id = b.instrument_id AND b.t = a.t + {horizon})"""
