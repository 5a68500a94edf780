"""Point-in-time merges: statements with an availability date, as-of joins, macro series on the market calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, INSTRUMENT


def available(accepted="accepted_date", filing="filing_date", report="report_date", lag: int = 90):
    """When a statement could be known: accepted, else filed, else so many days after its period."""
    return F.coalesce(F.col(accepted), F.col(filing), F.date_add(F.col(report), lag))


def first_of(df: DataFrame, names, alias: str) -> DataFrame:
    """The first non-null of those columns that exist."""
    found = [F.col(x) for x in names if x in df.columns]
    return df.withColumn(alias, F.coalesce(*found) if found else F.lit(None).cast("double"))


def statements(parts: list[DataFrame]) -> DataFrame:
    """Statements (instrument_id, report_date, filing_date, accepted_date, values) in a full outer join; they are available
    when the last of them is. The largest row of repeated keys stays."""
    keyed = []
    for i, p in enumerate(parts):
        p = p.withColumn(f"_d{i}", available()).drop("filing_date", "accepted_date")
        last = Window.partitionBy(INSTRUMENT, "report_date").orderBy(F.desc(f"_d{i}"))
        keyed.append(p.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k"))
    out = reduce(lambda a, b: a.join(b, [INSTRUMENT, "report_date"], "full"), keyed)
    days = [F.col(f"_d{i}") for i in range(len(parts))]
    return out.withColumn("effective_date", F.greatest(*days) if len(days) > 1 else days[0]).drop(*(f"_d{i}" for i in range(len(parts))))


def quarterly(df: DataFrame) -> DataFrame:
    """Trailing sums of four quarters (all four), mean equity and assets (two at least), roe, roa, yoy and qoq."""
    by = Window.partitionBy(INSTRUMENT).orderBy("report_date")
    w = by.rowsBetween(-3, 0)

    def ttm(x):
        return F.when(F.count(x).over(w) >= 4, F.sum(x).over(w))

    def mean(x):
        return F.when(F.count(x).over(w) >= 2, F.avg(x).over(w))

    out = df.withColumns({"revenue_ttm": ttm("revenue"), "net_income_ttm": ttm("net_income"), "equity_avg": mean("equity"), "assets_avg": mean("assets"), "_y": F.lag("revenue", 4).over(by), "_q": F.lag("revenue", 1).over(by)})
    return out.withColumns({"roe": C.safe_divide(F.col("net_income_ttm"), F.col("equity_avg")), "roa": C.safe_divide(F.col("net_income_ttm"), F.col("assets_avg")), "yoy": C.safe_divide(F.col("revenue") - F.col("_y"), F.abs("_y")), "qoq": C.safe_divide(F.col("revenue") - F.col("_q"), F.abs("_q"))}).drop("_y", "_q")


def as_of(panel: DataFrame, events: DataFrame, values, when: str = "effective_date") -> DataFrame:
    """``panel`` with the values of the latest event of its instrument that was known by its date. One shuffle: events
    and rows in one order, events first on a date; of events on one date the later report counts."""
    tie = "report_date" if "report_date" in events.columns else when
    marks = events.select(INSTRUMENT, F.col(when).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.struct(*values).alias("_event")).where("_at is not null")
    rows = panel.select(INSTRUMENT, F.col(DATE).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(events.dtypes)[tie]).alias("_tie"), F.struct(*panel.columns).alias("_row"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(INSTRUMENT).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_event", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select("_row.*", *(F.col(f"_last.{x}").alias(x) for x in values))


def ratios(df: DataFrame) -> DataFrame:
    """pe, pb and ps from eps, bps and sps where they are there."""
    found = {k: C.safe_divide(F.col("close"), F.col(x)) for k, x in (("pe", "eps"), ("pb", "bps"), ("ps", "sps")) if x in df.columns}
    return df.withColumns(found) if found else df


def merge_macro(panel: DataFrame, macro: DataFrame, columns) -> DataFrame:
    """``panel`` with macro columns: values on market dates only, carried forward over the market calendar; new values go
    before the panel's own."""
    days = panel.select(DATE).distinct().join(macro.select(DATE, *columns), DATE, "left")
    w = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(DATE, *(F.last(x, ignorenulls=True).over(w).alias(f"_m_{x}") for x in columns))
    out = panel.join(F.broadcast(days), DATE, "left")  # a row per date
    return out.withColumns({x: F.coalesce(f"_m_{x}", x) if x in panel.columns else F.col(f"_m_{x}") for x in columns}).drop(*(f"_m_{x}" for x in columns))


def macro_returns(macro: DataFrame, column: str, alias: str) -> DataFrame:
    before = F.lag(column).over(Window.orderBy(DATE))
    return macro.withColumn(alias, C.safe_divide(F.col(column), before) - 1)


def macro_coverage(macro: DataFrame, merged: DataFrame) -> DataFrame:
    """(column, macro_rows, macro_share, merged_rows, merged_share, first_date, last_date) of each macro column: values it has
    and their share, in its own table and in the panel (null where the panel lacks the column), and the panel's dates with it."""
    names = [x for x in macro.columns if x != DATE]
    there = [x for x in names if x in merged.columns]
    long = lambda df, xs: df.select(DATE, F.explode(F.array(*(F.struct(F.lit(x).alias("column"), F.col(x).isNotNull().alias("has")) for x in xs))).alias("c")).select(DATE, "c.*")
    rows, share = F.count(F.when(F.col("has"), 1)), F.avg(F.col("has").cast("double"))
    own = long(macro, names).groupBy("column").agg(rows.alias("macro_rows"), share.alias("macro_share"))
    empty = own.select("column", F.lit(None).cast("long").alias("merged_rows"), F.lit(None).cast("double").alias("merged_share"), F.lit(None).cast("date").alias("first_date"), F.lit(None).cast("date").alias("last_date")).limit(0)
    seen = F.when(F.col("has"), F.col(DATE))
    panel = long(merged, there).groupBy("column").agg(rows.alias("merged_rows"), share.alias("merged_share"), F.min(seen).alias("first_date"), F.max(seen).alias("last_date")) if there else empty
    return own.join(panel, "column", "left")
