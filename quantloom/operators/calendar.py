"""Labels on the shared market calendar, temporal splits, purging, folds and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.columns import DATE, INSTRUMENT, history, order


def calendar(df: DataFrame) -> DataFrame:
    """(date, t): the distinct dates, numbered from 1. As many rows as dates, whatever the number of instruments."""
    return df.select(DATE).distinct().withColumn("t", F.row_number().over(Window.orderBy(DATE)))


def with_t(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(calendar(df)), DATE)


def add_forward_returns(df: DataFrame, horizons=(1, 5, 10)) -> DataFrame:
    """``df`` with y_Nd = close N market dates on / close - 1; null where the instrument has no row just there, so a
    label never jumps over a missing date. One self-join for all horizons: a row is offered to the dates before it."""
    own = with_t(df)
    later = own.select(INSTRUMENT, F.col("close").alias("_later"), F.explode(F.array(*map(F.lit, horizons))).alias("_n"), "t")
    later = later.select(INSTRUMENT, (F.col("t") - F.col("_n")).alias("t"), "_n", "_later")
    later = later.groupBy(INSTRUMENT, "t").agg(*(F.max(F.when(F.col("_n") == n, F.col("_later"))).alias(f"_c{n}") for n in horizons))
    out = own.join(later, [INSTRUMENT, "t"], "left")
    found = {f"y_{n}d": F.col(f"_c{n}") / F.when(F.col("close") != 0, F.col("close")) - 1 for n in horizons}
    return out.withColumns(found).drop("t", *(f"_c{n}" for n in horizons))


def activate(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("y", F.col(f"y_{horizon}d"))


def next_open(df: DataFrame) -> DataFrame:
    return df.withColumn("next_open", F.lead("open").over(order()))


def split(df: DataFrame, test: float = 0.2, start=None) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by date: from ``start`` on, or the last fraction of the distinct dates (one at least on each side)."""
    if start is not None:
        return df.where(F.col(DATE) < F.lit(start)), df.where(F.col(DATE) >= F.lit(start))
    tagged = tagged_split(df, test)
    return tagged.where("not is_test").drop("is_test"), tagged.where("is_test").drop("is_test")


def tagged_split(df: DataFrame, test: float = 0.2) -> DataFrame:
    days = calendar(df)
    n = F.max("t").over(Window.partitionBy())
    first = F.least(F.greatest(F.floor(n * (1 - test)), F.lit(1)), n - 1)
    return df.join(F.broadcast(days.select(DATE, (F.col("t") > first).alias("is_test"))), DATE)


def history_context(train: DataFrame, test: DataFrame, rows: int = 260) -> DataFrame:
    """The last rows of each instrument in train and all of test; where both have a row, test's."""
    back = Window.partitionBy(INSTRUMENT).orderBy(F.desc(DATE))
    tail = train.withColumn("_k", F.row_number().over(back)).where(F.col("_k") <= rows).drop("_k")
    both = tail.withColumn("_from", F.lit(0)).unionByName(test.withColumn("_from", F.lit(1)))
    last = Window.partitionBy(INSTRUMENT, DATE).orderBy(F.desc("_from"))
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_from")


def purge(train: DataFrame, horizon: int) -> DataFrame:
    """``train`` without the last ``horizon`` rows of each instrument: their labels reach beyond it."""
    back = Window.partitionBy(INSTRUMENT).orderBy(F.desc(DATE))
    return train.withColumn("_k", F.row_number().over(back)).where(F.col("_k") > horizon).drop("_k")


def purge_summary(train: DataFrame, horizon: int) -> DataFrame:
    back = Window.partitionBy(INSTRUMENT).orderBy(F.desc(DATE))
    tagged = train.withColumn("_cut", F.row_number().over(back) <= horizon)
    n = F.count("*")
    cut = F.sum(F.col("_cut").cast("long"))
    return tagged.agg(n.alias("rows_before"), (n - cut).alias("rows_after"), cut.alias("rows_purged"), F.countDistinct(F.when(F.col("_cut"), F.col(DATE))).alias("dates_touched"), F.max(F.when(~F.col("_cut"), F.col(DATE))).alias("last_train_date"))


def folds(df: DataFrame, n_folds: int) -> DataFrame:
    """(fold, train_end_t, valid_start_t, valid_end_t) of expanding folds: N // (k + 1) dates to validate in each, at the end."""
    n = calendar(df).agg(F.max("t").alias("n"))
    spec = n.select("n", F.expr(f"n div {n_folds + 1}").alias("size"), F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    start = F.col("n") - (n_folds + 1 - F.col("fold")) * F.col("size")
    return spec.select("fold", start.alias("train_end_t"), (start + 1).alias("valid_start_t"), (start + F.col("size")).alias("valid_end_t"))


def walk_forward(df: DataFrame, n_folds: int, horizon: int) -> DataFrame:
    """A row for each fold that holds a row of ``df``, with part = train or valid; train rows are purged by fold and instrument."""
    days, spec = with_t(df), folds(df, n_folds)
    both = days.join(F.broadcast(spec), F.col("t") <= F.col("valid_end_t"))
    both = both.withColumn("part", F.when(F.col("t") <= F.col("train_end_t"), "train").otherwise("valid"))
    back = Window.partitionBy("fold", "part", INSTRUMENT).orderBy(F.desc(DATE))
    both = both.withColumn("_k", F.row_number().over(back)).where((F.col("part") == "valid") | (F.col("_k") > horizon))
    return both.drop("_k", "t", "train_end_t", "valid_start_t", "valid_end_t")


def fold_summary(walk: DataFrame) -> DataFrame:
    return walk.groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.countDistinct(INSTRUMENT).alias("instruments"))


def date_blocks(df: DataFrame, n: int) -> DataFrame:
    """(date, block) of n runs of dates, larger ones first."""
    return df.select(DATE).distinct().withColumn("block", F.ntile(n).over(Window.orderBy(DATE)))


def halves(df: DataFrame) -> DataFrame:
    """``df`` with half: 1 up to the middle of the distinct dates, else 2."""
    days = calendar(df).withColumn("half", F.when(F.col("t") <= F.floor(F.max("t").over(Window.partitionBy()) / 2), 1).otherwise(2))
    return df.join(F.broadcast(days.select(DATE, "half")), DATE)


def month_windows(df: DataFrame, specs=((3, 1), (6, 2), (12, 12)), partial: bool = False) -> DataFrame:
    """(mode, start, end) of the whole range and of windows of so many months by steps of so many, within the range of
    dates; ``partial``: also the last that sticks out, cut to the range."""
    span = df.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))
    out = span.select(F.lit("full").alias("mode"), F.col("lo").alias("start"), F.col("hi").alias("end"))
    for months, step in specs:
        last = F.floor(F.months_between("hi", "lo") / step).cast("int") + 1
        w = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), last)).alias("k")).withColumn("start", F.add_months("lo", F.col("k") * step)).withColumn("end", F.date_sub(F.add_months("start", months), 1))
        w = w.where(F.col("start") <= F.col("hi"))
        w = w.withColumn("end", F.least("end", "hi")) if partial else w.where(F.col("end") <= F.col("hi"))
        out = out.unionByName(w.select(F.lit(f"{months}m").alias("mode"), "start", "end"))
    return out


def recent_windows(df: DataFrame, months=(3, 6, 12)) -> DataFrame:
    """(mode, start, end) of trailing windows that end at the last date."""
    hi = df.agg(F.max(DATE).alias("end"))
    return hi.select("end", F.explode(F.array(*map(F.lit, months))).alias("m")).select(F.concat(F.lit("last_"), F.col("m"), F.lit("m")).alias("mode"), F.date_add(F.add_months("end", -F.col("m")), 1).alias("start"), "end")


def in_windows(df: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each window that holds a row of ``df``; windows are few: as many as calendar steps."""
    return df.join(F.broadcast(windows), F.col(DATE).between(F.col("start"), F.col("end")))


def window_counts(df: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` with rows, instruments, first and last date of ``df`` in each; windows without rows have zeros and nulls."""
    found = in_windows(df.select(DATE, INSTRUMENT), windows).groupBy("mode", "start", "end")
    found = found.agg(F.count("*").alias("rows"), F.countDistinct(INSTRUMENT).alias("instruments"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"))
    return windows.join(found, ["mode", "start", "end"], "left").fillna(0, ["rows", "instruments"])


def shift_dates(df: DataFrame, k: int) -> DataFrame:
    """(date, shifted): k market dates on (or back), null off the end."""
    days = calendar(df)
    return days.join(days.select((F.col("t") - k).alias("t"), F.col(DATE).alias("shifted")), "t", "left").select(DATE, "shifted")


def holding_windows(df: DataFrame, hold: int, delay: int = 1, mode: str = "signal_horizon") -> DataFrame:
    """(signal_date, execution_date, end_date, days) of each date from which the whole window fits in the calendar.

    signal_horizon: the window ends ``hold`` dates after the signal; execution_horizon: after execution."""
    end = hold if mode == "signal_horizon" else hold + delay
    days = calendar(df)
    at = lambda n, name: days.select((F.col("t") - n).alias("t"), F.col(DATE).alias(name))
    return days.join(at(delay, "execution_date"), "t").join(at(end, "end_date"), "t").select(F.col(DATE).alias("signal_date"), "execution_date", "end_date", F.lit(end - delay).alias("days"))


def between(df: DataFrame, start, end) -> DataFrame:
    return df.where(F.col(DATE).between(F.lit(start), F.lit(end)))


def last_row_count(df: DataFrame) -> DataFrame:
    """Rows of each instrument so far."""
    return df.withColumn("seen", F.count("*").over(history()))
