"""Long/short and long-only books, weights, costs and overlapping-sleeve ledgers: all rebalances in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, INSTRUMENT
from quantloom.functions.tables import stored

from . import calendar

YEAR = 252


@dataclass(frozen=True)
class Config:
    hold: int = 5
    step: int = 5
    delay: int = 1
    top_k: int = 5
    cost_bps: float = 20.0
    borrow_bps: float = 0.0
    neutral: bool = False
    weights: str = "equal"
    cap: float | None = None
    clock: str = "signal_horizon"

    @property
    def days(self) -> int:
        return self.hold - self.delay if self.clock == "signal_horizon" else self.hold

    @property
    def sleeves(self) -> int:
        return max(1, -(-self.days // self.step))


def market_snapshot(panel: DataFrame) -> DataFrame:
    """date, instrument_id, sector, daily_close_return, market_cap carried forward, its log's z-score on the date, and the
    20-row realised volatility (5 rows at least)."""
    cap = F.last("market_cap", ignorenulls=True).over(C.history())
    df = panel.select(DATE, INSTRUMENT, "sector", C.safe_divide(F.col("close"), C.delay(F.col("close"))).alias("_r"), cap.alias("market_cap")).withColumn("daily_close_return", F.col("_r") - 1)
    size = F.when(F.col("market_cap") > 0, F.ln("market_cap"))
    df = df.withColumn("_s", size)
    w = C.history(20)
    vol = F.when(F.count("daily_close_return").over(w) >= 5, F.stddev_pop("daily_close_return").over(w))
    dev = F.stddev_pop("_s").over(C.section())
    z = (F.col("_s") - F.avg("_s").over(C.section())) / F.when(dev > 1e-12, dev)
    return df.withColumns({"size_exposure_z": z, "realized_vol_20": vol}).drop("_r", "_s")


def merge_predictions(predictions: DataFrame, market: DataFrame) -> DataFrame:
    return predictions.join(market, [DATE, INSTRUMENT], "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def _place(down: bool, *keys):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("predicted_y") if down else F.col("predicted_y"), INSTRUMENT))


def _quotas(counts: DataFrame) -> DataFrame:
    """quota of each row of (date, sector, n_s, top_k)."""
    day = Window.partitionBy(DATE, "top_k")
    q = counts.withColumn("_raw", F.col("top_k") * F.col("n_s") / F.sum("n_s").over(day)).withColumn("_cap", F.floor(F.col("n_s") / 2)).where("_cap > 0")
    q = q.withColumns({"_base": F.least(F.floor("_raw"), F.col("_cap")), "_rest": F.round(F.col("_raw") - F.floor("_raw"), 9)})
    q = q.withColumn("_slack", F.col("_cap") - F.col("_base")).withColumn("_left", F.greatest(F.lit(0), F.col("top_k") - F.sum("_base").over(day)))
    before = day.orderBy(F.desc("_rest"), F.desc("n_s"), "sector").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.least(F.col("_slack"), F.greatest(F.lit(0), F.col("_left") - F.coalesce(F.sum("_slack").over(before), F.lit(0))))
    return q.select(DATE, "sector", "top_k", (F.col("_base") + extra).cast("int").alias("quota")).where("quota > 0")


def sector_quotas(rows: DataFrame, top_k: int) -> DataFrame:
    """(date, sector, quota): floor(K n_s / n), at most n_s // 2; seats left go to the largest remainders, each until its
    capacity is full."""
    return _quotas(rows.groupBy(DATE, "sector").agg(F.count("*").alias("n_s")).withColumn("top_k", F.lit(top_k))).drop("top_k")


def all_books(rows: DataFrame, kinds: list[tuple[int, bool]]) -> DataFrame:
    """``rows`` of the long and short books of each date for every (top_k, neutral), with side, top_k and neutral: the K highest and
    lowest scores, or with neutral as many of both in each sector by its quota, filled up from all others. Dates with under
    2 K rows have none. Ties go by instrument.

    Rows are ranked once, whatever the number of kinds; only those that some book can take are expanded: the highest and
    lowest of the date, and of the sector up to its quota."""
    rows = rows.where("predicted_y is not null and sector is not null")
    rows = rows.withColumns({"_n": F.count("*").over(Window.partitionBy(DATE)), "_u": _place(True, DATE), "_d": _place(False, DATE)})
    of = lambda flag: sorted({k for k, neutral in kinds if neutral == flag})
    expanded = lambda df, flag: df.withColumn("top_k", F.explode(F.array(*map(F.lit, of(flag))))).where(F.col("_n") >= 2 * F.col("top_k"))
    parts = []
    if of(False):
        most = max(of(False))
        some = expanded(rows.where((F.col("_u") <= most) | (F.col("_d") <= most)), False)
        side = F.when(F.col("_u") <= F.col("top_k"), "long").when(F.col("_d") <= F.col("top_k"), "short")
        parts.append(some.withColumns({"side": side, "neutral": F.lit(False)}))
    if of(True):
        counts = rows.groupBy(DATE, "sector").agg(F.count("*").alias("n_s"), F.first("_n").alias("_n"))
        some = rows.withColumns({"_us": _place(True, DATE, "sector"), "_ds": _place(False, DATE, "sector")})
        some = expanded(some, True).join(_quotas(expanded(counts, True)), [DATE, "sector", "top_k"], "left")
        side = F.when(F.col("_us") <= F.col("quota"), "long").when(F.col("_ds") <= F.col("quota"), "short")
        # quotas take 2 K rows at most and the fill of longs K, so no fill reaches further than this
        some = some.withColumn("side", side).where(F.col("side").isNotNull() | (F.col("_u") <= 3 * F.col("top_k")) | (F.col("_d") <= 4 * F.col("top_k")))
        for name, down in (("long", True), ("short", False)):
            day = Window.partitionBy(DATE, "top_k")
            some = some.withColumns({"_lack": F.col("top_k") - F.sum(F.coalesce((F.col("side") == name).cast("int"), F.lit(0))).over(day), "_free": F.col("side").isNull()})
            some = some.withColumn("_p", _place(down, DATE, "top_k", "_free")).withColumn("side", F.when(F.col("_free") & (F.col("_p") <= F.col("_lack")), name).otherwise(F.col("side")))
        parts.append(some.withColumn("neutral", F.lit(True)).drop("_us", "_ds", "quota", "_lack", "_free", "_p"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where("side is not null").drop("_n", "_u", "_d")


def books(rows: DataFrame, top_k: int, neutral: bool = False) -> DataFrame:
    """The books of one kind (all_books), with side."""
    return all_books(rows, [(top_k, neutral)]).drop("top_k", "neutral")


def capped(cap, *keys):
    """For weights that sum to 1 in proportion to _score, none above ``cap`` (or above equal weights, if that is more): the largest
    are cut to the cap and the rest is shared by the others. Place, sum of scores from there on, and whether the cut can end here."""
    all_ = Window.partitionBy(*keys)
    most = F.greatest(cap, 1.0 / F.count(F.lit(1)).over(all_))
    ordered = all_.orderBy(F.desc("_score"), INSTRUMENT)
    k = F.row_number().over(ordered) - 1
    rest = F.sum("_score").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    scaled = F.col("_score") * (1 - k * most) / rest
    return F.struct(most.alias("most"), k.alias("k"), rest.alias("rest"), (scaled <= most + 1e-12).alias("ok"))


MODES = ("equal", "rank", "score", "score_vol")


def weighted(rows: DataFrame, modes, mode, cap, keys) -> DataFrame:
    """``rows`` of books with weight, by keys (which tell the sides apart): ``mode`` and ``cap`` are columns (a null cap: none, no
    column: none anywhere), ``modes`` those that occur."""
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    side = Window.partitionBy(*keys)
    rows = rows.withColumn("_x", F.when(F.col("side") == "long", F.col("predicted_y")).otherwise(-F.col("predicted_y")))
    score = F.col("_x") - F.min("_x").over(side) + 1e-12
    raw = F.lit(1.0)
    if "rank" in modes:
        raw = F.when(mode == "rank", (F.count(F.lit(1)).over(side) - F.row_number().over(side.orderBy(F.desc("_x"), INSTRUMENT)) + 1).cast("double")).otherwise(raw)
    if "score" in modes:
        raw = F.when(mode == "score", score).otherwise(raw)
    if "score_vol" in modes:
        raw = F.when(mode == "score_vol", score / F.greatest(F.coalesce("realized_vol_20", F.percentile("realized_vol_20", 0.5).over(side), F.lit(1.0)), F.lit(1e-6))).otherwise(raw)
    rows = rows.withColumn("_score", raw)
    weight, gone = F.col("_score") / F.sum("_score").over(side), ["_x", "_score"]
    if cap is not None:
        rows = rows.withColumn("_c", capped(cap, *keys))
        rows = rows.withColumn("_k", F.min(F.when(F.col("_c.ok"), F.col("_c.k"))).over(side)).withColumn("_rest", F.max(F.when(F.col("_c.k") == F.col("_k"), F.col("_c.rest"))).over(side))
        free = F.col("_score") * (1 - F.col("_k") * F.col("_c.most")) / F.col("_rest")
        cut = F.when(F.col("_k").isNull() | (F.col("_c.k") < F.col("_k")), F.col("_c.most")).otherwise(free)
        weight, gone = F.when(cap.isNull(), weight).otherwise(cut), [*gone, "_c", "_k", "_rest"]
    rows = rows.withColumn("weight", weight).drop(*gone)
    return rows.withColumn("weight", F.when(F.col("side") == "long", F.col("weight")).otherwise(-F.col("weight")))


def side_weights(rows: DataFrame, mode: str = "equal", cap: float | None = None) -> DataFrame:
    """``rows`` of books with weight: positive sums to 1 for longs, negative to -1 for shorts, on each date.

    equal; rank (n for the best down to 1); score (distance to the weakest score of the side); score_vol (score over
    realised volatility, missing ones as the side's median, 1e-6 at least)."""
    return weighted(rows, [mode], F.lit(mode), None if cap is None else F.lit(float(cap)), [DATE, "side"])


def trade_summary(weights: DataFrame, cfg: Config, by=(DATE,)) -> DataFrame:
    """By sleeve: turnover of entry and exit, exposures and costs of a round trip from cash, at full notional."""
    long, short = F.sum(F.greatest(F.col("weight"), F.lit(0.0))), F.sum(F.greatest(-F.col("weight"), F.lit(0.0)))
    out = weights.groupBy(*by).agg(long.alias("long_weight"), short.alias("short_weight"), F.sum("weight").alias("net_exposure"))
    gross = F.col("long_weight") + F.col("short_weight")
    out = out.withColumns({"gross_exposure": gross, "entry_turnover_cost": gross * cfg.cost_bps / 1e4, "exit_turnover_cost": gross * cfg.cost_bps / 1e4, "gross_turnover": 2 * gross, "net_turnover": 2 * F.abs("net_exposure"), "borrow_cost_estimate": F.col("short_weight") * cfg.borrow_bps / 1e4 * cfg.days / YEAR})
    return out.withColumns({"turnover_cost": F.col("entry_turnover_cost") + F.col("exit_turnover_cost"), "turnover_cost_bps": (F.col("entry_turnover_cost") + F.col("exit_turnover_cost")) * 1e4})


def weight_change(old: DataFrame, new: DataFrame, by=(DATE,)) -> DataFrame:
    """By key: long, short and gross turnover between two weight tables (key, instrument_id, weight)."""
    both = new.join(old.withColumnRenamed("weight", "_w"), [*by, INSTRUMENT], "full").fillna(0.0, ["weight", "_w"])
    part = lambda s: F.sum(F.abs(F.greatest(s * F.col("weight"), F.lit(0.0)) - F.greatest(s * F.col("_w"), F.lit(0.0))))
    return both.groupBy(*by).agg(part(1).alias("long_turnover"), part(-1).alias("short_turnover")).withColumn("gross_turnover", F.col("long_turnover") + F.col("short_turnover"))


def scale_to_portfolio(summary: DataFrame, cfg: Config, columns) -> DataFrame:
    """The columns at a sleeve's share of the capital, the former values as sleeve_*."""
    return summary.withColumns({f"sleeve_{x}": F.col(x) for x in columns}).withColumns({x: F.col(x) / cfg.sleeves for x in columns})


def sector_exposure(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """(date, sector, long_weight, short_weight_abs, net_sector_weight, universe_weight)."""
    share = universe.groupBy(DATE, "sector").agg(F.count("*").alias("_n")).withColumn("universe_weight", F.col("_n") / F.sum("_n").over(Window.partitionBy(DATE))).drop("_n")
    own = weights.groupBy(DATE, "sector").agg(F.sum(F.greatest(F.col("weight"), F.lit(0.0))).alias("long_weight"), F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short_weight_abs"))
    days = weights.select(DATE).distinct()
    out = share.join(days, DATE, "left_semi").join(own, [DATE, "sector"], "full").fillna(0.0)
    return out.withColumn("net_sector_weight", F.col("long_weight") - F.col("short_weight_abs")).withColumn("abs_net_sector_weight", F.abs("net_sector_weight"))


def settings(spark, configs: list[Config]) -> DataFrame:
    """A row for each configuration (cell: its place), as the plan of all needs it."""
    rows = [(i, c.step, c.delay, c.hold if c.clock == "signal_horizon" else c.hold + c.delay, c.days, c.sleeves, c.top_k, c.neutral, c.weights, None if c.cap is None else float(c.cap), 1.0 / c.sleeves, c.cost_bps / 1e4, c.borrow_bps / 1e4 / YEAR) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "cell int, step int, delay int, reach int, days int, slots int, top_k int, neutral boolean, mode string, cap double, _share double, _cost double, _borrow double")


def schedule(days: DataFrame, configs: DataFrame) -> DataFrame:
    """(cell, date, slot, execution_date, end_date, settings...) of each step-th date of each configuration whose holding window
    fits in the calendar ``days`` (date, t). As many rows as dates times configurations."""
    at = lambda k, name: F.broadcast(days.select(F.col("t").alias(k), F.col(DATE).alias(name)))
    spec = days.join(F.broadcast(configs), (F.col("t") - 1) % F.col("step") == 0)  # tables of dates and configurations
    spec = spec.withColumns({"_e": F.col("t") + F.col("delay"), "_z": F.col("t") + F.col("reach"), "slot": (F.floor((F.col("t") - 1) / F.col("step")) % F.col("slots")).cast("int")})
    return spec.join(at("_e", "execution_date"), "_e").join(at("_z", "end_date"), "_z").drop("_e", "_z", "t", "step", "delay", "reach", "slots")


def all_sleeves(rows: DataFrame, configs: list[Config]) -> DataFrame:
    """Target weights of all sleeves of all configurations: books ranked and picked once, expanded by the schedule."""
    days = stored(calendar.calendar(rows))
    spec = schedule(days, settings(rows.sparkSession, configs))
    picked = all_books(rows, sorted({(c.top_k, c.neutral) for c in configs})).join(F.broadcast(spec), [DATE, "top_k", "neutral"])
    cap = F.col("cap") if any(c.cap is not None for c in configs) else None
    return weighted(picked, {c.weights for c in configs}, F.col("mode"), cap, ["cell", DATE, "side"]).drop("top_k", "neutral", "mode", "cap")


def sleeves(rows: DataFrame, cfg: Config) -> DataFrame:
    """Target weights of all sleeves: the books of every step-th date of ``rows`` whose holding window fits, with slot,
    execution and end dates."""
    return all_sleeves(rows, [cfg]).drop("cell", "_share", "_cost", "_borrow")


def held_days(targets: DataFrame, market: DataFrame, by=()) -> DataFrame:
    """Each sleeve's names on each date of its window (after execution, up to the end) with returns, and complete: whether
    every name of the sleeve has all of them. ``by``: columns of the targets that tell their sleeves apart besides the
    signal date; they stay."""
    days = stored(calendar.calendar(market))
    at = days.select(F.col("t").alias("_t0"), F.col(DATE).alias("execution_date"))
    to = days.select(F.col("t").alias("_t1"), F.col(DATE).alias("end_date"))
    rows = targets.withColumnRenamed(DATE, "signal_date").select(*by, "signal_date", "slot", "execution_date", "end_date", "days", INSTRUMENT, "sector", "side", "weight")
    rows = rows.join(F.broadcast(at), "execution_date").join(F.broadcast(to), "end_date")
    rows = rows.withColumn("t", F.explode(F.sequence(F.col("_t0") + 1, F.col("_t1")))).join(F.broadcast(days), "t")
    rows = rows.join(market.select(DATE, INSTRUMENT, "daily_close_return"), [DATE, INSTRUMENT], "left")
    missing = F.max(F.col("daily_close_return").isNull()).over(Window.partitionBy(*by, "signal_date"))
    return rows.withColumn("complete", ~missing).drop("_t0", "_t1")


def skipped(held: DataFrame) -> DataFrame:
    """(signal_date, incomplete): sleeves that are skipped, with the names that lack a return."""
    lack = held.where("daily_close_return is null").groupBy("signal_date").agg(F.array_sort(F.collect_set(INSTRUMENT)).alias("incomplete"))
    return lack


def ledgers(rows: DataFrame, market: DataFrame, configs: list[Config]) -> DataFrame:
    """For each configuration (``cell``: its place in the list) the daily portfolio of all sleeves: returns of both sides,
    costs, exposures and net return of every market date from the first execution to the last end (dates in cash are
    zero), the equal-weight benchmark and both values. Rows are ranked once and the market is read once, whatever the number
    of configurations; books, weights, windows and costs are expanded from a table of them.

    Sleeves without a complete return path are skipped whole. Entry costs fall on the execution date, exit costs on
    the last, borrow costs on each date held."""
    targets = all_sleeves(rows, configs)
    cell = ["cell", "_share", "_cost", "_borrow"]
    held = held_days(targets, market, cell).where("complete")
    r, w = F.col("daily_close_return"), F.col("weight")
    key = [*cell, "signal_date", "execution_date", "end_date"]
    day = held.groupBy(*key, DATE).agg(
        F.sum(F.when(w > 0, w * r).otherwise(0.0)).alias("long_gross_return"), F.sum(F.when(w < 0, w * r).otherwise(0.0)).alias("short_gross_return"), F.sum(F.greatest(w, F.lit(0.0))).alias("long_exposure"), F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure_abs")
    )
    # the last date of a sleeve also stands for the date of its execution, when nothing is earned yet
    both = F.explode(F.when(F.col(DATE) == F.col("end_date"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    day = day.withColumn("_first", both).withColumn(DATE, F.when(F.col("_first"), F.col("execution_date")).otherwise(F.col(DATE)))
    day = day.withColumns({x: F.when(F.col("_first"), F.lit(0.0)).otherwise(F.col(x)) for x in ("long_gross_return", "short_gross_return")})
    cost = (F.col("long_exposure") + F.col("short_exposure_abs")) * F.col("_cost")
    entry, leave = F.when(F.col(DATE) == F.col("execution_date"), cost).otherwise(0.0), F.when(F.col(DATE) == F.col("end_date"), cost).otherwise(0.0)
    borrow = F.when(F.col(DATE) > F.col("execution_date"), F.col("short_exposure_abs") * F.col("_borrow")).otherwise(0.0)
    day = day.withColumns({"transaction_cost": entry + leave, "borrow_cost": borrow})
    names = ["long_gross_return", "short_gross_return", "transaction_cost", "borrow_cost", "long_exposure", "short_exposure_abs"]
    total = day.groupBy("cell", DATE).agg(*(F.sum(F.col(x) * F.col("_share")).alias(x) for x in names), F.min("execution_date").alias("_lo"), F.max("end_date").alias("_hi"))
    span = total.groupBy("cell").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    bench = market.groupBy(DATE).agg(F.coalesce(F.avg("daily_close_return"), F.lit(0.0)).alias("benchmark_return"))
    out = bench.join(F.broadcast(span), F.col(DATE).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # a row per configuration
    out = out.join(total.drop("_lo", "_hi"), ["cell", DATE], "left").fillna(0.0, names)
    out = out.withColumns({"gross_return": F.col("long_gross_return") + F.col("short_gross_return"), "gross_exposure": F.col("long_exposure") + F.col("short_exposure_abs"), "net_exposure": F.col("long_exposure") - F.col("short_exposure_abs")})
    return add_nav(out.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost") - F.col("borrow_cost")), ["cell"])


def ledger(rows: DataFrame, market: DataFrame, cfg: Config) -> DataFrame:
    """The ledger of one configuration."""
    return ledgers(rows, market, [cfg]).drop("cell")


def add_nav(days: DataFrame, by=()) -> DataFrame:
    """``days`` with nav, benchmark_nav and active_return. A row per date: the window is over dates only."""
    w = Window.partitionBy(*by).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumns({"nav": F.product(1 + F.col("net_return")).over(w), "benchmark_nav": F.product(1 + F.col("benchmark_return")).over(w), "active_return": F.col("net_return") - F.col("benchmark_return")})


def annualized(growth, days):
    return F.when(growth > 0, F.pow(growth, F.lit(float(YEAR)) / days) - 1)


def summarize(days: DataFrame, by=()) -> DataFrame:
    """Total and annual return, volatility, Sharpe and Calmar ratios, largest drawdown, hit ratios of days and months,
    mean exposures and costs."""
    w = Window.partitionBy(*by).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("_top", F.greatest(F.max("nav").over(w), F.lit(1.0))).withColumn("_dd", F.col("nav") / F.col("_top") - 1)
    r = F.col("net_return")
    n, dev = F.count("*"), F.stddev_samp(r)
    end = F.max_by("nav", DATE)
    growth = annualized(end, n)
    main = rows.groupBy(*by).agg(
        n.alias("n_days"), (end - 1).alias("total_return"), (F.max_by("benchmark_nav", DATE) - 1).alias("benchmark_return"), growth.alias("annual_return"), (dev * F.sqrt(F.lit(float(YEAR)))).alias("annual_volatility"),
        (F.avg(r) / F.when(dev > 1e-12, dev) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"), F.min("_dd").alias("max_drawdown"), (growth / F.when(F.abs(F.min("_dd")) > 1e-12, F.abs(F.min("_dd")))).alias("calmar"),
        F.avg((r > 0).cast("double")).alias("hit_ratio"), F.avg("gross_exposure").alias("gross_exposure"), F.avg("net_exposure").alias("net_exposure"), F.sum("transaction_cost").alias("transaction_cost"), F.sum("borrow_cost").alias("borrow_cost"),
    )
    month = rows.groupBy(*by, F.trunc(DATE, "month").alias("_m")).agg((F.product(1 + r) - 1).alias("_r"))
    month = month.groupBy(*by).agg(F.avg((F.col("_r") > 0).cast("double")).alias("month_hit_ratio"), F.min("_r").alias("worst_month"), F.max("_r").alias("best_month"), F.count("*").alias("n_months"))
    return main.join(month, [*by]) if by else main.join(F.broadcast(month))


def attribution(held: DataFrame, cfg: Config) -> DataFrame:
    """(instrument_id, contribution, share): each name's part of the gross return, and of the sum of their sizes."""
    own = held.where("complete").groupBy(INSTRUMENT).agg(F.sum(F.col("weight") * F.col("daily_close_return") / cfg.sleeves).alias("contribution"), F.countDistinct("signal_date").alias("sleeves"))
    total = own.agg(F.sum(F.abs("contribution")).alias("_all"))
    return own.join(F.broadcast(total)).withColumn("share", F.abs("contribution") / F.col("_all")).drop("_all")  # one row


def extreme_days(days: DataFrame, k: int = 5) -> DataFrame:
    """(date, net_return, kind, place) of the k best and worst dates."""
    rows = days.select(DATE, "net_return", F.row_number().over(Window.orderBy(F.desc("net_return"), DATE)).alias("_u"), F.row_number().over(Window.orderBy("net_return", DATE)).alias("_d"))
    best, worst = rows.where(F.col("_u") <= k), rows.where(F.col("_d") <= k)
    return best.select(DATE, "net_return", F.lit("best").alias("kind"), F.col("_u").alias("place")).union(worst.select(DATE, "net_return", F.lit("worst"), "_d"))


def grid(rows: DataFrame, market: DataFrame, configs: list[Config]) -> DataFrame:
    """A summary for each configuration, from one ledger of all."""
    about = [(i, c.hold, c.top_k, float(c.cost_bps), c.neutral, c.weights) for i, c in enumerate(configs)]
    names = rows.sparkSession.createDataFrame(about, "cell int, hold int, top_k int, cost_bps double, neutral boolean, weights string")
    return summarize(stored(ledgers(rows, market, configs)), ("cell",)).join(F.broadcast(names), "cell")  # a row per configuration


def best_configs(summary: DataFrame, k: int = 10, metrics=("sharpe", "calmar", "max_drawdown", "total_return")) -> DataFrame:
    """(metric, place, cell, value): the k best cells by each metric."""
    rows = summary.unpivot(["cell"], list(metrics), "metric", "value").where("value is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "cell"))).where(F.col("place") <= k)


def effective_cost_bps(base: float, slippage: float, commission: float, stamp: float) -> tuple[float, float]:
    """Buying and selling costs; selling also bears the stamp tax."""
    return base + slippage + commission, base + slippage + commission + stamp


def auto_cap(top_k: int) -> float:
    """A default cap: twice the equal weight, one at most."""
    return min(1.0, 2.0 / top_k)


# ---- long-only books ----


def _picked(rows: DataFrame, top_n: int, sector_tolerance: float | None) -> DataFrame:
    """``rows`` with scores, and _u, the place in which a date's book takes them (its first ``top_n`` are held), and _most, the names
    of the sector that it may hold: floor((share + tolerance) N), one at least; the rest is filled up from all others."""
    rows = rows.where("predicted_y is not null")
    if sector_tolerance is None:
        return rows.withColumns({"_u": _place(True, DATE), "_most": F.lit(None).cast("long")})
    n_s, n = F.count("*").over(Window.partitionBy(DATE, "sector")), F.count("*").over(Window.partitionBy(DATE))
    most = F.greatest(F.floor(F.round((n_s / n + sector_tolerance) * top_n, 9)), F.lit(1))
    rows = rows.withColumn("_most", most).withColumn("_over", _place(True, DATE, "sector") > F.col("_most"))
    return rows.withColumn("_u", F.row_number().over(Window.partitionBy(DATE).orderBy("_over", F.desc("predicted_y"), INSTRUMENT))).drop("_over")


def long_only(rows: DataFrame, top_n: int, mode: str = "equal", cap: float | None = None, sector_tolerance: float | None = None, size_limit: float | None = None) -> DataFrame:
    """(date, instrument_id, weight) of the highest scores; ``sector_tolerance`` bounds the names of a sector (_picked), and
    with ``size_limit`` names are swapped until the mean size exposure is within it (swap_towards_neutral_size)."""
    if size_limit is None:
        held = _picked(rows, top_n, sector_tolerance).where(F.col("_u") <= top_n).drop("_u", "_most")
    else:
        chosen = swap_towards_neutral_size(rows, top_n, size_limit, sector_tolerance).where("chosen").drop("chosen")
        held = rows.join(chosen, [DATE, INSTRUMENT], "left_semi")
    return side_weights(held.withColumn("side", F.lit("long")), mode, cap).drop("side")


#: Names not held that a swap considers, and the weight of lost score beside the exposure left.
REACH, LOSS = 80, 5.0


def _bound(x, f):
    """f of a column that is computed once though f uses it often."""
    return F.transform(F.array(x), f)[0]


def _after_swaps(held, up, down, limit: float, most: int):
    """Names held after at most ``most`` swaps, as an expression on one row per date: arrays of the names held and of those that any
    swap can reach, in both orders of size."""
    def swapped(state, gap):
        own = state["held"]
        n, far = F.size(own), F.abs(gap)
        free = F.filter(F.when(gap > 0, up).otherwise(down), lambda x: ~F.exists(own, lambda h: h["id"] == x["id"]))
        adds = F.transform(F.slice(free, 1, REACH), lambda x, i: F.struct(i.alias("i"), x.alias("name"), F.size(F.filter(own, lambda h: h["sector"] == x["sector"])).alias("there")))
        leaving = F.array_sort(F.transform(own, lambda h: F.struct(F.when(gap > 0, -h["z"]).otherwise(h["z"]).alias("k"), h["p"].alias("p"), h["id"].alias("id"), h.alias("name"))))

        def best_of(adds):
            def one(d, place):
                old = d["name"]
                left = lambda x: gap + (x["name"]["z"] - old["z"]) / n
                room = lambda x: F.coalesce(x["there"] + 1 - F.when(x["name"]["sector"] == old["sector"], 1).otherwise(0) <= x["name"]["most"], F.lit(True))
                able = F.filter(adds, lambda x: (F.abs(left(x)) < far - 1e-12) & room(x))
                loss = lambda x: F.greatest(old["p"] - x["name"]["p"], F.lit(0.0)) * LOSS
                return F.array_min(F.transform(able, lambda x: F.struct(F.round(F.abs(left(x)) + loss(x), 12).alias("cost"), place.alias("place"), x["i"].alias("i"), old["id"].alias("old"), x["name"].alias("new"))))

            return F.filter(F.transform(leaving, one), lambda x: x.isNotNull())

        def done(found):
            take = F.coalesce(F.get(F.filter(found, lambda x: x["cost"] < far), F.lit(0)), F.array_min(found))
            return _bound(take, lambda t: F.when(t.isNull(), F.struct(own.alias("held"), F.lit(False).alias("going"))).otherwise(F.struct(F.concat(F.filter(own, lambda h: h["id"] != t["old"]), F.array(t["new"])).alias("held"), F.lit(True).alias("going"))))

        return _bound(_bound(adds, best_of), done)

    def turn(state, _):
        gap = F.round(F.aggregate(state["held"], F.lit(0.0), lambda a, h: a + h["z"]) / F.size(state["held"]), 12)
        still = F.struct(state["held"].alias("held"), F.lit(False).alias("going"))
        return F.when(~state["going"], state).otherwise(_bound(gap, lambda g: F.when(F.abs(g) <= limit, still).otherwise(swapped(state, g))))

    start = F.struct(held.alias("held"), F.lit(True).alias("going"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, turn, lambda s: s["held"])


def swap_towards_neutral_size(rows: DataFrame, top_n: int, tolerance: float = 0.1, sector_tolerance: float | None = None, most: int = 50) -> DataFrame:
    """(date, instrument_id, chosen): a date's first ``top_n`` (_picked) after at most ``most`` swaps while their mean size exposure
    (missing: 0) is over ``tolerance``.

    Names held leave in the order of size, the far end and lower scores first; each is tried with the first REACH others from
    the near end (ties: higher score, then instrument) that lessen the exposure and have room in their sector, at the cost of the exposure left
    and LOSS times the score lost. The first name with a swap that costs less than the exposure makes it; if none has, the
    cheapest swap of all is made; without one the book stays.

    A swap takes one name away from either end, so none reaches further than REACH + ``most`` names from there: all dates
    advance on rows with arrays of that length, without shuffles between swaps and without Python."""
    names = _picked(rows, top_n, sector_tolerance)
    names = names.select(DATE, (F.col("_u") <= top_n).alias("_held"), F.struct(F.coalesce("size_exposure_z", F.lit(0.0)).cast("double").alias("z"), F.col("predicted_y").cast("double").alias("p"), F.col(INSTRUMENT).alias("id"), F.coalesce("sector", F.lit("")).alias("sector"), F.col("_most").cast("long").alias("most")).alias("name"))
    end = lambda down: F.row_number().over(Window.partitionBy(DATE, "_held").orderBy(F.desc("name.z") if down else F.col("name.z"), F.desc("name.p"), "name.id"))
    near = names.withColumns({"_lo": end(False), "_hi": end(True)}).where(F.col("_held") | (F.col("_lo") <= REACH + most) | (F.col("_hi") <= REACH + most))
    days = near.groupBy(DATE).agg(F.collect_list(F.when(F.col("_held"), F.col("name"))).alias("_own"), F.collect_list("name").alias("_all"))
    sorted_ = lambda sign: F.transform(F.array_sort(F.transform("_all", lambda x: F.struct((sign * x["z"]).alias("k"), (-x["p"]).alias("q"), x["id"].alias("id"), x.alias("name")))), lambda x: x["name"])
    days = days.withColumns({"_up": sorted_(1), "_down": sorted_(-1)})
    book = days.select(DATE, F.explode(F.transform(_after_swaps(F.col("_own"), F.col("_up"), F.col("_down"), tolerance, most), lambda x: x["id"])).alias(INSTRUMENT), F.lit(True).alias("chosen"))
    every = rows.where("predicted_y is not null").select(DATE, INSTRUMENT)
    return every.join(book, [DATE, INSTRUMENT], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def exposures(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """(date, size_exposure, universe_size, active_size, top_over, top_under): size only where 90 % of the date has it."""
    w = Window.partitionBy(DATE)
    u = universe.groupBy(DATE).agg(F.avg("size_exposure_z").alias("universe_size"), F.avg(F.col("size_exposure_z").isNotNull().cast("double")).alias("_cover"))
    own = weights.groupBy(DATE).agg((F.sum(F.col("weight") * F.col("size_exposure_z")) / F.sum(F.when(F.col("size_exposure_z").isNotNull(), F.col("weight")))).alias("size_exposure"))
    sector = sector_exposure(weights, universe).withColumn("active", F.col("net_sector_weight") - F.col("universe_weight"))
    order = F.struct("active", "sector")
    ends = sector.groupBy(DATE).agg(F.max_by("sector", order).alias("top_over"), F.min_by("sector", order).alias("top_under"))
    out = own.join(u, DATE).join(ends, DATE)
    size = F.when(F.col("_cover") >= 0.9, F.col("size_exposure"))
    return out.withColumn("size_exposure", size).withColumn("active_size", F.col("size_exposure") - F.col("universe_size")).drop("_cover")


def rebalance_costs(weights: DataFrame, slots: int, buy_bps: float, sell_bps: float) -> DataFrame:
    """(date, buy_turnover, sell_turnover, cost) of long-only weights against the same sleeve's former rebalance."""
    order = Window.orderBy(DATE)
    days = weights.select(DATE).distinct().withColumn("_i", F.row_number().over(order))
    rows = weights.join(days, DATE).select(DATE, "_i", INSTRUMENT, "weight")
    old = rows.select((F.col("_i") + slots).alias("_i"), INSTRUMENT, F.col("weight").alias("_w"))
    both = rows.select("_i", INSTRUMENT, "weight").join(old, ["_i", INSTRUMENT], "full").fillna(0.0, ["weight", "_w"])
    d = F.col("weight") - F.col("_w")
    out = both.groupBy("_i").agg(F.sum(F.greatest(d, F.lit(0.0))).alias("buy_turnover"), F.sum(F.greatest(-d, F.lit(0.0))).alias("sell_turnover")).join(days, "_i").drop("_i")
    return out.withColumn("cost", (F.col("buy_turnover") * buy_bps + F.col("sell_turnover") * sell_bps) / 1e4)


def long_only_sleeves(rows: DataFrame, market: DataFrame, cfg: Config, sector_tolerance: float | None = None, size_limit: float | None = None) -> DataFrame:
    """Target weights of long-only books of every step-th date of ``rows`` whose holding window fits in the market's calendar, with
    slot, execution and end dates; ``cfg`` gives names, weights and windows, the rest is that of long_only."""
    days = calendar.calendar(rows).where((F.col("t") - 1) % cfg.step == 0).withColumn("slot", (F.floor((F.col("t") - 1) / cfg.step) % cfg.sleeves).cast("int")).drop("t")
    windows = calendar.holding_windows(market, cfg.hold, cfg.delay, cfg.clock).withColumnRenamed("signal_date", DATE)
    spec = stored(days.join(windows, DATE))
    book = long_only(rows.join(F.broadcast(spec.select(DATE)), DATE, "left_semi"), cfg.top_k, cfg.weights, cfg.cap, sector_tolerance, size_limit)  # tables of dates
    return book.withColumn("side", F.lit("long")).join(F.broadcast(spec), DATE)


def long_only_ledger(rows: DataFrame, market: DataFrame, cfg: Config, buy_bps: float = 10.0, sell_bps: float = 10.0, sector_tolerance: float | None = None, size_limit: float | None = None) -> DataFrame:
    """The daily portfolio of overlapping long-only sleeves, on dates on which one of them earns: gross_return (the sum of the sleeves' own
    returns, not at their share of the capital), costs, net_return, benchmark, excess, both values, and the turnover and active size
    of the books that begin on the date (the last known size stays, 0 before the first).

    A sleeve pays for its change against the book before it in its slot, on its first date with a return; names without a
    return on a date earn nothing there."""
    targets = stored(long_only_sleeves(rows, market, cfg, sector_tolerance, size_limit))
    share = 1.0 / cfg.sleeves
    trades = rebalance_costs(targets.select(DATE, INSTRUMENT, "weight"), cfg.sleeves, buy_bps, sell_bps).withColumnRenamed(DATE, "signal_date")
    day = held_days(targets, market).where("daily_close_return is not null").groupBy("signal_date", DATE).agg(F.sum(F.col("weight") * F.col("daily_close_return")).alias("gross_return"))
    first = F.col(DATE) == F.min(DATE).over(Window.partitionBy("signal_date"))
    day = day.join(F.broadcast(trades), "signal_date")  # a row per rebalance
    day = day.withColumns({"buy_cost": F.when(first, F.col("buy_turnover") * share * buy_bps / 1e4).otherwise(0.0), "sell_cost": F.when(first, F.col("sell_turnover") * share * sell_bps / 1e4).otherwise(0.0)})
    day = day.withColumn("net_return", F.col("gross_return") * share - F.col("buy_cost") - F.col("sell_cost"))
    total = day.groupBy(DATE).agg(*(F.sum(x).alias(x) for x in ("gross_return", "buy_cost", "sell_cost", "net_return")))
    begun = targets.select(F.col(DATE).alias("signal_date"), "execution_date").distinct().join(trades, "signal_date")
    begun = begun.join(exposures(targets, rows).select(F.col(DATE).alias("signal_date"), "active_size"), "signal_date", "left")
    moved = ("turnover", "buy_turnover", "sell_turnover", "transaction_cost_bps")
    begun = begun.withColumns({"turnover": 0.5 * (F.col("buy_turnover") + F.col("sell_turnover")), "transaction_cost_bps": F.col("cost") * 1e4})
    begun = begun.groupBy(F.col("execution_date").alias(DATE)).agg(*(F.sum(F.col(x) * share).alias(x) for x in moved), F.avg("active_size").alias("active_size_exposure"))
    bench = market.groupBy(DATE).agg(F.coalesce(F.avg("daily_close_return"), F.lit(0.0)).alias("benchmark_return"))
    out = total.join(bench, DATE, "left").join(begun, DATE, "left").fillna(0.0, ["benchmark_return", *moved])
    far = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)  # a row per date
    out = out.withColumn("active_size_exposure", F.coalesce(F.last("active_size_exposure", ignorenulls=True).over(far), F.lit(0.0)))
    return add_nav(out).withColumnsRenamed({"nav": "portfolio_nav", "active_return": "excess_return"})


def sector_summary(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """(sector, average_portfolio_weight, average_universe_weight, average_active_weight, average_abs_active_weight) over the dates of
    the books."""
    own = sector_exposure(targets, rows).withColumn("active", F.col("net_sector_weight") - F.col("universe_weight"))
    return own.groupBy("sector").agg(F.avg("net_sector_weight").alias("average_portfolio_weight"), F.avg("universe_weight").alias("average_universe_weight"), F.avg("active").alias("average_active_weight"), F.avg(F.abs("active")).alias("average_abs_active_weight"))
