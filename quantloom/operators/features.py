"""Technical, context and market-state features of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.expression import (
    Expr, absolute, c, cum, delay, evaluate, field, h, high_of, l, log, low_of, max2, mean, min2, o, pc, rank, rank_in, section_mean, sma, std, total, tp, v, w, where,
)

from .factors import prepare

RET = log(c / pc)
TURNOVER, CAP = field("turnover"), field("market_cap")
#: Names that no model may use as a feature: labels, future values and corporate-action factors.
FORBIDDEN = ("y", "next_open", "adjustment", "market_cap_source", "predicted_y")
FORBIDDEN_PREFIXES = ("y_", "future_", "next_", "target_")
#: Optional columns by family.
FUNDAMENTAL = ("eps", "pe", "pb", "ps", "roe", "roa", "yoy", "qoq")


def ema(x, span):
    return sma(x, span + 1, 2)


def base_features() -> dict[str, Expr]:
    rate = TURNOVER / CAP
    f = {"price_range": (h - l) / c, "price_position": (c - l) / (h - l), "vwap_gap": (c - w) / w, "turnover_rate_proxy": rate}
    for n in (5, 10, 20):
        f |= {f"return_std_{n}": std(RET, n), f"momentum_{n}": c / delay(c, n) - 1, f"close_to_ma_{n}": (c - mean(c, n)) / mean(c, n), f"volume_to_ma_{n}": (v - mean(v, n)) / mean(v, n)}
    return f | {"volume_rank": rank(v), "turnover_rank": rank(TURNOVER), "market_cap_rank": rank(CAP), "turnover_rate_rank": rank(rate)}


def advanced_features() -> dict[str, Expr]:
    f = {"amt_ratio_20": TURNOVER / mean(TURNOVER, 20), "amt_range_20": (high_of(TURNOVER, 20) - low_of(TURNOVER, 20)) / mean(TURNOVER, 20)}
    dif = ema(c, 12) - ema(c, 26)
    dea = ema(dif, 9)
    f |= {"macd_dif_pct": dif / c, "macd_dea_pct": dea / c, "macd_hist_pct": (dif - dea) * 2 / c}
    dma = mean(c, 10) - mean(c, 50)
    f |= {"dma_10_50_pct": dma / c, "dma_signal_10_pct": mean(dma, 10) / c, "volatility_20": std(RET, 20)}
    for n in (6, 14):
        up, down = mean(max2(c - pc, 0.0), n), mean(max2(pc - c, 0.0), n)
        f[f"rsi_{n}"] = 100 - 100 / (1 + up / down)
    f["wr_14"] = (high_of(h, 14) - c) / (high_of(h, 14) - low_of(l, 14)) * -100
    rsv = (c - low_of(l, 9)) / (high_of(h, 9) - low_of(l, 9)) * 100
    k = sma(rsv, 3)
    d = sma(k, 3)
    f |= {"rsv_9": rsv, "kdj_k_9": k, "kdj_d_9": d, "kdj_j_9": k * 3 - d * 2}
    bought, span = c - min2(l, pc), max2(h, pc) - min2(l, pc)
    part = {n: total(bought, n) / total(span, n) for n in (7, 14, 28)}
    f["uos_7_14_28"] = (part[7] * 4 + part[14] * 2 + part[28]) * 100 / 7
    mid, dev = mean(c, 20), std(c, 20)
    f |= {"boll_width_20": (mid + dev * 2 - (mid - dev * 2)) / mid, "boll_zscore_20": (c - mid) / dev}
    levels = {"wr": tp * 2 - l, "mr": tp + (h - l), "sr": h * 2 - l, "ws": tp * 2 - h, "ms": tp - (h - l), "ss": l * 2 - h}
    f |= {f"mike_{k}_to_close": x / c - 1 for k, x in levels.items()}
    up, low = high_of(h, 20), low_of(l, 20)
    f |= {"xschannel_width_20": (up - low) / c, "xschannel_pos_20": (c - low) / (up - low)}
    obv = cum(where(c > pc, v, where(c < pc, -v, 0.0)))
    return f | {"obv_ratio_20": obv / absolute(mean(obv, 20))}


def sector_features() -> dict[str, Expr]:
    base = base_features()
    market, sector = section_mean(RET), section_mean(RET, "sector")
    f = {"sector_equal_weight_return_1d": sector, "stock_excess_market_return_1d": RET - market, "stock_excess_sector_return_1d": RET - sector, "sector_excess_market_return_1d": sector - market}
    f |= {f"sector_relative_{x}": base[x] - section_mean(base[x], "sector") for x in ("momentum_20", "return_std_20", "volume_to_ma_20", "turnover_rate_proxy")}
    return f | {"sector_volume_rank": rank_in(v, "sector"), "sector_market_cap_rank": rank_in(CAP, "sector")}


FAMILIES = {"base": base_features(), "advanced": advanced_features(), "sector_context": sector_features()}


def technical(panel: DataFrame, families=("base", "advanced", "sector_context")) -> DataFrame:
    """instrument_id, date, sector and the features of the families."""
    found = {k: e for name in families for k, e in FAMILIES[name].items()}
    keep = (C.INSTRUMENT, C.DATE, "sector") if "sector_context" in families else (C.INSTRUMENT, C.DATE)
    return evaluate(prepare(panel), found, keep)


def fundamental_context(df: DataFrame) -> DataFrame:
    """``df`` with value, profitability and growth columns from those of pe, eps, pb, ps, roe, roa, yoy, qoq that are
    there, and the percentile ranks within dates of these and of the raw ones."""
    has = lambda x: x in df.columns
    one, new = F.lit(1.0), {}
    if has("pe"):
        new["earnings_yield"] = C.safe_divide(one, F.col("pe"))
    elif has("eps"):
        new["earnings_yield"] = C.safe_divide(F.col("eps"), F.col("close"))
    if has("pb"):
        new["book_to_price"] = C.safe_divide(one, F.col("pb"))
    if has("ps"):
        new["sales_to_price"] = C.safe_divide(one, F.col("ps"))
    for name, parts in (("profitability_combo", ("roe", "roa")), ("growth_combo", ("yoy", "qoq"))):
        if parts := [F.col(x) for x in parts if has(x)]:
            there = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in parts), F.lit(0))
            new[name] = sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0)) / F.when(there > 0, there)
    df = df.withColumns(new) if new else df
    ranked = [*new, *(x for x in FUNDAMENTAL if has(x))]
    return df.withColumns({f"{x}_rank": C.pct_rank(F.col(x)) for x in ranked}) if ranked else df


def date_level(df: DataFrame, column: str) -> DataFrame:
    """(date, column): the mean over the instruments of each date."""
    return df.groupBy(C.DATE).agg(F.avg(column).alias(column))


def _dates(n: int):
    return Window.orderBy(C.DATE).rowsBetween(1 - n, 0)


def market_state(panel: DataFrame) -> DataFrame:
    """One row per date: market return, volatility and its regime, dispersion, breadth. Window functions run over the
    dates only, a small table however many instruments there are."""
    ret = panel.select(C.INSTRUMENT, C.DATE, C.log(C.safe_divide(F.col("close"), C.delay(F.col("close")))).alias("r"))
    day = ret.groupBy(C.DATE).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("market_cross_sectional_dispersion"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("market_breadth"))

    def rolled(f, x, n, least):
        return F.when(F.count(x).over(_dates(n)) >= least, f(x).over(_dates(n)))

    day = day.select("*", rolled(F.sum, "m", 5, 2).alias("market_return_5d"), rolled(F.sum, "m", 20, 5).alias("market_return_20d"), rolled(F.stddev_samp, "m", 20, 5).alias("market_volatility_20d"))
    vol = "market_volatility_20d"
    middle = F.when(F.count(vol).over(_dates(252)) >= 20, F.percentile(vol, 0.5).over(_dates(252)))
    regime = F.coalesce((F.col(vol) > middle).cast("double"), F.lit(0.0)).alias("market_high_vol_regime")
    return day.select(C.DATE, "market_return_5d", "market_return_20d", vol, regime, "market_cross_sectional_dispersion", "market_breadth")


def macro_context(macro: DataFrame, columns) -> DataFrame:
    """(date, ...): each column carried forward, its change over 5 dates and its 252-date z-score (20 dates at least)."""
    filled = macro.select(C.DATE, *(F.last(x, ignorenulls=True).over(Window.orderBy(C.DATE).rowsBetween(Window.unboundedPreceding, 0)).alias(x) for x in columns))
    out = []
    for x in columns:
        w, name = _dates(252), f"macro_{x}"
        enough = F.count(x).over(w) >= 20
        z = C.safe_divide(F.col(x) - F.when(enough, F.avg(x).over(w)), F.when(enough, F.stddev_samp(x).over(w)))
        out += [F.col(x).alias(name), (F.col(x) - F.lag(x, 5).over(Window.orderBy(C.DATE))).alias(f"{name}_change_5d"), z.alias(f"{name}_zscore_252d")]
    return filled.select(C.DATE, *out)


def broadcast_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """``panel`` with the columns of a table of dates: a row for each date, so it is small."""
    return panel.join(F.broadcast(dates) if dates.count() <= 100_000 else dates, C.DATE, "left")


def check_allowed(columns) -> None:
    """Raises if a name is a label, a future value or an adjustment."""
    bad = [x for x in columns if x in FORBIDDEN or x.startswith(FORBIDDEN_PREFIXES)]
    if bad:
        raise ValueError(f"not allowed as features: {bad}")


def safe_columns(df: DataFrame) -> list[str]:
    """Numeric columns that may be features."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [k for k, t in df.dtypes if t in numeric and k not in FORBIDDEN and not k.startswith(FORBIDDEN_PREFIXES) and k != C.INSTRUMENT]


def family_of(name: str) -> str:
    if name.startswith("alpha") and name[5:].isdigit():
        return "formulaic"
    for family, found in FAMILIES.items():
        if name in found:
            return family
    if name.startswith("macro_"):
        return "macro_context"
    if name.startswith("market_"):
        return "market_state"
    return "fundamental_context" if name.removesuffix("_rank") in (*FUNDAMENTAL, "earnings_yield", "book_to_price", "sales_to_price", "profitability_combo", "growth_combo") else "raw"


def subset(names, mode: str, family: str | None = None) -> list[str]:
    """all, technical_only, alpha_only, technical_plus_family (with family) or technical_plus_all."""
    kinds = {x: family_of(x) for x in names}
    if mode in ("all", "technical_plus_all"):
        return list(names)
    if mode == "technical_only":
        return [x for x in names if kinds[x] != "formulaic"]
    if mode == "alpha_only":
        return [x for x in names if kinds[x] == "formulaic"]
    if mode == "technical_plus_family":
        return [x for x in names if kinds[x] != "formulaic" or family is None or alpha_family(x) == family]
    raise ValueError(mode)


def alpha_family(name: str) -> str:
    """The layers of its formula name a factor's family: price shape, window, section or mixed."""
    from quantloom.functions.expression import columns_of

    from .factors import FACTORS

    kinds = {e.kind for e in columns_of(FACTORS[name]).values()}
    if not kinds:
        return "shape"
    if "rank" in kinds:
        return "section" if kinds == {"rank"} else "mixed"
    return "smoothed" if "smooth" in kinds else "window"
