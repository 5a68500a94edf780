"""The formulaic factor library: 176 factors of published formulas over one panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.expression import (  # noqa: F401
    Expr, a, absolute, c, clip_low, corr, count_if, cov, decay, delay, delta, equal, evaluate, fill, h, high_of, l, log, low_of, mad, max2, mean, min2, o, pc, ph, pl, po, r, rank, sign, since_high, since_low, slope, sma, sqrt, std, total, tp, ts_rank, v, w, where,
)

# ---- shared parts ----
UP, DOWN, NOT_UP = c > pc, c < pc, c <= pc
GAIN, LOSS = where(UP, c - pc, 0.0), where(DOWN, absolute(c - pc), 0.0)
SPREAD = ((c - l) - (h - c)) / (h - l)
MOVED = where(equal(c, pc), 0.0, c - where(UP, min2(l, pc), max2(h, pc)))
SIGNED = fill(sign(c - pc)) * v
RANGE = max2(max2(h - l, absolute(h - pc)), absolute(l - pc))
TREND = max2(absolute(h - ph), absolute(l - pl))
TREND_DOWN = total(where(h + l >= ph + pl, 0.0, TREND), 12)
TREND_UP = total(where(h + l <= ph + pl, 0.0, TREND), 12)
RISE, FALL = h - ph, pl - l
DTM, DBM = total(where(o <= po, 0.0, max2(h - o, o - po)), 20), total(where(o >= po, 0.0, max2(o - l, o - po)), 20)
MID = (h + l) / 2
DRIFT = ((h + l) - (ph + pl)) / 2 * (h - l) / v


def rsi(x, n):
    d = x - delay(x, 1)
    return sma(max2(d, 0.0), n) / sma(absolute(d), n) * 100


def rsv(n):
    return (c - low_of(l, n)) / (high_of(h, n) - low_of(l, n)) * 100


def place(n):
    return (high_of(h, 6) - c) / (high_of(h, 6) - low_of(l, 6)) * 100 if n is None else sma((high_of(h, 6) - c) / (high_of(h, 6) - low_of(l, 6)) * 100, n)


def _directional():
    span = total(RANGE, 14)
    down = total(where((FALL > 0) & (FALL > RISE), FALL, 0.0), 14) * 100 / span
    up = total(where((RISE > 0) & (RISE > FALL), RISE, 0.0), 14) * 100 / span
    return mean(absolute(down - up) / (down + up) * 100, 6)


def _part(n, k):
    return (c - total(min2(l, pc), n)) / total(max2(h, pc) - min2(l, pc), n) * k


def _lead(x, m, n, k):
    return sma(mean(x, m) - mean(x, n), k)


def _macd(x):
    d = sma(x, 13, 2) - sma(x, 27, 2)
    return d, sma(d, 10, 2)


def _library() -> dict[int, Expr]:
    f: dict[int, Expr] = {}
    f[1] = -corr(rank(delta(log(where(v > 1, v, where(v <= 1, 1.0, v))), 1)), rank((c - o) / o), 6)
    f[2] = -delta(SPREAD, 1)
    f[3] = total(MOVED, 6)
    m8, s8 = mean(c, 8), std(c, 8)
    f[4] = where(m8 + s8 < mean(c, 2), -1.0, where(mean(c, 2) < m8 - s8, 1.0, where(v / mean(v, 20) >= 1, 1.0, -1.0)))
    f[5] = -high_of(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3)
    f[6] = -rank(sign(delta(o * 0.85 + h * 0.15, 4)))
    f[7] = (rank(high_of(w - c, 3)) + rank(low_of(w - c, 3))) * rank(delta(v, 3))
    f[8] = rank(-delta(MID * 0.2 + w * 0.8, 4))
    f[9] = sma(DRIFT, 7, 2)
    f[10] = rank(high_of(where(r < 0, std(r, 20), c) ** 2, 5))
    f[11] = total(SPREAD * v, 6)
    f[12] = -rank(o - mean(w, 10)) * rank(absolute(c - w))
    f[13] = sqrt(h * l) - w
    f[14] = delta(c, 5)
    f[15] = o / pc - 1
    f[16] = -high_of(rank(corr(rank(v), rank(w), 5)), 5)
    f[17] = clip_low(rank(w - high_of(w, 15)), 1e-6) ** fill(delta(c, 5))
    f[18] = c / delay(c, 5)
    d5 = delay(c, 5)
    f[19] = where(c < d5, (c - d5) / d5, where(equal(c, d5), 0.0, (c - d5) / c))
    f[20] = delta(c, 6) / delay(c, 6) * 100
    f[21] = slope(mean(c, 6), 6)
    gap6 = (c - mean(c, 6)) / mean(c, 6)
    f[22] = sma(gap6 - delay(gap6, 3), 12)
    s20 = fill(std(c, 20))
    up23, down23 = sma(where(UP, s20, 0.0), 20), sma(where(NOT_UP, s20, 0.0), 20)
    f[23] = up23 / (up23 + down23) * 100
    f[24] = sma(delta(c, 5), 5)
    f[25] = -rank(delta(c, 7) * (1 - rank(decay(v / mean(v, 20), 9)))) * (1 + rank(total(r, 250)))
    f[26] = mean(c, 7) - c + corr(w, delay(c, 5), 230)
    f[27] = decay(delta(c, 3) / delay(c, 3) * 100 + delta(c, 6) / delay(c, 6) * 100, 12)
    f[28] = sma(rsv(9), 3) * 3 - sma(sma(rsv(9), 3), 3) * 2
    f[29] = delta(c, 6) / delay(c, 6) * v
    f[31] = (c - mean(c, 12)) / mean(c, 12) * 100
    f[32] = -total(rank(corr(rank(h), rank(v), 3)), 3)
    low5 = low_of(l, 5)
    f[33] = (delay(low5, 5) - low5) * rank((total(r, 240) - total(r, 20)) / 220) * ts_rank(v, 5)
    f[34] = mean(c, 12) / c
    f[35] = -min2(rank(decay(delta(o, 1), 15)), rank(decay(corr(v, o, 17), 7)))
    both37 = total(o, 5) * total(r, 5)
    f[37] = -rank(both37 - delay(both37, 10))
    f[38] = where(mean(h, 20) < h, -delta(h, 2), 0.0)
    f[39] = -(rank(decay(delta(c, 2), 8)) - rank(decay(corr(w * 0.3 + o * 0.7, total(mean(v, 180), 37), 14), 12)))
    f[40] = total(where(UP, v, 0.0), 26) / total(where(NOT_UP, v, 0.0), 26) * 100
    f[41] = -rank(high_of(delta(w, 3), 5))
    f[42] = -rank(std(h, 10)) * corr(h, v, 10)
    f[43] = total(SIGNED, 6)
    f[44] = ts_rank(decay(corr(l, mean(v, 10), 7), 6), 4) + ts_rank(decay(delta(w, 3), 10), 15)
    f[45] = rank(delta(c * 0.6 + o * 0.4, 1)) * rank(corr(w, mean(v, 150), 15))
    f[46] = (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / (c * 4)
    f[47] = place(9)
    steps = sign(c - pc) + sign(pc - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3))
    f[48] = -(rank(steps) * total(v, 5)) / total(v, 20)
    f[49] = TREND_DOWN / (TREND_DOWN + TREND_UP)
    f[50] = TREND_UP / (TREND_UP + TREND_DOWN) - TREND_DOWN / (TREND_DOWN + TREND_UP)
    f[51] = TREND_UP / (TREND_UP + TREND_DOWN)
    before = delay(tp, 1)
    f[52] = total(max2(h - before, 0.0), 26) / total(max2(before - l, 0.0), 26) * 100
    f[53] = count_if(UP, 12) / 12 * 100
    f[54] = -rank(std(absolute(c - o), 10) + (c - o) + corr(c, o, 10))
    f[57] = sma(rsv(9), 3)
    f[58] = count_if(UP, 20) / 20 * 100
    f[59] = total(MOVED, 20)
    f[60] = total(SPREAD * v, 20)
    f[61] = -max2(rank(decay(delta(w, 1), 12)), rank(decay(rank(corr(l, mean(v, 80), 8)), 17)))
    f[62] = -corr(h, rank(v), 5)
    f[63] = rsi(c, 6)
    f[64] = -max2(rank(decay(corr(rank(w), rank(v), 4), 4)), rank(decay(high_of(corr(rank(c), rank(mean(v, 60)), 4), 13), 14)))
    f[65] = mean(c, 6) / c
    f[66] = gap6 * 100
    f[67] = rsi(c, 24)
    f[68] = sma(DRIFT, 15, 2)
    f[69] = where(DTM > DBM, (DTM - DBM) / DTM, where(equal(DTM, DBM), 0.0, (DTM - DBM) / DBM))
    f[70] = std(a, 6)
    f[71] = (c - mean(c, 24)) / mean(c, 24) * 100
    f[72] = place(15)
    f[73] = -(ts_rank(decay(decay(corr(c, v, 10), 16), 4), 5) - rank(decay(corr(w, mean(v, 30), 4), 3)))
    f[74] = rank(corr(total(l * 0.35 + w * 0.65, 20), total(mean(v, 40), 20), 7)) + rank(corr(rank(w), rank(v), 6))
    each76 = absolute(r) / v
    f[76] = std(each76, 20) / mean(each76, 20)
    f[77] = min2(rank(decay(MID - w, 20)), rank(decay(corr(MID, mean(v, 40), 3), 6)))
    f[78] = (tp - mean(tp, 12)) / (mean(absolute(c - mean(tp, 12)), 12) * 0.015)
    f[79] = rsi(c, 12)
    f[80] = delta(v, 5) / delay(v, 5) * 100
    f[81] = sma(v, 21, 2)
    f[82] = place(20)
    f[83] = -rank(cov(rank(h), rank(v), 5))
    f[84] = total(SIGNED, 20)
    f[85] = ts_rank(v / mean(v, 20), 20) * ts_rank(-delta(c, 7), 8)
    bend = (delay(c, 20) - delay(c, 10)) / 10 - (delay(c, 10) - c) / 10
    f[86] = where(bend > 0.25, -1.0, where(bend < 0, 1.0, -delta(c, 1)))
    f[87] = -(rank(decay(delta(w, 4), 7)) + ts_rank(decay((l - w) / (o - MID), 11), 7))
    f[88] = delta(c, 20) / delay(c, 20) * 100
    dif, dea = _macd(c)
    f[89] = (dif - dea) * 2
    f[90] = -rank(corr(rank(w), rank(v), 5))
    f[91] = -(rank(c - high_of(c, 5)) * rank(corr(mean(v, 40), l, 5)))
    f[92] = -max2(rank(decay(delta(c * 0.35 + w * 0.65, 2), 3)), ts_rank(decay(absolute(corr(mean(v, 180), c, 13)), 5), 15))
    f[93] = DBM
    f[94] = total(SIGNED, 30)
    f[95] = std(a, 20)
    f[96] = sma(sma(rsv(9), 3), 3)
    f[97] = std(v, 10)
    f[98] = where(delta(mean(c, 100), 100) / delay(c, 100) <= 0.05, -(c - low_of(c, 100)), -delta(c, 3))
    f[99] = -rank(cov(rank(c), rank(v), 5))
    f[100] = std(v, 20)
    f[101] = where(rank(corr(c, total(mean(v, 30), 37), 15)) < rank(corr(rank(h * 0.1 + w * 0.9), rank(v), 11)), -1.0, 0.0)
    f[102] = rsi(v, 6)
    f[103] = (20 - since_low(l, 20)) / 20 * 100
    f[104] = -(delta(corr(h, v, 5), 5) * rank(std(c, 20)))
    f[105] = -corr(rank(o), rank(v), 10)
    f[106] = delta(c, 20)
    f[107] = -rank(o - ph) * rank(o - pc) * rank(o - pl)
    f[108] = -(clip_low(rank(h - low_of(h, 2)), 1e-6) ** rank(corr(w, mean(v, 120), 6)))
    span = sma(h - l, 10, 2)
    f[109] = span / sma(span, 10, 2)
    f[110] = total(max2(h - pc, 0.0), 20) / total(max2(pc - l, 0.0), 20) * 100
    flow = v * ((c - l) - (h - c)) / (h - l)
    f[111] = sma(flow, 11, 2) - sma(flow, 4, 2)
    f[112] = (total(GAIN, 12) - total(LOSS, 12)) / (total(GAIN, 12) + total(LOSS, 12)) * 100
    f[113] = -(rank(mean(delay(c, 5), 20)) * corr(c, v, 2) * rank(corr(total(c, 5), total(c, 20), 2)))
    wide = (h - l) / mean(c, 5)
    f[114] = rank(delay(wide, 2)) * rank(rank(v)) / (wide / (w - c))
    f[115] = clip_low(rank(corr(h * 0.9 + c * 0.1, mean(v, 30), 10)), 1e-6) ** rank(corr(ts_rank(MID, 4), ts_rank(v, 10), 7))
    f[116] = slope(c, 20)
    f[117] = ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(r, 32))
    f[118] = total(h - o, 20) / total(o - l, 20) * 100
    f[119] = rank(decay(corr(w, total(mean(v, 5), 26), 5), 7)) - rank(decay(ts_rank(low_of(corr(rank(o), rank(mean(v, 15)), 21), 9), 7), 8))
    f[120] = rank(w - c) / rank(w + c)
    f[121] = -(clip_low(rank(w - low_of(w, 12)), 1e-6) ** ts_rank(corr(ts_rank(w, 20), ts_rank(mean(v, 60), 2), 18), 3))
    three = sma(sma(sma(log(where(c > 1e-8, c, 1e-8)), 13, 2), 13, 2), 13, 2)
    f[122] = (three - delay(three, 1)) / delay(three, 1)
    f[123] = where(rank(corr(total(MID, 20), total(mean(v, 60), 20), 9)) < rank(corr(l, v, 6)), -1.0, 0.0)
    f[124] = (c - w) / decay(rank(high_of(c, 30)), 2)
    f[125] = rank(decay(corr(w, mean(v, 80), 17), 20)) / rank(decay(delta((c + w) * 0.5, 3), 16))
    f[126] = (c + h + l) / 3
    under = (c - high_of(c, 12)) / high_of(c, 12) * 100
    f[127] = sqrt(mean(under**2, 12))
    more, less = total(where(tp > before, tp * v, 0.0), 14), total(where(tp < before, tp * v, 0.0), 14)
    f[128] = 100 - 100 / (1 + more / less)
    f[129] = total(LOSS, 12)
    f[130] = rank(decay(corr(MID, mean(v, 40), 9), 10)) / rank(decay(corr(rank(w), rank(v), 7), 3))
    f[131] = clip_low(rank(delta(w, 1)), 1e-6) ** ts_rank(corr(c, mean(v, 50), 18), 18)
    f[132] = mean(a, 20)
    f[133] = (20 - since_high(h, 20)) / 20 * 100 - (20 - since_low(l, 20)) / 20 * 100
    f[134] = delta(c, 12) / delay(c, 12) * v
    f[135] = sma(delay(c / delay(c, 20), 1), 20)
    f[136] = -rank(delta(r, 3)) * corr(o, v, 10)
    f[138] = -(rank(decay(delta(l * 0.7 + w * 0.3, 3), 20)) - ts_rank(decay(ts_rank(corr(ts_rank(l, 8), ts_rank(mean(v, 60), 17), 5), 19), 16), 7))
    f[139] = -corr(o, v, 10)
    f[140] = min2(rank(decay(rank(o) + rank(l) - rank(h) - rank(c), 8)), ts_rank(decay(corr(ts_rank(c, 8), ts_rank(mean(v, 60), 20), 8), 7), 3))
    f[141] = -rank(corr(rank(h), rank(mean(v, 15)), 9))
    f[142] = -rank(ts_rank(c, 10)) * rank(delta(delta(c, 1), 1)) * rank(ts_rank(v / mean(v, 20), 5))
    f[144] = total(where(DOWN, absolute(r) / a, 0.0), 20) / count_if(DOWN, 20)
    f[145] = (mean(v, 9) - mean(v, 26)) / mean(v, 12) * 100
    rest = r - sma(r, 61, 2)
    f[146] = mean(rest, 20) * rest / sma((r - rest) ** 2, 60)
    f[147] = slope(mean(c, 12), 12)
    f[148] = where(rank(corr(o, total(mean(v, 60), 9), 6)) < rank(o - low_of(o, 14)), -1.0, 0.0)
    f[150] = tp * v
    f[151] = sma(delta(c, 20), 20)
    f[152] = _lead(delay(sma(delay(c / delay(c, 9), 1), 9), 1), 12, 26, 9)
    f[153] = (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4
    f[154] = where(w - low_of(w, 16) < corr(w, mean(v, 180), 18), 1.0, 0.0)
    dif_v, dea_v = _macd(v)
    f[155] = dif_v - dea_v
    blend = o * 0.15 + l * 0.85
    f[156] = -max2(rank(decay(delta(w, 5), 3)), rank(decay(-delta(blend, 2) / blend, 3)))
    f[158] = ((h - sma(c, 15, 2)) - (l - sma(c, 15, 2))) / c
    f[159] = (_part(6, 288) + _part(12, 144) + _part(24, 144)) * 100 / 504
    f[160] = sma(where(NOT_UP, std(c, 20), 0.0), 20)
    f[161] = mean(RANGE, 12)
    strength = rsi(c, 12)
    f[162] = (strength - low_of(strength, 12)) / (high_of(strength, 12) - low_of(strength, 12))
    f[163] = rank(-r * mean(v, 20) * w * (h - c))
    inverse = where(UP, 1 / (c - pc), 1.0)
    f[164] = sma((inverse - low_of(inverse, 12)) / (h - l) * 100, 13, 2)
    f[167] = total(GAIN, 12)
    f[168] = -v / mean(v, 20)
    f[169] = _lead(delay(sma(c - pc, 9), 1), 12, 26, 10)
    f[170] = rank(1 / c) * v / mean(v, 20) * (h * rank(h - c)) / (total(h, 5) / 5) - rank(w - delay(w, 5))
    f[171] = -((l - c) * o**5) / ((c - h) * c**5)
    f[172] = _directional()
    f[173] = sma(c, 13, 2) * 3 - sma(sma(c, 13, 2), 13, 2) * 2 + sma(sma(sma(log(c), 13, 2), 13, 2), 13, 2)
    f[174] = sma(where(UP, std(c, 20), 0.0), 20)
    f[175] = mean(RANGE, 6)
    f[176] = corr(rank((c - low_of(l, 12)) / (high_of(h, 12) - low_of(l, 12))), rank(v), 6)
    f[177] = (20 - since_high(h, 20)) / 20 * 100
    f[178] = (c - pc) / pc * v
    f[179] = rank(corr(w, v, 4)) * rank(corr(rank(l), rank(mean(v, 50)), 12))
    f[180] = where(mean(v, 20) < v, -ts_rank(absolute(delta(c, 7)), 60) * sign(delta(c, 7)), -v)
    f[184] = rank(corr(delay(o - c, 1), c, 200)) + rank(o - c)
    f[185] = rank(-((1 - o / c) ** 2))
    f[186] = (f[172] + delay(f[172], 6)) / 2
    f[187] = DTM
    f[188] = (h - l - sma(h - l, 11, 2)) / sma(h - l, 11, 2) * 100
    f[189] = mean(absolute(c - mean(c, 6)), 6)
    f[191] = corr(mean(v, 20), l, 5) + MID - c
    return f


FACTORS = {f"alpha{k:03d}": e for k, e in _library().items()}
#: Factors that do not change when all prices of an instrument are multiplied by one number.
CANONICAL = tuple(f"alpha{k:03d}" for k in (1, 2, 4, 5, 6, 15, 18, 19, 20, 22, 23))


def prepare(panel: DataFrame) -> DataFrame:
    """The panel with ret, amount, the previous row's prices and hlc3."""
    before = {f"prev_{x}": C.delay(F.col(x)) for x in ("close", "open", "high", "low")}
    df = panel.withColumns({**before, "amount": F.col("turnover"), "hlc3": (F.col("high") + F.col("low") + F.col("close")) / 3})
    return df.withColumn("ret", C.safe_divide(F.col("close") - F.col("prev_close"), F.col("prev_close")))


def factors(panel: DataFrame, names=None) -> DataFrame:
    """instrument_id, date and the factors of ``names`` (None: all, []: none); unknown names raise. Non-finite is null."""
    names = list(FACTORS) if names is None else list(names)
    if unknown := [x for x in names if x not in FACTORS]:
        raise ValueError(f"no such factors: {unknown}")
    if not names:
        return panel.select(C.INSTRUMENT, C.DATE)
    return evaluate(prepare(panel), {x: FACTORS[x] for x in names})


def catalogue(spark) -> DataFrame:
    """(factor, number, layers, canonical) of all factors."""
    rows = [(k, int(k[5:]), e.layer, k in CANONICAL) for k, e in FACTORS.items()]
    return spark.createDataFrame(rows, "factor string, number int, layers int, canonical boolean")
