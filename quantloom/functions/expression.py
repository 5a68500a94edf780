"""Factor formulas as expressions over panel columns, evaluated in phases: all windows along instruments that need no further
ranks, then all ranks within dates that those allow, and so on. Rows move twice a phase, whatever the number and depth of
the formulas; a factor is made as soon as its windows are there, so that only it and no part of it moves on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C
from .recursive import smooth


class Expr:
    """kind: a field, a number, a row-wise function, or a window that becomes a column of its own."""

    def __init__(self, kind: str, *args, n=None):
        self.kind, self.n = kind, n
        self.args = tuple(a if isinstance(a, Expr) else Expr("number", n=float(a)) for a in args)
        self.key = f"{kind}:{n}({','.join(a.key for a in self.args)})"
        below = max((a.layer for a in self.args), default=0)
        self.layer = below + (kind in WINDOWS)
        phase = max((a.phase for a in self.args), default=(0, False))
        # (phase, across?): windows along rows that read ranks are in the next phase
        self.phase = (phase[0], True) if kind in ACROSS else (phase[0] + phase[1], False) if kind in WINDOWS else phase

    def __neg__(self):
        return Expr("neg", self)


def _op(name, kind, swap=False):
    def f(self, other):
        return Expr(kind, other, self) if swap else Expr(kind, self, other)

    setattr(Expr, name, f)


for _n, _k in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/"), ("pow", "pow")):
    _op(f"__{_n}__", _k)
    _op(f"__r{_n}__", _k, swap=True)
for _n, _k in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("and", "and"), ("or", "or")):
    _op(f"__{_n}__", _k)

#: Windows of one input along an instrument's rows.
ALONG = {"delay": C.delay, "mean": C.rolling_mean, "sum": C.rolling_sum, "std": C.rolling_std, "min": C.rolling_min, "max": C.rolling_max, "prod": C.rolling_prod, "tsrank": C.ts_rank, "mad": C.mean_abs_dev, "highday": lambda x, n: C.since_extreme(x, n, True), "lowday": lambda x, n: C.since_extreme(x, n, False)}
PAIRS = {"corr": C.rolling_corr, "cov": C.rolling_cov, "slope": C.slope}
ACROSS = ("rank", "secmean")
WINDOWS = {*ALONG, *PAIRS, *ACROSS, "decay", "runcount", "cum", "smooth"}
ROWWISE = {
    "neg": lambda a: -a, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": C.safe_divide, "pow": C.power,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b,
    "where": lambda k, a, b: F.when(k, a).otherwise(b), "abs": F.abs, "sign": F.signum, "log": C.log, "sqrt": C.sqrt,
    "max2": C.larger, "min2": C.smaller, "fill": lambda a, b: F.coalesce(a, b), "cliplow": lambda a, b: F.when(a.isNotNull(), F.greatest(a, b)),
    "tanh": F.tanh,
}

o, h, l, c, v, w, r, a, pc, po, ph, pl, tp = (Expr("field", n=x) for x in ("open", "high", "low", "close", "volume", "vwap", "ret", "amount", "prev_close", "prev_open", "prev_high", "prev_low", "hlc3"))  # noqa: E741


def field(name):
    return Expr("field", n=name)


def _along(kind):
    return lambda x, n: Expr(kind, x, n=n)


delay, mean, total, std, low_of, high_of, prod, ts_rank, mad, since_high, since_low = map(_along, ("delay", "mean", "sum", "std", "min", "max", "prod", "tsrank", "mad", "highday", "lowday"))


def delta(x, n=1):
    return x - delay(x, n)


def corr(x, y, n):
    return Expr("corr", x, y, n=n)


def cov(x, y, n):
    return Expr("cov", x, y, n=n)


def slope(x, n):
    return Expr("slope", x, Expr("runcount", x), n=n)


def decay(x, n):
    return Expr("decay", x, n=n)


def rank(x):
    return Expr("rank", x)


def rank_in(x, column):
    """Rank within date and another column."""
    return Expr("rank", x, n=column)


def section_mean(x, column=None):
    """Mean over the instruments of a date, or of a date and another column."""
    return Expr("secmean", x, n=column)


def cum(x):
    """Running sum of an instrument's rows; null rows add nothing and stay null."""
    return Expr("cum", x)


def sma(x, n, m=1):
    """(m x + (n - m) y before) / n."""
    return Expr("smooth", x, n=m / n)


def where(k, x, y):
    return Expr("where", k, x, y)


def equal(x, y):
    return Expr("==", x, y)


def max2(x, y):
    return Expr("max2", x, y)


def min2(x, y):
    return Expr("min2", x, y)


def fill(x, y=0.0):
    return Expr("fill", x, y)


def clip_low(x, y):
    return Expr("cliplow", x, y)


def absolute(x):
    return Expr("abs", x)


def sign(x):
    return Expr("sign", x)


def log(x):
    return Expr("log", x)


def sqrt(x):
    return Expr("sqrt", x)


def tanh(x):
    return Expr("tanh", x)


def count_if(k, n):
    return total(where(k, 1.0, 0.0), n)


def columns_of(expr: Expr, found: dict[str, Expr] | None = None) -> dict[str, Expr]:
    """The window columns that an expression needs, by key."""
    found = {} if found is None else found
    for x in expr.args:
        columns_of(x, found)
    if expr.kind in WINDOWS:
        found.setdefault(expr.key, expr)
    return found


def _column(e: Expr, names: dict[str, str]) -> Column:
    if e.key in names:
        return F.col(names[e.key])
    if e.kind == "field":
        return F.col(e.n)
    if e.kind == "number":
        return F.lit(e.n)
    return ROWWISE[e.kind](*(_column(x, names) for x in e.args))


def _window(e: Expr, names: dict[str, str]) -> Column:
    x = [_column(y, names) for y in e.args]
    if e.kind in ALONG:
        return ALONG[e.kind](x[0], e.n)
    if e.kind in PAIRS:
        return PAIRS[e.kind](*x, e.n)
    if e.kind == "decay":
        return C.decay_linear(x[0], e.n, F.col("_t"))
    if e.kind == "runcount":
        return C.running_count(x[0])
    return F.when(x[0].isNotNull(), F.sum(x[0]).over(C.history()))


def _across(e: Expr, name: str) -> Column:
    more = (e.n,) if e.n else ()
    return C.pct_rank(C.snap(F.col(name)), *more) if e.kind == "rank" else F.avg(name).over(C.section(*more))


def evaluate(panel: DataFrame, factors: dict[str, Expr], keep=(C.INSTRUMENT, C.DATE)) -> DataFrame:
    """``keep`` and a column for each factor. panel holds the fields. Each phase: the windows along instruments and the smoothed
    columns, layer by layer, all on one partitioning, then the ranks within dates on another; columns that nothing needs
    any more are dropped, and finished factors take the place of their parts."""
    need: dict[str, Expr] = {}
    for e in factors.values():
        columns_of(e, need)
    names = {key: f"_w{i}" for i, key in enumerate(need)}
    fields = {x for e in factors.values() for x in _fields(e)}
    fields |= {e.n for e in need.values() if e.kind in ACROSS and e.n}
    df = panel.select(*keep, *sorted(fields - set(keep))).withColumn("_t", F.row_number().over(C.order()))
    done: dict[str, str] = {}
    ready: dict[str, str] = {}
    for step in sorted({(*e.phase, e.layer) for e in need.values()}):
        now = {k: e for k, e in need.items() if (*e.phase, e.layer) == step}
        waiting = {k for f, e in factors.items() if f not in ready for k in reads(e)} | {k for x, e in need.items() if x not in done for k in _direct(e)}
        live = [names[k] for k in done if k in waiting]
        base = [*keep, *sorted(fields - set(keep)), "_t", *live, *ready.values()]
        along = [(k, e) for k, e in now.items() if e.kind not in (*ACROSS, "smooth")]
        if along:
            df = df.select(*base, *(_window(e, done).alias(names[k]) for k, e in along))
            base += [names[k] for k, _ in along]
        if again := [(k, e) for k, e in now.items() if e.kind == "smooth"]:
            df = df.select(*base, *(_column(e.args[0], done).cast("double").alias(f"{names[k]}i") for k, e in again))
            df = smooth(df, {names[k]: (f"{names[k]}i", e.n) for k, e in again}).drop(*(f"{names[k]}i" for k, _ in again))
            base += [names[k] for k, _ in again]
        if across := [(k, e) for k, e in now.items() if e.kind in ACROSS]:
            df = df.select(*base, *(_column(e.args[0], done).alias(f"{names[k]}i") for k, e in across))
            df = df.select(*base, *(_across(e, f"{names[k]}i").alias(names[k]) for k, e in across))
            base += [names[k] for k, _ in across]
        done |= {k: names[k] for k in now}
        if found := {f: f"_x{i}" for i, (f, e) in enumerate(factors.items()) if f not in ready and reads(e) and reads(e) <= set(done)}:
            df = df.select(*base, *(_column(factors[f], done).cast("double").alias(x) for f, x in found.items()))
            ready |= found
    return df.select(*keep, *(C.finite(F.col(ready[f]) if f in ready else _column(e, names).cast("double")).alias(f) for f, e in factors.items()))


def _fields(e: Expr) -> set[str]:
    return {e.n} if e.kind == "field" else {x for y in e.args for x in _fields(y)}


def reads(e: Expr) -> set[str]:
    """The window columns that a factor's own value is made from."""
    return {e.key} if e.kind in WINDOWS else _direct(e)


def _direct(e: Expr) -> set[str]:
    """The window columns read by an expression's own row-wise part."""
    out: set[str] = set()
    for x in e.args if e.kind in WINDOWS else (e,):
        stack = [x]
        while stack:
            y = stack.pop()
            if y.kind in WINDOWS:
                out.add(y.key)
            else:
                stack += y.args
    return out
