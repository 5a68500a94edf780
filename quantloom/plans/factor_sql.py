"""DuckDB SQL of factor expressions: the oracle of quantloom.functions.expression, written from the definitions (lists
for weighted and ranked frames, a fold for recursive smoothing)."""

from __future__ import annotations

from quantloom.functions.expression import Expr, _direct, columns_of, reads

from .testpanel import panel_sql, tidy_sql

_INFIX = {"+", "-", "*", "<", "<=", ">", ">="}


def _sql(e: Expr, names: dict[str, str]) -> str:
    if e.key in names:
        return names[e.key]
    if e.kind == "field":
        return e.n
    if e.kind == "number":
        return f"({e.n!r})::DOUBLE"
    x = [_sql(y, names) for y in e.args]
    if e.kind in _INFIX:
        return f"({x[0]} {e.kind} {x[1]})"
    return {
        "neg": lambda: f"(-{x[0]})",
        "/": lambda: f"({x[0]} / CASE WHEN abs({x[1]}) > 1e-8 THEN {x[1]} END)",
        "pow": lambda: f"(CASE WHEN isfinite(pow({x[0]}, {x[1]})) THEN pow({x[0]}, {x[1]}) END)",
        "==": lambda: f"({x[0]} = {x[1]})",
        "and": lambda: f"({x[0]} AND {x[1]})",
        "or": lambda: f"({x[0]} OR {x[1]})",
        "where": lambda: f"(CASE WHEN {x[0]} THEN {x[1]} ELSE {x[2]} END)",
        "abs": lambda: f"abs({x[0]})",
        "sign": lambda: f"sign({x[0]})::DOUBLE",
        "log": lambda: f"(CASE WHEN {x[0]} > 0 THEN ln({x[0]}) END)",
        "sqrt": lambda: f"(CASE WHEN {x[0]} >= 0 THEN sqrt({x[0]}) END)",
        "max2": lambda: f"(CASE WHEN {x[0]} IS NOT NULL AND {x[1]} IS NOT NULL THEN greatest({x[0]}, {x[1]}) END)",
        "min2": lambda: f"(CASE WHEN {x[0]} IS NOT NULL AND {x[1]} IS NOT NULL THEN least({x[0]}, {x[1]}) END)",
        "fill": lambda: f"coalesce({x[0]}, {x[1]})",
        "cliplow": lambda: f"(CASE WHEN {x[0]} IS NOT NULL THEN greatest({x[0]}, {x[1]}) END)",
        "tanh": lambda: f"tanh({x[0]})",
    }[e.kind]()


def _window(e: Expr, names: dict[str, str]) -> str:
    x = [_sql(y, names) for y in e.args]
    n = e.n
    every = "PARTITION BY instrument_id ORDER BY date"
    w = f"OVER ({every} ROWS BETWEEN {int(n) - 1 if isinstance(n, int) else 0} PRECEDING AND CURRENT ROW)"
    alone = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "min": "min", "max": "max"}
    if e.kind == "delay":
        return f"lag({x[0]}, {n}) OVER ({every})"
    if e.kind in alone:
        return f"{alone[e.kind]}({x[0]}) {w}"
    if e.kind == "prod":
        return f"CASE WHEN count({x[0]}) {w} = count(*) {w} THEN product({x[0]}) {w} END"
    group = f"PARTITION BY date, {n}" if e.kind in ("rank", "secmean") and n else "PARTITION BY date"
    if e.kind == "secmean":
        return f"avg({x[0]}) OVER ({group})"
    if e.kind == "cum":
        return f"CASE WHEN ({x[0]}) IS NOT NULL THEN sum({x[0]}) OVER ({every} ROWS UNBOUNDED PRECEDING) END"
    if e.kind == "rank":
        x = [f"(CASE WHEN abs({x[0]}) < 1e4 THEN round({x[0]}, 10) ELSE {x[0]} END)"]
        return f"CASE WHEN ({x[0]}) IS NOT NULL THEN (rank() OVER ({group}, ({x[0]}) IS NULL ORDER BY {x[0]}) + (count(*) OVER ({group}, {x[0]}) - 1) / 2) / count({x[0]}) OVER ({group}) END"
    if e.kind == "runcount":
        return f"count({x[0]}) OVER ({every} ROWS UNBOUNDED PRECEDING)::DOUBLE"
    a, b = (f"CASE WHEN ({x[1]}) IS NOT NULL THEN {x[0]} END", f"CASE WHEN ({x[0]}) IS NOT NULL THEN {x[1]} END") if len(x) > 1 else ("", "")
    if e.kind == "corr":
        sa, sb = f"stddev_pop({a}) {w}", f"stddev_pop({b}) {w}"
        return f"round(CASE WHEN count({a}) {w} >= 2 AND {sa} > 1e-9 * abs(avg({a}) {w}) AND {sb} > 1e-9 * abs(avg({b}) {w}) AND {sa} > 0 AND {sb} > 0 THEN covar_pop({a}, {b}) {w} / ({sa} * {sb}) END, 10)"
    if e.kind == "cov":
        return f"round(CASE WHEN count({a}) {w} >= 2 THEN covar_samp({a}, {b}) {w} END, 10)"
    if e.kind == "slope":
        return f"CASE WHEN count({x[0]}) {w} >= 2 THEN regr_slope({x[0]}, CASE WHEN ({x[0]}) IS NOT NULL THEN {x[1]} END) {w} END"
    raise KeyError(e.kind)


def _list(e: Expr, names: dict[str, str], col: str) -> str:
    """What is computed from the frame's list in column col."""
    n = e.n
    some = f"list_filter({col}, lambda z: z IS NOT NULL)"
    if e.kind == "tsrank":
        return f"CASE WHEN len({some}) > 0 THEN (len(list_filter({some}, lambda z: z < {some}[-1])) + (len(list_filter({some}, lambda z: z = {some}[-1])) + 1) / 2) / len({some}) END"
    if e.kind == "decay":
        return f"round(list_sum(list_transform({col}, lambda z, i: z * ({n} - len({col}) + i))) / nullif(list_sum(list_transform({col}, lambda z, i: CASE WHEN z IS NOT NULL THEN ({n} - len({col}) + i)::DOUBLE END)), 0), 10)"
    if e.kind == "mad":
        return f"list_avg(list_transform({some}, lambda z: abs(z - list_avg({some}))))"
    if e.kind in ("highday", "lowday"):
        f = "list_max" if e.kind == "highday" else "list_min"
        return f"CASE WHEN len({some}) > 0 THEN (len({col}) - list_position({col}, {f}({some})))::DOUBLE END"
    keep = f"(1 - {n!r}::DOUBLE)"
    return (
        f"(list_reduce(list_transform({col}, lambda z: {{'y': z, 'w': 1.0::DOUBLE}}), lambda p, q: CASE WHEN p.y IS NULL THEN {{'y': q.y, 'w': 1.0::DOUBLE}} "
        f"WHEN q.y IS NULL THEN {{'y': p.y, 'w': p.w * {keep}}} ELSE {{'y': (p.w * {keep} * p.y + {n!r}::DOUBLE * q.y) / (p.w * {keep} + {n!r}::DOUBLE), 'w': 1.0::DOUBLE}} END)).y"
    )


_LISTS = ("tsrank", "decay", "mad", "highday", "lowday", "smooth")


def ctes(factors: dict[str, Expr], source: str, keep=("instrument_id", "date")) -> str:
    """CTEs that end in ``factor_values``: keep and the factors over the CTE ``source``, whose columns are the fields."""
    need: dict[str, Expr] = {}
    for e in factors.values():
        columns_of(e, need)
    names = {key: f"w{i}" for i, key in enumerate(need)}
    parts, last = [], source
    for layer in range(1, max((e.layer for e in need.values()), default=0) + 1):
        now = {k: e for k, e in need.items() if e.layer == layer}
        done = {k: names[k] for k in names if need[k].layer < layer}
        cols, fold = [], []
        for k, e in now.items():
            if e.kind in _LISTS:
                frame = f"ROWS BETWEEN {e.n - 1} PRECEDING AND CURRENT ROW" if e.kind != "smooth" else "ROWS UNBOUNDED PRECEDING"
                cols.append(f"list(({_sql(e.args[0], done)})::DOUBLE) OVER (PARTITION BY instrument_id ORDER BY date {frame}) AS {names[k]}l")
                fold.append((names[k], _list(e, done, f"{names[k]}l")))
            else:
                cols.append(f"{_window(e, done)} AS {names[k]}")
        live = set().union(*(reads(e) for e in factors.values()), *(_direct(e) for e in need.values() if e.layer > layer))
        old = sorted(names[k] for k in live if need[k].layer < layer)
        fields = sorted(({f for e in factors.values() for f in _names(e)} | {e.n for e in need.values() if e.kind in ("rank", "secmean") and e.n}) - set(keep))
        base = ", ".join([*keep, *fields, *old])
        parts.append(f"a{layer} AS MATERIALIZED (SELECT {base}, {', '.join(cols)} FROM {last})")
        plain = [names[k] for k, e in now.items() if e.kind not in _LISTS]
        parts.append(f"b{layer} AS MATERIALIZED (SELECT {', '.join([base, *plain, *(f'{f} AS {n}' for n, f in fold)])} FROM a{layer})")
        last = f"b{layer}"
    out = ", ".join(f"CASE WHEN isfinite({_sql(e, names)}::DOUBLE) THEN {_sql(e, names)}::DOUBLE END AS {f}" for f, e in factors.items())
    parts.append(f"factor_values AS MATERIALIZED (SELECT {', '.join(keep)}, {out} FROM {last})")
    return ",\n".join(parts)


def _names(e: Expr) -> set[str]:
    return {e.n} if e.kind == "field" else {x for y in e.args for x in _names(y)}


PREPARED = """prepared AS MATERIALIZED (
  SELECT *, (close - prev_close) / CASE WHEN abs(prev_close) > 1e-8 THEN prev_close END AS ret FROM (
    SELECT *, turnover AS amount, (high + low + close) / 3 AS hlc3, lag(close) OVER w AS prev_close, lag(open) OVER w AS prev_open, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low
    FROM panel WINDOW w AS (PARTITION BY instrument_id ORDER BY date)))"""


def factor_query(factors: dict[str, Expr], every: str = "month") -> str:
    out = ", ".join(f"{tidy_sql(f)} AS {f}" for f in factors)
    return f"WITH {panel_sql(every=every)},\n{PREPARED},\n{ctes(factors, 'prepared')}\nSELECT instrument_id, date, {out} FROM factor_values"
