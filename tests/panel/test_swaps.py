"""Books with swaps towards neutral size against plain loops over the names of each date."""

import random
from datetime import date, timedelta

import pytest

from quantloom.operators import portfolio


def made(seed, days=14, names=60, lean=1.0):
    rng = random.Random(seed)
    rows = []
    for t in range(days):
        for i in range(names if t else 5):
            z = round(rng.gauss(0, 1), 2)
            p = round(lean * z * rng.choice([1, 1, 0.2, -0.5]) + rng.gauss(0, 0.5), 2)
            rows.append((date(2021, 1, 1) + timedelta(days=t), i, p if rng.random() > 0.05 else None, z if rng.random() > 0.05 else None, rng.choice(["x", "x", "x", "y", "z"]) if rng.random() > 0.03 else None))
    return rows


def picked(day, top, tolerance):
    """Held names in order, and the number of names that each sector may have."""
    day = sorted(day, key=lambda r: (-r["p"], r["id"]))
    if tolerance is None:
        return day[:top], None
    caps = {}
    for sector in {r["sector"] for r in day}:
        share = sum(r["sector"] == sector for r in day) / len(day)
        caps[sector] = max(1, int((share + tolerance) * top + 1e-9))
    held, count = [], {}
    for r in day:
        if len(held) < top and count.get(r["sector"], 0) < caps[r["sector"]]:
            held.append(r)
            count[r["sector"]] = count.get(r["sector"], 0) + 1
    held += [r for r in day if r not in held][: top - len(held)]
    return held, caps


def swapped(day, top, limit, tolerance, most=50):
    held, caps = picked(day, top, tolerance)
    for _ in range(most):
        gap = sum(r["z"] for r in held) / len(held)
        if abs(gap) <= limit:
            break
        sign = 1 if gap > 0 else -1
        leaving = sorted(held, key=lambda r: (-sign * r["z"], r["p"], r["id"]))
        free = sorted((r for r in day if r not in held), key=lambda r: (sign * r["z"], -r["p"], r["id"]))[:80]
        best = None
        for old in leaving:
            for new in free:
                if caps is not None and sum(r["sector"] == new["sector"] for r in held if r is not old) + 1 > caps[new["sector"]]:
                    continue
                then = gap + (new["z"] - old["z"]) / len(held)
                if abs(then) >= abs(gap) - 1e-12:
                    continue
                cost = round(abs(then) + max(old["p"] - new["p"], 0) * 5, 12)
                if best is None or cost < best[0]:
                    best = (cost, old, new)
            if best is not None and best[0] < abs(gap):
                break
        if best is None:
            break
        held = [r for r in held if r is not best[1]] + [best[2]]
    return {r["id"] for r in held}


@pytest.mark.parametrize("seed,names,top,limit,tolerance,most", [(1, 60, 8, 0.05, None, 50), (2, 60, 12, 0.02, 0.1, 50), (3, 260, 10, 0.0, 0.05, 6), (4, 40, 30, 0.1, 0.0, 50)])
def test_against_loops(spark, seed, names, top, limit, tolerance, most):
    rows = made(seed, names=names)
    df = spark.createDataFrame(rows, "date date, instrument_id long, predicted_y double, size_exposure_z double, sector string").repartition(3)
    got = {}
    for r in portfolio.swap_towards_neutral_size(df, top, limit, tolerance, most).collect():
        own = got.setdefault(r.date, (set(), set()))
        own[0].add(r.instrument_id)
        if r.chosen:
            own[1].add(r.instrument_id)
    moved = 0
    for d in {r[0] for r in rows}:
        day = [{"id": r[1], "p": r[2], "z": r[3] or 0.0, "sector": r[4] or ""} for r in rows if r[0] == d and r[2] is not None]
        want = swapped(day, top, limit, tolerance, most)
        assert got[d] == ({r["id"] for r in day}, want), d
        moved += want != {r["id"] for r in picked(day, top, tolerance)[0]}
    assert moved > 3


def test_weights_of_swapped_books(spark):
    df = spark.createDataFrame(made(5), "date date, instrument_id long, predicted_y double, size_exposure_z double, sector string")
    swaps = {(r.date, r.instrument_id) for r in portfolio.swap_towards_neutral_size(df, 8, 0.1, 0.1).where("chosen").collect()}
    weights = portfolio.long_only(df, 8, "rank", sector_tolerance=0.1, size_limit=0.1).collect()
    assert {(w.date, w.instrument_id) for w in weights} == swaps
    empty = portfolio.swap_towards_neutral_size(df.limit(0), 8)
    assert empty.columns == ["date", "instrument_id", "chosen"] and empty.count() == 0
