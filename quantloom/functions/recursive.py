"""Recursive smoothing per instrument: y = a x + (1 - a) y before, as exponentially weighted means without adjustment.

Each row is an affine step of y. A history is cut into blocks of rows; a block's steps make one step, the steps of the blocks
before it give the value at its start, and its own rows are finished from there. No group holds a whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import INSTRUMENT, order

#: Rows to a block. The steps of earlier blocks are listed for each block: (rows / BLOCK)**2 / 2 of them an instrument.
BLOCK = 64


def _steps(column: str, alpha: float):
    """(factor, addend) of each row's step: null where the input is; the first value starts; a value after k rows without one
    weakens the last by (1 - alpha)**(k + 1)."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x), x)
    before = F.last(F.when(x.isNotNull(), F.col("_n")), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1))
    old = F.pow(F.lit(1 - alpha), F.col("_n") - before)
    factor, share = F.when(before.isNull(), 0.0).otherwise(old / (old + alpha)), F.when(before.isNull(), 1.0).otherwise(alpha / (old + alpha))
    return F.when(x.isNotNull(), factor), share * x


def smooth(df: DataFrame, columns: dict[str, tuple[str, float]], block: int | None = None) -> DataFrame:
    """``df`` with columns name -> (input column, alpha), all in one pass over blocks of each instrument's rows.

    The first value starts; null inputs carry the last value on and weaken its weight by (1 - alpha) for each row. Rows of one
    instrument and date are taken in any order."""
    names = list(columns)
    rows = df.withColumn("_n", F.row_number().over(order()))
    steps = {}
    for i, (source, alpha) in enumerate(columns.values()):
        steps[f"_f{i}"], steps[f"_a{i}"] = _steps(source, alpha)
    rows = rows.withColumns(steps).withColumn("_b", F.floor((F.col("_n") - 1) / (block or BLOCK)))
    blocks = rows.groupBy(INSTRUMENT, "_b").agg(F.array_sort(F.collect_list(F.struct("_n", *(c for c in rows.columns if c not in ("_n", "_b", INSTRUMENT))))).alias("_r"))
    start, none = F.lit(None).cast("double"), F.lit(None).cast("double")

    def step(i):
        """A run of steps (null: none) and one step more."""

        def more(acc, r):
            factor, addend = r[f"_f{i}"], r[f"_a{i}"]
            return F.when(factor.isNull(), acc).otherwise(F.struct((F.coalesce(acc["f"], F.lit(1.0)) * factor).alias("f"), (F.coalesce(acc["a"], F.lit(0.0)) * factor + addend).alias("a")))

        return more

    empty = F.struct(none.alias("f"), none.alias("a"))
    whole = F.struct(*(F.aggregate("_r", empty, step(i)).alias(f"s{i}") for i in range(len(names))))
    blocks = blocks.withColumn("_s", whole)
    earlier = Window.partitionBy(INSTRUMENT).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_e", F.collect_list("_s").over(earlier))

    def moved(y, factor, addend):
        return F.when(factor.isNull(), y).otherwise(F.coalesce(y, F.lit(0.0)) * factor + addend)

    over = lambda i: lambda y, s: moved(y, s[f"s{i}"]["f"], s[f"s{i}"]["a"])
    first = {f"y{i}": F.aggregate("_e", start, over(i)) for i in range(len(names))}
    value = "struct<" + ",".join(f"y{i}:double" for i in range(len(names))) + ">"
    zero = F.struct(F.struct(*(x.alias(k) for k, x in first.items())).alias("y"), F.array().cast(f"array<{value}>").alias("out"))

    def finished(acc, r):
        y = F.struct(*(moved(acc["y"][f"y{i}"], r[f"_f{i}"], r[f"_a{i}"]).alias(f"y{i}") for i in range(len(names))))
        return F.struct(y.alias("y"), F.array_append(acc["out"], y).alias("out"))

    done = blocks.select(INSTRUMENT, "_r", F.aggregate("_r", zero, finished, lambda acc: acc["out"]).alias("_y"))
    out = done.select(INSTRUMENT, F.explode(F.arrays_zip("_r", "_y")).alias("z"))
    # the group's own key goes on, so that rows stay dealt by instrument and the next window does not move them
    return out.select(*(F.col(INSTRUMENT if c == INSTRUMENT else f"z._r.{c}").alias(c) for c in df.columns), *(F.col(f"z._y.y{i}").alias(name) for i, name in enumerate(names)))
