"""Recursive smoothing by blocks against whole histories, and renormalised linear decay."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.recursive import smooth

SCHEMA = "instrument_id long, date date, x double, z double, keep string"


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(5):
        for t in range(int(rng.integers(1, 40)) if i else 150):
            rows.append((i, date(2020, 1, 1) + timedelta(days=t), float(rng.normal() * 10 + 1e3), float(rng.normal()), f"k{t}"))
    f = pd.DataFrame(rows, columns=["instrument_id", "date", "x", "z", "keep"])
    f.loc[rng.random(len(f)) < 0.3, "x"] = None  # gaps, some of them first or last
    f.loc[f.instrument_id == 3, "z"] = None
    return f


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_blocks_give_the_values_of_whole_histories(spark, frame, block):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = smooth(df, {"a": ("x", 0.3), "b": ("x", 2 / 13), "c": ("z", 1.0)}, block)
    assert out.columns == [*df.columns, "a", "b", "c"]
    got = out.toPandas().sort_values(["instrument_id", "date"]).reset_index(drop=True)
    want = frame.sort_values(["instrument_id", "date"]).reset_index(drop=True)
    assert got[["instrument_id", "date", "keep"]].equals(want[["instrument_id", "date", "keep"]])
    for name, source, alpha in (("a", "x", 0.3), ("b", "x", 2 / 13), ("c", "z", 1.0)):
        mean = want.groupby("instrument_id")[source].transform(lambda s, alpha=alpha: s.ewm(alpha=alpha, adjust=False).mean())
        assert np.allclose(got[name].to_numpy(float), mean.to_numpy(float), rtol=1e-12, atol=1e-12, equal_nan=True)


def test_no_group_of_a_whole_history_goes_to_python(spark, frame):
    df = spark.createDataFrame([(1, date(2020, 1, 1), 1.0, 2.0, "k")], SCHEMA)
    plan = smooth(df, {"a": ("x", 0.3)})._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan
    assert smooth(df.where("x > 5"), {"a": ("x", 0.3)}).collect() == []


def test_decay_weights_are_renormalised_over_gaps(spark):
    rows = [(1, date(2020, 1, 1 + t), x) for t, x in enumerate([1.0, None, 3.0])]
    df = spark.createDataFrame(rows, "instrument_id long, date date, x double").withColumn("_t", F.row_number().over(C.order()))
    got = df.select("date", C.decay_linear(F.col("x"), 3, F.col("_t")).alias("d")).orderBy("date").collect()
    assert got[2].d == pytest.approx(2.5)
