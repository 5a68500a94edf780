"""Each stage of the pipeline on odd tables: nulls, empty and very long texts, repeated rows, no rows, clashing columns."""

import random

import pytest

import corpus_pipeline
from quantloom.functions import tables
from quantloom.llm import common

NAMES = ["_score", "score", "_n", "n", "n_dropped", "_bitmap", "bitmap", "_row", "row", "_key", "doc", "_id", "_epoch", "block", "_block", "order_key", "_order_key", "_source", "epoch"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in NAMES)


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, *(f"{x}!" for x in NAMES)) for i, t, s in rows], DOCS)


ITEM = " ".join(f"item{i}" for i in range(30))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stage tables"))
    rng = random.Random(3)
    said = lambda bad: " ".join(rng.choice(["one", "two", "three", "four"]) + ("!!" if bad else "") for _ in range(30))
    rows = [(i, said(i % 2), "s") for i in range(200)]
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def odd(rows):
    """(rows, what a stage may drop is known of these)"""
    return rows + [(1000, None, "s"), (1001, "", None), (1002, "w " * 60_000, "s"), (None, "one two three", "s"), (None, None, None), (1003, "one two three four five six", "t"), (1003, "one two three four five six", "t"), (1004, f"a {ITEM} b", "s"), (None, f"c {ITEM}", "s")]


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_tables(spark, sf, k):
    folder, plain = sf
    name, stage = corpus_pipeline.STAGES[k]
    docs = make(spark, odd(plain))
    got = stage(spark, docs, folder)
    assert got.columns[: len(docs.columns)] == docs.columns and (k == 4 or got.columns == docs.columns)
    rows = got.collect()
    assert all(r[x] == f"{x}!" for r in rows for x in NAMES)  # clashing columns come through
    left = [(r.doc_id, r.text) for r in rows]
    whole = [(i, t) for i, t, _ in odd(plain)]
    if k == 0:
        assert {i for i, _ in left if i is not None and i < 200} == set(range(0, 200, 2))
        kept = {x for x in left if x[0] is None or x[0] >= 1000}
        assert all(left.count(x) == whole.count(x) for x in kept)  # rows alike go or stay together
    elif k == 1:
        assert sorted((i or -1, t or "") for i, t in left) == sorted((i or -1, t or "") for i, t in whole)  # no line is in ten documents
    elif k == 2:
        assert left.count((1003, "one two three four five six")) == 1
        assert {(1000, None), (1001, ""), (None, None)} <= set(left)
    elif k == 3:
        assert sorted((i or -1, t or "") for i, t in left) == sorted((i or -1, t or "") for i, t in whole if ITEM not in (t or ""))
    else:
        assert set(left) <= set(whole) and {"__epoch", "__block", "__order_key"} <= set(got.columns)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns[: len(docs.columns)] == docs.columns and empty.count() == 0


def test_lines_of_ten_documents_go_from_odd_tables(spark, sf):
    rows = [(i, f"own {i}\n Shared line\t", "s") for i in range(9)] + [(9, "shared LINE", "s"), (None, "x\nshared line", "s"), (None, None, "s")]
    got = corpus_pipeline.drop_common_lines(spark, make(spark, rows), sf[0]).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(i or -1, f"own {i}") for i in range(9)] + [(9, ""), (-1, "x"), (-1, "")])


def test_names_that_cannot_clash(spark):
    df = make(spark, [])
    assert common.fresh(df, "_Score", "new", "n") == ["__Score", "new", "__n"]


def test_released_tables_are_deleted(spark):
    import os

    with common.released(spark):
        df = common.durable(spark.range(5))
        path = tables._written[-1]
        assert df.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
