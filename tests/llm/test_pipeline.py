"""The pipeline's stages against brute force, on the smallest tables."""

import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline
from quantloom.llm import line_dedup, mixing, quality
from tests.llm.test_operators import brute_components, make, shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        out.append((docs, spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(spark, stages):
    before, after = stages[0]
    scores = quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows(after)) == {r.doc_id for r in scores if r.score >= 0.5} and after.columns == before.columns


def test_line_stage(stages):
    before, after = map(rows, stages[1])
    holders = defaultdict(set)
    for i, r in before.items():
        for x in (r.text or "").split("\n"):
            holders[line_dedup.line_key(x)].add(i)
    for i, r in before.items():
        kept = [x for x in (r.text or "").split("\n") if not line_dedup.line_key(x) or len(holders[line_dedup.line_key(x)]) < 10]
        assert (after[i].text or "") == "\n".join(kept)
    assert set(after) == set(before)


def test_near_copy_stage(stages):
    before, after = map(rows, stages[2])
    sets = {i: shingle_set(r.text) for i, r in before.items()}
    want = brute_components(sets, lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b))
    assert set(after) == {i for i, m in want.items() if i == m}


def test_near_copy_stage_takes_pairs_between_80_and_85(spark):
    w = [f"w{i}" for i in range(200)]
    near = w[:60] + ["x"] + w[61:120] + ["y"] + w[121:170] + ["z", "q"] + w[172:198]  # 165 of 202 shingles
    share = len(shingle_set(" ".join(w)) & shingle_set(" ".join(near))) / len(shingle_set(" ".join(w)) | shingle_set(" ".join(near)))
    assert 0.80 <= share < 0.85
    docs = make(spark, [(1, " ".join(w)), (2, " ".join(near)), (3, "something else")])
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()} == {1, 3}


def test_benchmark_stage(spark, stages):
    before, after = map(rows, stages[3])
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in before.items() if not any(s and 100 * len(s & shingle_set(r.text)) >= 80 * len(s) for s in items)}
    assert set(after) == clean


def test_mixing_stage(stages):
    before, after = stages[4]
    docs = rows(before)
    n = {i: len([x for x in (r.text or "").split() if x]) for i, r in docs.items()}
    total, own, used = sum(n.values()), defaultdict(int), defaultdict(int)
    for i, r in docs.items():
        own[r.source] += n[i]
    _, w = mixing.temperature(mixing.source_tokens(before), total, 0.95, 4.0)
    quota = {r.source: round(total * r.weight) for r in w.collect()}
    out = after.collect()
    for r in out:
        used[r.source] += n[r.doc_id]
    for s, q in quota.items():
        whole = q // own[s]
        part = sorted((hashlib.md5(f"1:{whole}:{i}".encode()).hexdigest(), i) for i, r in docs.items() if r.source == s)
        run, rest, want = 0, q % own[s], []
        for _, i in part:
            run += n[i]
            if run <= rest:
                want.append(i)
        got = sorted(r.doc_id for r in out if r.source == s and r._epoch == whole)
        assert got == sorted(want if rest else []) and used[s] <= q
        for e in range(whole):
            assert sorted(r.doc_id for r in out if r.source == s and r._epoch == e) == sorted(i for i, r in docs.items() if r.source == s)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted((r.doc_id, r._epoch) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r._epoch) for r in stages[4][1].collect())
