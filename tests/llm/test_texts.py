"""Repeated strings, periodic runs and aligned tokens against plain loops, and odd rows and tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import periodic_runs, suffix_dedup, token_alignment
from tests.llm.test_operators import EDGE, make

WS = re.compile(r"[ \t-\r]+")
SF = "/root/testdata/sf0.001"


# ---- repeated strings ----


def brute_cut(texts, length):
    """(bytes, stretches, bytes left) of each text by a table of all strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        edges = [i for i in range(len(x)) if gone[i] != (i > 0 and gone[i - 1])] + ([len(x)] if gone and gone[-1] else [])
        out.append((len(x), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(rng.randint(30, 400)) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            x = rng.choice(shared)
            i = rng.randint(0, len(x) // 2)
            parts += [x[i : i + rng.randint(0, len(x))], text(rng.randint(0, 60))]
        rows.append("".join(parts))
    return [*rows, rows[0], rows[3], "ab" * 300, "x" * 500, text(3000), None, "", shared[0]]


@pytest.mark.parametrize(("length", "parts"), [(40, "4"), (40, "61"), (104, "7"), (200, "4")])
def test_repeated_strings_against_all_strings(spark, length, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        texts = passages(length)
        rows = list(enumerate(texts)) + [(None, texts[5]), (None, None), (7, texts[7])]  # no id, and a row twice
        got = suffix_dedup.cut_repeats(make(spark, rows), length).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = sorted([(i, *b) for (i, _), b in zip(rows, brute_cut([t for _, t in rows], length), strict=True)], key=key)
    assert sorted([(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got], key=key) == want


def test_a_passage_of_a_third_of_all_rows_and_odd_tables(spark):
    rng = random.Random(2)
    own = lambda k: "".join(rng.choice("qrstuvwxyz ") for _ in range(k))
    common = own(230)
    rows = [(i, own(90) + (common if i % 3 else own(40)) + own(90)) for i in range(240)]
    got = sorted((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.cut_repeats(make(spark, rows)).collect())
    assert got == [(i, *b) for (i, _), b in zip(rows, brute_cut([t for _, t in rows], 200), strict=True)]
    assert all(bool(spans) == (i % 3 > 0) for i, _, spans, _ in got)
    assert suffix_dedup.cut_repeats(make(spark, rows).where("doc_id < 0")).collect() == []
    assert suffix_dedup.cut_repeats(make(spark, [(1, None), (2, "")])).where("n_bytes > 0 or size(spans) > 0").isEmpty()
    got = suffix_dedup.cut_repeats(make(spark, EDGE)).where("size(spans) > 0").collect()
    assert [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans]) for r in got] == [(1007, 60_000, [(0, 60_000)])]


def test_anchors_do_not_depend_on_pieces_or_neighbours(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcd ") for _ in range(9000))
    whole = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([0, 9000]), 200)
    both = suffix_dedup.anchors(np.frombuffer(b"zz" + text + text, np.uint8), np.array([0, 2, 9002, 18002]), 200)
    assert np.array_equal(both[0], np.concatenate([whole[0] + 2, whole[0] + 9002]))
    opened = lambda: [suffix_dedup._open_starts(np.frombuffer(text, np.uint8), whole[0] * 8 + m, 200) for m in (7, 1, 2, 4)]
    wide = opened()
    assert np.array_equal(wide[0], np.arange(8801)) and sorted(np.concatenate(wide[1:]).tolist()) == list(range(8801))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.anchors(np.frombuffer(text, np.uint8), np.array([0, 9000]), 200)
    inner = (whole[0] >= 200) & (whole[0] < 8700)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1]) and np.array_equal(whole[2][inner], cut[2][inner])
    assert all(np.array_equal(x, y) for x, y in zip(wide, opened(), strict=True))
    assert np.diff(whole[0]).max() <= 200 - suffix_dedup.gram_length(200) + 1


def test_multikey_order_sorts_by_all_tokens():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-3, 3, 500) for _ in range(3)]
    order = suffix_dedup.multikey_order(columns)
    rows = [tuple(int(c[i]) for c in columns) for i in order]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(500))


# ---- runs ----


def brute_runs(w, least=6, periods=4):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(3)
    for _ in range(1500):
        a, p = rng.randint(1, 4), rng.randint(1, 7)
        base = [rng.randrange(a) for _ in range(p)]
        w = [base[i % p] if rng.random() < 0.95 else rng.randrange(a) for i in range(rng.randint(0, 60))]
        for least, periods in ((6, 4), (1, 2), (3, 3), (9, 2)):
            assert periodic_runs.find_runs(np.array(w, np.int64), least, periods) == brute_runs(w, least, periods), (w, least, periods)


def test_last_occurrences_against_a_scan():
    """Segments of an access: their ends and depths are those of a scan over all suffixes of each prefix."""
    rng = random.Random(6)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        link, length, prefix = periodic_runs.automaton(w)
        seen = periodic_runs.LastOccurrences(link)
        for i, state in enumerate(prefix):
            got = {e: length[v] for e, v in seen.access(state, i)}
            want = {}
            for m in range(1, i + 2):
                ends = [e for e in range(m - 1, i) if w[e - m + 1 : e + 1] == w[i - m + 1 : i + 1]]
                if ends:
                    want[max(ends)] = m
            assert {e: m for e, m in got.items() if m} == want


def plain_planted(doc_id, text):
    w = [x for x in WS.split(text or "") if x]
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def collapsed(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_run_query_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for d, t in docs:
        w = plain_planted(d, t)
        runs, r = brute_runs(w), got[d]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(w, runs))]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)
        some += bool(runs)
    assert some > 5


def test_runs_of_odd_rows(spark):
    rows = [*EDGE, (2000, "a\x1cb " * 9), (2001, " ".join(["x y z"] * 4) + "\n\tx"), (2002, "É É é É É É É É"), (2002, None), (None, "q " * 7)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(make(spark, rows)).collect()), key=str)
    want = []
    for d, t in rows:
        w = [x for x in WS.split(t or "") if x]
        want.append((d, len(w), brute_runs(w), collapsed(w, brute_runs(w))))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(make(spark, []).where("false")).collect() == []
    planted = {r.doc_id: r.text for r in periodic_runs.with_planted_runs(make(spark, [(i, "a b  c d e f g h i j") for i in range(200)])).collect()}
    assert all(plain_planted(i, "a b  c d e f g h i j") == planted[i].split() for i in planted)
    assert any(t != "a b  c d e f g h i j" for t in planted.values())
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.periodic_runs(make(spark, []), periods=1)


# ---- tokens ----


def brute_alignment(texts):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(token_alignment.BYTE_BPE)
    slow.encode_special_tokens = True
    vocabs = token_alignment.vocabularies(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)
    spell = [[v.bytes[s : s + n].tobytes() for s, n in zip(v.at.tolist(), v.length.tolist(), strict=True)] for v in vocabs]
    rows, count = [], Counter()
    for t in texts:
        ids = [slow.encode(" " + t, add_special_tokens=False).ids, vocabs[1].model.encode(t)] if t else [[], []]
        if any(b"".join(s[i] for i in x) != (" " + t).encode() for s, x in zip(spell, ids, strict=True) if t):
            ids = [[], []]
        ends = [np.cumsum([0, *(len(s[i]) for i in x)]).tolist() for s, x in zip(spell, ids, strict=True)]
        links = [(a, b) for i, a in enumerate(ids[0]) for j, b in enumerate(ids[1]) if ends[0][i] < ends[1][j + 1] and ends[1][j] < ends[0][i + 1]]
        cuts = sorted(set(ends[0][1:]) & set(ends[1][1:]))
        groups = [["," .join(str(x) for x, e in zip(i, en[1:], strict=True) if lo < e <= hi) for i, en in zip(ids, ends, strict=True)] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        count.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(cuts), len(links), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if cuts else "", links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(*r[:5], sum(count[x] == top[x[1]] for x in r[5]), sum(count[x] for x in r[5])) for r in rows]


ODD = ["<|endoftext|> </s> <s><unk>", "a ▁ b", "  two  spaces \n\n\t", "naïve 北京 🙂🙂 é", "<0x41> x", "\x00\x01", "it's 1234567890,000", "é" * 50, "word " * 3000, " ", "ﬁ ½ Ⅷ", "a b c"]


def test_alignment_against_loops(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    rows = list(enumerate([*texts, *ODD, None, "", texts[0]])) + [(3, texts[3]), (None, ODD[0])]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    got = sorted((tuple(r[n] for n in names) for r in token_alignment.alignment_statistics(make(spark, rows)).collect()), key=str)
    assert got == sorted(((d, *b) for (d, _), b in zip(rows, brute_alignment([t for _, t in rows]), strict=True)), key=str)
    assert next(r for r in got if r[0] == 41)[1:] == (0, 0, 0, 0, "", 0, 0)  # a mark that pieces read as a space


def test_alignment_of_empty_tables_and_groups_of_tokens(spark):
    assert token_alignment.alignment_statistics(make(spark, []).where("false")).collect() == []
    none = token_alignment.alignment_statistics(make(spark, [(1, None), (2, "")])).collect()
    assert {(r.doc_id, r.n_a, r.count_sum, r.groups_sha256) for r in none} == {(1, 0, 0, ""), (2, 0, 0, "")}
    rows = {r.doc_id: r for r in token_alignment.aligned_tokens(make(spark, list(enumerate(ODD)))).collect()}
    stats = {r.doc_id: r for r in token_alignment.alignment_statistics(make(spark, list(enumerate(ODD)))).collect()}
    for i, r in rows.items():
        groups = [",".join(str(x) for x, y in zip(r.a, r.a_groups, strict=True) if y == g) + "|" + ",".join(str(x) for x, y in zip(r.b, r.b_groups, strict=True) if y == g) for g in range(stats[i].n_groups)]
        assert (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") == stats[i].groups_sha256


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab '’\n\r\t 1٣ 　éß", max_size=60))
def test_fast_encoder_is_the_tokenizers_file(text):
    from tokenizers import Tokenizer

    a = token_alignment.vocabularies(token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)[0]
    global _slow
    try:
        slow = _slow
    except NameError:
        slow = _slow = Tokenizer.from_file(token_alignment.BYTE_BPE)
        slow.encode_special_tokens = True
    assert a.encode([text])[0].tolist() == slow.encode(" " + text, add_special_tokens=False).ids
