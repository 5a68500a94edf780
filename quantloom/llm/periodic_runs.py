"""Operator 12, periodic run detection: suffix automaton of the words, link-cut access for each appended word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, workers_import

#: Shortest run, and how many periods it holds at least.
LEAST, PERIODS = 6, 4


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, greatest length, state of each prefix) of the suffix automaton of a sequence; state 0 is the root."""
    link, length, to, prefix, last = [-1], [0], [{}], [], 0
    for c in word:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        to.append({})
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                to.append(dict(to[q]))
                link[q] = link[new] = clone
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
        prefix.append(new)
        last = new
    return link, length, prefix


class LastOccurrences:
    """The tree of suffix links cut into paths of states that were last seen at one end: link-cut access over splay trees, each
    the states of a path by depth. The root of a splay tree carries its path's last end and the state above the path."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.left, self.right, self.up = [-1] * n, [-1] * n, [-1] * n
        self.above, self.end = list(link), [-1] * n

    def _splay(self, v: int) -> None:
        left, right, up = self.left, self.right, self.up
        while (p := up[v]) >= 0:
            g = up[p]
            if g >= 0 and (left[g] == p) == (left[p] == v):
                self._turn(p)
            self._turn(v)
            if g >= 0 and up[v] == g:
                self._turn(v)

    def _turn(self, v: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[v]
        g = up[p]
        if left[p] == v:
            left[p] = b = right[v]
            right[v] = p
        else:
            right[p] = b = left[v]
            left[v] = p
        if b >= 0:
            up[b] = p
        up[p], up[v] = v, g
        if g >= 0:
            if left[g] == p:
                left[g] = v
            else:
                right[g] = v
        else:
            self.above[v], self.end[v] = self.above[p], self.end[p]

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """(previous end, deepest state) of each path segment from ``state`` to the root; all become one path, last seen
        at ``end``."""
        left, right, up, above, ends = self.left, self.right, self.up, self.above, self.end
        found, v, below = [], state, -1
        while v >= 0:
            self._splay(v)
            if ends[v] >= 0:
                found.append((ends[v], v))
            if (r := right[v]) >= 0:  # what is deeper on the old path stays a path of its own
                up[r], above[r], ends[r] = -1, v, ends[v]
            right[v] = below
            if below >= 0:
                up[below] = v
            below, v = v, above[v]
        ends[below] = end
        return found


def runs_of(word: list[int], periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence with at least ``periods`` >= 2 periods, by start, then period.

    When a word is appended, a segment of states last seen d words before, up to strings of m >= d words, tells a square: the
    words from m + d before the end have smallest period d. A run shows up at each of its ends, with the same start."""
    link, length, prefix = automaton(word)
    seen, last = LastOccurrences(link), {}
    for i, state in enumerate(prefix):
        for before, deepest in seen.access(state, i):
            d, m = i - before, length[deepest]
            if m >= d:
                last[i - d - m + 1, d] = i
    return sorted((s, e - s + 1, d) for (s, d), e in last.items() if e - s + 1 >= periods * d)


def repetitive_zones(word: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [lo, hi) of words outside of which no run lies: within a run of period q, all words after the first q have
    come up at most q words before. Looked at for q up to 1, 2, 4, ...: a stretch of such words must be as long as the shortest
    run with more than half that q. Every run lies in one zone as a whole."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    gap = np.full(n, n + 1)
    same = np.flatnonzero(word[order][1:] == word[order][:-1])
    gap[order[same + 1]] = order[same + 1] - order[same]
    lo, hi, q = [], [], 1
    while q // 2 + 1 <= n // periods:
        near = np.concatenate([[False], gap <= q, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1]).reshape(-1, 2)
        small = q // 2 + 1
        edge = edge[edge[:, 1] - edge[:, 0] >= max(least, periods * small) - q if q == small else edge[:, 1] - edge[:, 0] >= max(least - q, (periods - 1) * small)]
        lo.append(np.maximum(edge[:, 0] - q, 0))
        hi.append(edge[:, 1])
        q *= 2
    if not lo or not sum(map(len, lo)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] >= hi[:-1]]))
    return lo[new], hi[np.concatenate([new[1:] - 1, [len(lo) - 1]])]


def find_runs(word: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period: stretches of at least ``least``
    words and ``periods`` times their smallest period that no neighbouring word extends."""
    out = []
    for lo, hi in zip(*(x.tolist() for x in repetitive_zones(word, least, periods)), strict=True):
        out += [(lo + s, m, q) for s, m, q in runs_of(word[lo:hi].tolist(), periods) if m >= least]
    return sorted(out, key=lambda r: (r[0], r[2]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _detect(least: int, periods: int):
    def detect(batches):
        for batch in (x for b in batches for x in slices(b, 1)):
            split = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
            flat = split.values
            full = pc.not_equal(pc.binary_length(flat), 0)
            at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
            flat = flat.filter(full)
            ids = flat.dictionary_encode().indices.to_numpy()
            keep, runs = np.ones(len(ids), bool), []
            for i in range(len(batch)):
                found = find_runs(ids[at[i] : at[i + 1]], least, periods)
                for s, m, q in found:
                    keep[at[i] + s + q : at[i] + s + m] = False
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
            kept = np.concatenate([[0], np.cumsum(keep)])[at]
            left = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(runs, pa.list_(_RUN)), pc.binary_join(left, " ").cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return detect


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs`` (doc_id, text, ...): its runs as (start, length, period) by start,
    then period, words numbered from 0, and its words joined by one space without those that a run holds after its
    first period.

    Words stand between ASCII white space. A run is a stretch with smallest period q of at least ``least`` words and
    ``periods`` (2 or more) times q that no neighbouring word extends. Null, empty and white texts have no words and no runs.
    Each row is judged by itself, repeated rows and ids too; texts are read whole, whatever their length; extra columns are
    ignored; an empty table gives an empty one. Zones without near repeats are left out by a test that no run fails."""
    if periods < 2 or least < 1:
        raise ValueError("a run has two periods and a word at least")
    workers_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_detect(least, periods), "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a run at the end of every tenth text: where h = crc32(doc_id), g = h / 10, h % 10 = 0 and there
    are n > 0 words, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). Null ids: none."""
    word = F.filter(F.split("text", r"[ \t-\r]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.withColumns({"h": h, "word": F.when(h % 10 == 0, word)}).withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("word").cast("long")})
    a = F.col("g") % F.col("n")
    planted = some.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    head = F.slice("word", F.lit(1), F.col("a").cast("int"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda i: F.element_at("word", (F.col("a") + i % F.col("p") + 1).cast("int")))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text"))


def _sha(column):
    return F.sha2(F.encode(column, "UTF-8"), 256)


def op12_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs(docs)
    longest = F.get(F.array_sort("runs", lambda a, b: F.when(a.length != b.length, F.signum(b.length - a.length)).when(a.start != b.start, F.signum(a.start - b.start)).otherwise(F.signum(a.period - b.period)).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        _sha(lines).alias("runs_sha256"),
        _sha("collapsed").alias("collapsed_sha256"),
    )


SQL = {
    "op12_periodic_runs": r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
crc AS (SELECT rid, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
    lambda acc, c: list_reduce(range(0, 8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::BIGINT), xor(acc, c)), 4294967295::BIGINT)) END AS h FROM base),
par AS (SELECT b.rid, doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM base b JOIN crc USING (rid)),
word AS MATERIALIZED (SELECT rid, n, i, ws[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM par)),
pair AS (SELECT x.rid, x.i, x.i - y.i AS q FROM word x JOIN word y ON x.rid = y.rid AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
isle AS (SELECT rid, q, min(i) - q AS s, count(*) + q AS m FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pair) GROUP BY rid, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT rid, s, m, min(q) AS q FROM isle GROUP BY rid, s, m),
dropped AS (SELECT DISTINCT rid, unnest(range(s + q, s + m)) AS i FROM run),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN dropped USING (rid, i) GROUP BY rid),
told AS (SELECT rid, count(*) AS n_runs, arg_min({'s': s, 'm': m, 'q': q}, [-m, s, q]) AS b, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.m AS length, b.q AS period, 1000 * b.m // b.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM par LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)"""
}
