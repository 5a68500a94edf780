"""Operator 10, MinHash near-dedup: SetSketch registers in bands, joint estimate by likelihood, exact check."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE, chunks, components, durable, fresh, mix, row_key, shingles, small_side, wide_words, workers_import

#: SetSketch: base of the exponential spacing, rate, largest register value.
BASE, RATE, TOP = 1.02, 20.0, 4000
#: A pair at the threshold shares no band with this probability at most. Bands are as long as fewer than REGISTERS allow.
MISS, REGISTERS = 1e-5, 150
#: Pairs whose estimate is this much below the threshold, or five standard deviations if that is more, are not checked.
MARGIN = 0.18
_A = np.random.default_rng(77).integers(1, 2**63, 1 << 15, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Buckets of up to SMALL rows are paired by a join; larger ones are cut into blocks of at most about BLOCK rows and
#: BLOCK_SHINGLES shingles, two of which are compared in a task.
SMALL, BLOCK, BLOCK_SHINGLES = 24, 2048, 1 << 20


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands, of which fewer than REGISTERS registers leave a pair of similarity percent /
    100 without a common one with probability (1 - s**rows)**bands <= MISS; bands of one row if there are none. At 85
    these are 20 bands of 5, at 80 29 of 5; a pair without common shingles shares one of 20 with probability 20 *
    0.005**5 < 1e-10."""
    share = min(max(percent, 1), 100) / 100
    best = None
    for rows in range(1, REGISTERS):
        bands = 1 if share == 1 else int(np.ceil(np.log(MISS) / np.log1p(-(share**rows))))
        if best is None or bands * rows < REGISTERS:
            best = bands, rows
    return best


def margin(percent: int) -> float:
    bands, rows = banding(percent)
    share = min(max(percent, 0), 100) / 100
    return max(MARGIN, 5 * float(np.sqrt(share * (1 - share) / (bands * rows))))


def registers(h: np.ndarray, limits: np.ndarray, m: int = 100) -> np.ndarray:
    """uint16 SetSketch registers (rows x m) of the hashed sets; empty sets get zeros. A register is
    floor(1 - log_b(minimum of Exp(RATE) values)), cut to [0, TOP]; that of a union is the larger of two."""
    out = np.zeros((len(limits) - 1, m), np.uint16)
    full = np.flatnonzero(np.diff(limits))
    if not len(full):
        return out
    start = limits[full]
    least = np.empty((len(full), m), np.uint64)
    for j in range(m):
        least[:, j] = np.minimum.reduceat(h * _A[j], start)
    exp = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(exp, 1e-300) / RATE) / np.log(BASE)), 0, TOP)
    return out


def _p(x):
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by joint likelihood of the numbers of registers where a is larger, b is larger,
    both are equal, given the set sizes; the likeliest on a grid."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, 101)[None, :]
    pu, pd_ = _p(np.clip(u - v * j, 1e-9, 1)), _p(np.clip(v - u * j, 1e-9, 1))
    like = up * np.log(pu) + down * np.log(pd_) + (a.shape[1] - up - down) * np.log(np.maximum(1 - pu - pd_, 1e-12))
    like = np.where(j <= np.minimum(u / v, v / u) + 1e-9, like, -np.inf)
    return j[0][np.argmax(like, axis=1)]


def _own(column: pa.Array, m: int = 0):
    """By runs of texts (first, shingles, registers): the distinct shingles of each as two rows of 64-bit hashes, sorted by the
    first; and m registers if any are wanted."""
    for row, data, at in chunks(column):
        *h, limits = wide_words(data, at)
        (s, ends), (t, _) = (shingles(x, limits) for x in h)
        rows = []
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            one, first = np.unique(s[i:j], return_index=True)
            rows.append(np.stack([one, t[i:j][first]]))
        yield row, rows, registers(s, ends, m) if m else None


def _sketch(m: int):
    def sketch(batches):
        for batch in batches:
            for first, rows, regs in _own(batch.column(1), m):
                n = pa.array([x.shape[1] for x in rows], pa.int64())
                key = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in rows], pa.binary())
                own = (batch.column(i).slice(first, len(rows)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([*own, n, key, pa.array([x.tobytes() for x in regs], pa.binary())], ["doc_id", "row", "n", "key", "regs"])

    return sketch


def _sets(batches):
    for batch in batches:
        for first, rows, _ in _own(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), pa.array([x.tobytes() for x in rows], pa.binary())], ["id", "hashes"])


def numbered(sets: list[bytes]) -> np.ndarray:
    """The shingles of several sets, end to end, as numbers: equal ones of 128 bits share one."""
    h, g = (np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1)[i] for x in sets]) for i in (0, 1))
    order = np.lexsort((g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _bands(count: int, rows: int):
    def bands(batches):
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, count * rows).astype(np.uint64)
            keys = np.empty((len(regs), count), np.uint64)
            for b in range(count):
                acc = np.full(len(regs), b + 1, np.uint64)
                for j in range(b * rows, (b + 1) * rows):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + regs[:, j])
                keys[:, b] = acc
            at = pa.array(np.repeat(np.arange(len(regs)), count))
            no = pa.array(np.tile(np.arange(count, dtype=np.int32), len(regs)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), no, pa.array(keys.ravel().view(np.int64))], ["id", "n", "no", "band"])

    return bands


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of sketches (rows of a, or one row, with rows of b), those that may be links, the one rule for all buckets:
    sizes that allow the similarity, nearly so many equal registers (their expected share is the similarity at least),
    then the estimate."""
    threshold = percent / 100
    least = threshold - margin(percent)
    ok = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
    ok &= (a == b).mean(1) >= least - 0.05
    at = np.flatnonzero(ok)
    if len(at):
        x = np.broadcast_to(a, b.shape)[at]
        ok[at] = estimate(x, b[at], np.broadcast_to(na, nb.shape)[at], nb[at]) >= least
    return ok


def _likely(percent: int):
    m = int(np.prod(banding(percent)))

    def likely(frames):
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, m) for x in (f.ra, f.rb))
                f = f[plausible(a, b, f.na.to_numpy(float), f.nb.to_numpy(float), percent)]
            yield f[["a", "b"]]

    return likely


def _verify(percent: int):
    def verify(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        for i in range(len(a)):
            x, y = (np.frombuffer(c[i].as_buffer(), np.uint64).reshape(2, -1) for c in (a, b))
            _, at, to = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
            both = int((x[1][at] == y[1][to]).sum())
            out[i] = 100 * both >= percent * (x.shape[1] + y.shape[1] - both)
        return pa.array(out)

    return F.arrow_udf(verify, "boolean")


def _within(percent: int):
    """Links between different components in a block pair of a bucket, as many as join them. A pair is looked at in the
    first band that it shares, if the estimate does not rule it out, and unless links found so far join it; the
    intersection is exact."""
    bands, rows = banding(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, blk, no = pdf.id.to_numpy(), pdf.n.to_numpy(float), pdf.blk.to_numpy(), int(pdf.no.iloc[0])
        regs = np.frombuffer(b"".join(pdf.regs), np.uint16).reshape(-1, bands * rows)
        root = np.unique(pdf.comp, return_inverse=True)[1]
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        flat = numbered(list(pdf.hashes))
        mark, place, own, out = np.zeros(len(flat), np.int64), np.arange(len(ids)), blk.min() == blk.max(), []
        for i in place if own else np.flatnonzero(blk == blk.min()):
            j = np.flatnonzero((root != root[i]) & ((place > i) if own else (blk != blk[i])))
            if len(j):
                j = j[plausible(regs[i : i + 1], regs[j], n[i : i + 1], n[j], percent)]
            if len(j):
                j = j[~(regs[j] == regs[i]).reshape(len(j), bands, rows).all(2)[:, :no].any(1)]  # an earlier band has the others
            if len(j):
                mark[flat[at[i] : at[i + 1]]] = 1
                both = np.array([mark[flat[at[k] : at[k + 1]]].sum() for k in j])
                mark[flat[at[i] : at[i + 1]]] = 0
                for k in j[100 * both >= percent * (n[i] + n[j] - both)]:
                    if root[k] != root[i]:
                        out.append((ids[i], ids[k]))
                        root[root == root[k]] = root[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text, ...).

    A-Z lower-cased words between ASCII white space; the set of distinct 5-word shingles (shorter texts: the whole
    word sequence as one; null or no words: the empty set, linked with nothing). Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id that links reach (null if
    all are null), kept marks the document that has it. Rows of one id and text are one document; of several
    documents with that id, or of null ids alone, the one with the smallest hash is kept. Texts are read whole, extra
    columns ignored; an empty table gives an empty one. Links and equal sets are confirmed on two hashes of 64 bits a shingle, made of
    words whose bytes are mixed with their places: a pair of texts of 20,000 words shares a shingle by chance once in 10**30
    pairs. Only candidates are found by one of them.

    Equal sets meet first and go on as one. Sketches (200 bytes at 85) of distinct sets are banded. In each bucket, the
    smallest set is checked against the others (as many pairs as rows). What is then in one component needs no
    further pair: only pairs of a bucket's different components are left. Small buckets are paired by a join; large
    ones are cut into blocks, and each pair of blocks reports just the links that join its components. All pairs that
    the estimate leaves are covered; there is no cap."""
    return _near_duplicates(docs, percent).drop("row")


def _near_duplicates(docs, percent):
    spark = docs.sparkSession
    workers_import(spark)
    count, rows = banding(percent)
    base = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", row_key())
    sketch = durable(base.mapInArrow(_sketch(count * rows), f"doc_id long, row {WIDE}, n long, key binary, regs binary"))
    sets = sketch.where("n > 0").groupBy("key", "n").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep"), F.first("regs").alias("regs"))
    sets = durable(sets.withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay as they are
    bands = sets.select("id", "regs", "n").mapInArrow(_bands(count, rows), "id long, n long, no int, band long")
    cut = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    buckets = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("size"), cut.alias("nb")).where("size > 1")
    bands = durable(bands.drop("n").join(small_side(durable(buckets), 48), "band"))
    left = sets.select(F.col("id").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    right = sets.select(F.col("id").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    star = bands.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = durable(star.join(left, "a").join(right, "b").mapInPandas(_likely(percent), "a long, b long"))

    # the full sets of those in buckets, from one row of documents each
    used = durable(bands.select("id").distinct().join(sets, "id").select("id", "rep.row"))
    texts = base.select("row", "text").join(small_side(used, 48), "row")
    full = texts.select("id", "text").mapInArrow(_sets, "id long, hashes binary")
    full = durable(full.groupBy("id").agg(F.first("hashes").alias("hashes")))
    return _linked(sketch, sets, bands, star, full, percent, left, right)


def _linked(sketch, sets, bands, star, full, percent, left, right):
    verify = _verify(percent)
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fa, fb = full.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), full.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))

    def links(pairs):
        return durable(pairs.select("a", "b").join(fa, "a").join(fb, "b").where(verify("ha", "hb")).select("a", "b"))

    found = links(star)
    comp = components(found)
    member = bands.join(comp, bands.id == comp.node, "left").select("band", "no", "size", "nb", "id", F.coalesce("component", "id").alias("comp"))
    member = durable(member)
    mixed = member.groupBy("band").agg((F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").select("band")
    member = member.join(small_side(durable(mixed), 24), "band")
    x, y = (member.where(F.col("size") <= SMALL).select("band", F.col("id").alias(i), F.col("comp").alias(f"c{i}")) for i in "ab")
    few = x.join(y, "band").where("a < b and ca <> cb").select("a", "b").distinct()
    few = few.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    few = few.join(left, "a").join(right, "b")
    few = links(durable(few.mapInPandas(_likely(percent), "a long, b long")))
    rows = member.where(F.col("size") > SMALL).join(sets.select("id", "n", "regs"), "id").join(full, "id")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("band", "no", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "id", "comp", "n", "regs", "hashes")
    many = durable(rows.repartition(parts, "band", "lo", "hi").groupBy("band", "lo", "hi").applyInPandas(_within(percent), "a long, b long"))
    comp = components(found.union(few).union(many))
    least = comp.join(sets.select(F.col("id").alias("node"), "rep"), "node")
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("node").alias("id"), "least")
    named = sets.select("id", "key", "rep").join(least, "id", "left").select("key", F.coalesce("least", "rep").alias("first"))
    out = sketch.select("doc_id", "row", "n", "key")
    some = out.where("n > 0").join(small_side(durable(named), 80), "key")
    some = some.select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))
    none = out.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id, null ids last. Of rows
    alike in id and text, one stays. Null, empty and wordless texts are nobody's copies; all columns stay, whatever their
    names; an empty table gives an empty one."""
    row, n = fresh(docs, "row", "n")
    kept = _near_duplicates(docs, percent).where("kept").groupBy(F.col("row").alias(row)).agg(F.count("*").alias(n))
    found = docs.join(small_side(durable(kept), 48), row_key(F.col("doc_id").cast("long")) == F.col(row))
    once, more = found.where(F.col(n) == 1), found.where(F.col(n) > 1).dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).select(*docs.columns)


def op10_minhash_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op10_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
f AS MATERIALIZED (SELECT doc_id, g FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS c FROM e) WHERE c > 1),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, len(sh) AS n_shingles, m AS component_id, s.doc_id = m AS kept FROM s JOIN comp ON a = s.doc_id"""
}
