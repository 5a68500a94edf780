"""Operator 4, mixing sources to target weights: temperature by bisection, budgeted block permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, small_side, wide_key

#: Halvings of the exponent's interval: HALVINGS in each of ROUNDS jobs.
HALVINGS, ROUNDS = 6, 8
#: Blocks of a source's permutation, as hexadecimal digits of the hash: sums over blocks are small at any size.
DIGITS = 3


def source_tokens(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, n_tokens): words between ASCII white space; a null source is a source of its own."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")
    return docs.select(wide_key("doc_id", "text", "source").alias("row"), "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("_source"), n.alias("n_tokens"))


def _probe(shares: DataFrame, budget: float, points: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: the entropy of the weights and the largest number of repetitions."""
    z = F.exp(F.col("a") * F.ln("p"))
    rows = shares.withColumn("a", F.explode(F.array(*map(F.lit, points)))).withColumn("z", z)
    rows = rows.groupBy("a").agg(F.sum("z").alias("sum"), F.sum(F.col("z") * F.ln("z")).alias("zl"), F.max(F.col("z") / F.col("tokens")).alias("most")).collect()
    from math import log

    return {r.a: (log(r["sum"]) - r.zl / r["sum"], budget * r.most / r["sum"]) for r in rows}


def _halve(shares: DataFrame, budget: float, good, low: float, high: float, keep_low: bool) -> float:
    """The end of [low, high] that fulfils ``good`` after ROUNDS * HALVINGS halvings; good changes once in between,
    low is good if keep_low, else high."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / 2**HALVINGS for k in range(1, 2**HALVINGS)]
        found = _probe(shares, budget, points)
        ok = [p for p in points if good(*found[p])]
        step = (high - low) / 2**HALVINGS
        if keep_low:
            low = max(ok, default=low)
            high = min(high, low + step)
        else:
            high = min(ok, default=high)
            low = max(low, high - step)
    return low if keep_low else high


def temperature(tokens: DataFrame, budget: float, target_entropy: float, max_repeats: float) -> tuple[float, DataFrame]:
    """The exponent in [0, 1], and (source columns, tokens, p, weight).

    Weights are shares ** a, normalised. a is the largest with an entropy of at least ``target_entropy`` times that
    of equal weights; if a source would then be repeated more than ``max_repeats`` times, the smallest above it that
    keeps the limit (1 if none does)."""
    counts = tokens.groupBy("_source").agg(F.first("source").alias("source"), F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total, n = tokens.agg(F.sum("n_tokens"), F.countDistinct(F.when(F.col("n_tokens") > 0, F.col("_source")))).first()
    shares = durable(counts.withColumn("p", F.col("tokens") / F.lit(float(total or 1))))
    a = 1.0
    if n and n > 1:
        from math import log

        fine, kept = (lambda h, r: h >= target_entropy * log(n)), (lambda h, r: r <= max_repeats)
        ends = _probe(shares, budget, [0.0, 1.0])
        if not fine(*ends[1.0]):
            a = _halve(shares, budget, fine, 0.0, 1.0, keep_low=True)
            if not kept(*_probe(shares, budget, [a])[a]):
                a = _halve(shares, budget, kept, a, 1.0, keep_low=False)
    z = shares.withColumn("z", F.exp(F.lit(a) * F.ln("p")))
    norm = z.agg(F.sum("z")).first()[0]
    return a, z.withColumn("weight", F.col("z") / F.lit(norm or 1.0))


def mix_sources(docs: DataFrame, budget_factor: float = 1.0, target_entropy: float = 0.95, max_repeats: float = 4.0, seed: int = 1) -> DataFrame:
    """(row, doc_id, source, n_tokens, epoch, block, order_key): the documents of the mixture, once for each epoch.

    The budget is ``budget_factor`` times all tokens; a source gets round(budget * weight) of them. It is repeated
    whole as often as that holds it, each time in another permutation (md5 of seed, epoch and id), then the start of one
    more permutation whose running token count stays within the rest. Running counts are sums of whole blocks plus a
    count within the block, so that no task sees more than one block of a source. Texts without words add no
    tokens; sources with none give no rows. Equal ids follow by token count."""
    tokens = durable(source_tokens(docs))
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    budget = total * budget_factor
    _, weights = temperature(tokens, budget, target_entropy, max_repeats)
    quota = weights.withColumn("quota", F.round(F.lit(float(budget)) * F.col("weight")).cast("long"))
    quota = quota.select("_source", F.floor(F.col("quota") / F.col("tokens")).cast("long").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest"))
    rows = tokens.join(small_side(durable(quota), 128), "_source")

    def dealt(frame):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        return frame.withColumn("order_key", key).withColumn("block", F.conv(F.substring("order_key", 1, DIGITS), 16, 10).cast("int"))

    full = dealt(rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1))))
    part = dealt(rows.where("rest > 0").withColumn("epoch", F.col("whole").cast("int")))
    sums = part.groupBy("_source", "block").agg(F.sum("n_tokens").alias("own"))
    before = Window.partitionBy("_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("_source", "block").orderBy("order_key", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("run", F.sum("n_tokens").over(within)).join(sums, ["_source", "block"]).where(F.col("before") + F.col("run") <= F.col("rest"))
    columns = ["row", "doc_id", "source", "n_tokens", "epoch", "block", "order_key"]
    return full.select(*columns).unionByName(part.select(*columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture as rows of ``docs`` with _epoch, _block and _order_key (more underscores if columns are called so). Rows
    alike in id, text and source are dealt as one and come back each; null and wordless texts come with their source."""
    row, *names = fresh(docs, "_row", "_epoch", "_block", "_order_key")
    picked = mix_sources(docs, **options).select(F.col("row").alias(row), *(F.col(x).alias(n) for x, n in zip(("epoch", "block", "order_key"), names, strict=True)))
    once = durable(picked.distinct())
    return docs.join(small_side(once, 80), wide_key("doc_id", "text", "source") == F.col(row)).drop(row)


def op4_mixing(spark, sf_dir):
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), F.col("block").cast("long").alias("block"), "order_key")


SQL = {
    "op4_mixing": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, coalesce('s' || source, '-') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
c AS MATERIALIZED (SELECT k, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens) / (SELECT sum(n_tokens) FROM d) AS p FROM d GROUP BY k HAVING sum(n_tokens) > 0),
e AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN h >= t THEN m ELSE lo END, CASE WHEN h >= t THEN hi ELSE m END
  FROM (SELECT any_value(i) AS i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(m) AS m, ln(sum(z)) - sum(z * ln(z)) / sum(z) AS h, 0.95 * ln(count(*)) AS t
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, exp((lo + hi) / 2 * ln(p)) AS z FROM e, c WHERE i < 48)) WHERE i IS NOT NULL),
one AS (SELECT -sum(p * ln(p)) >= 0.95 * ln(count(*)) AS fine FROM c),
a AS (SELECT CASE WHEN (SELECT fine FROM one) THEN 1.0 ELSE (SELECT lo FROM e WHERE i = 48) END AS a),
r AS (SELECT 0 AS i, (SELECT a FROM a) AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END
  FROM (SELECT any_value(i) AS i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(m) AS m, (SELECT sum(n_tokens) FROM d) * max(z / tokens) / sum(z) <= 4 AS ok
        FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m, tokens, exp((lo + hi) / 2 * ln(p)) AS z FROM r, c WHERE i < 48)) WHERE i IS NOT NULL),
b AS (SELECT CASE WHEN (SELECT (SELECT sum(n_tokens) FROM d) * max(exp(a * ln(p)) / tokens) / sum(exp(a * ln(p))) <= 4 FROM c, a) THEN (SELECT a FROM a) ELSE (SELECT hi FROM r WHERE i = 48) END AS a),
q AS (SELECT k, tokens, round((SELECT sum(n_tokens) FROM d) * (exp(a * ln(p)) / sum(exp(a * ln(p))) OVER ()))::BIGINT AS quota FROM c, b),
w AS (SELECT k, quota // tokens AS whole, quota % tokens AS rest FROM q),
f AS (SELECT doc_id, source, n_tokens, unnest(range(whole)) AS epoch FROM d JOIN w USING (k)),
g AS (SELECT doc_id, source, n_tokens, whole AS epoch, rest, sum(n_tokens) OVER (PARTITION BY k ORDER BY md5('1:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN w USING (k) WHERE rest > 0),
u AS (SELECT doc_id, source, n_tokens, epoch FROM f UNION ALL SELECT doc_id, source, n_tokens, epoch FROM g WHERE run <= rest),
o AS (SELECT *, md5('1:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS order_key FROM u)
SELECT doc_id, source, n_tokens, epoch, ('0x' || order_key[1:3])::BIGINT AS block, order_key FROM o"""
}
