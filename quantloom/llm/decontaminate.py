"""Operator 3, benchmark decontamination: size-partitioned MinHash containment search, exact shingle check.

Banded MinHash needs thousands of tables to see a 30-shingle item inside a 20,000-word document (similarity
0.0015). The minima are therefore taken from the item alone: an item of n shingles of which at least t are wanted
keeps its n - ceil(t n) + 1 smallest shingle hashes. A document with the wanted share holds at least one of them,
so no match is lost. Items are partitioned by size; each partition has its own largest kept hash, and a document
only looks up its hashes below the bound of the partitions that it is long enough for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, WHITE, WIDE, WORD_BREAK, ascii_lower, durable, fresh, row_key, small_side


def word_array(text):
    """A-Z lower-cased words between ASCII white space; none for null."""
    trimmed = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def _over_shingles(words: str, make, k: int = SHINGLE):
    """make(slice) for each k-word shingle of the column named, which has words; shorter texts have one of all."""
    w, n = F.col(words), F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: make(F.slice(w, i, k)))
    return F.when(n >= k, many).otherwise(F.array(make(w)))


def _hashes(words: str):
    return _over_shingles(words, F.xxhash64)


def _texts(words: str):
    return F.array_distinct(_over_shingles(words, lambda s: F.array_join(s, " ")))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all pairs where 100 * n_shared >= percent * n_item.

    ``docs``: doc_id, text, ...; ``items``: item_id, text, .... n_item counts an item's distinct 5-word shingles,
    n_shared those that the document holds. Null and empty texts match nothing. Items under five words have their
    whole sequence as one shingle, which only a text of just these words has. Repeated rows give one result each pair."""
    return _contained(docs, items, percent).drop("row").distinct()


def _contained(docs, items, percent):
    items = items.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = durable(items.select("item_id", F.array_distinct(_hashes("w")).alias("h"), _texts("w").alias("s")).distinct())
    items = items.withColumn("n", F.size("s")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    kept = F.expr(f"n - cast(ceil(n * {percent} / 100.0) as int) + 1")
    signs = items.select("item_id", "n", "part", F.explode(F.slice(F.array_sort("h"), F.lit(1), kept)).alias("h"))
    signs = durable(signs)
    bounds = signs.groupBy("part").agg(F.max("h").alias("most"), F.min("n").alias("n")).orderBy("part").collect()  # a row for each power of two
    if not bounds:
        return signs.sparkSession.createDataFrame([], f"row {WIDE}, doc_id long, item_id long, n_item long, n_shared long, containment double")
    bound = F.greatest(*[F.when(F.col("m") * 100 >= b.n * percent, F.lit(b.most)).otherwise(F.lit(-(1 << 63))) for b in bounds], F.lit(-(1 << 63)))
    base = docs.select("doc_id", "text").withColumn("row", row_key())
    probe = base.select("row", word_array(F.col("text")).alias("w"))
    probe = probe.withColumn("m", F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1))).withColumn("most", bound)
    probe = probe.where("size(w) > 0").select("row", "m", "most", _hashes("w").alias("hs"))
    probe = probe.select("row", "m", F.explode(F.filter("hs", lambda h: h <= F.col("most"))).alias("h"))
    found = probe.join(small_side(signs, 32), "h").where(F.col("m") * 100 >= F.col("n") * percent).select("row", "item_id").distinct()
    found = durable(found)
    rows = durable(found.select("row").distinct())
    texts = base.join(small_side(rows, 32), "row", "left_semi").dropDuplicates(["row"]).select("row", "doc_id", word_array(F.col("text")).alias("w"))
    items = durable(items.select("item_id", "n", "s"))
    size = items.agg(F.avg(F.aggregate("s", F.lit(64), lambda total, x: total + F.octet_length(x) + 16))).first()[0]  # measured bytes of a row
    pairs = found.join(texts, "row").join(small_side(items, int(size) + 1), "item_id")
    pairs = pairs.select("row", "doc_id", "item_id", F.col("n").cast("long").alias("n_item"), F.size(F.array_intersect("s", _texts("w"))).cast("long").alias("n_shared"))
    pairs = pairs.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that hold an item, row by row: ids may be null or repeated. Null and empty texts stay,
    repeated rows stay or go together; all columns stay, whatever their names; without items all documents stay."""
    (row,) = fresh(docs, "row")
    bad = durable(_contained(docs, items, percent).select(F.col("row").alias(row)).distinct())
    return docs.join(small_side(bad, 32), row_key() == F.col(row), "left_anti").select(*docs.columns)


def op3_decontaminate(spark, sf_dir):
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = {
    "op3_decontaminate": r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
s AS (
  SELECT kind, id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
e AS (SELECT kind, id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n) AS n_item, count(DISTINCT d.g) AS n_shared
      FROM e d JOIN e i ON d.g = i.g WHERE d.kind = 0 AND i.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM p WHERE 100 * n_shared >= 80 * n_item"""
}
