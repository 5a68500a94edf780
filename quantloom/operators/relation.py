"""Relation-graph features: peers' returns over daily edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions.columns import DATE, INSTRUMENT
from quantloom.functions.tables import stored


def market_returns(panel: DataFrame, horizons=(1, 5, 20)) -> DataFrame:
    """date, instrument_id, ret_n over n rows, and ret_1 one row late."""
    r = {f"ret_{n}": C.safe_divide(F.col("close"), C.delay(F.col("close"), n)) - 1 for n in horizons}
    out = panel.select(DATE, INSTRUMENT, *(x.alias(k) for k, x in r.items()))
    return out.withColumn("ret_1_lag", F.lag("ret_1").over(C.order()))


def classify(edges: DataFrame, stable: float = 0.5, quality: float = 0.5) -> DataFrame:
    """Edges with is_stable, is_directed, is_sector and is_quality: by their type or by scores; a directed, stable or same-sector
    edge has quality, whatever its score. Columns that are absent or null say nothing."""
    has = lambda x: F.coalesce(F.col(x), F.lit(0.0)) if x in edges.columns else F.lit(0.0)
    kind = F.coalesce(F.col("typed_edge"), F.lit("")) if "typed_edge" in edges.columns else F.lit("")
    sector = F.coalesce(F.col("same_sector"), F.lit(False)) if "same_sector" in edges.columns else F.lit(False)
    flags = {"is_stable": (kind == "stable_corr_edge") | (has("edge_stability_score") >= stable), "is_directed": (kind == "directed_lag_edge") | (has("directed_lag_factor_count") > 0) | (has("directed_lag_score") > 0), "is_sector": sector}
    return edges.withColumns(flags).withColumn("is_quality", F.col("is_directed") | F.col("is_stable") | F.col("is_sector") | (has("edge_quality_score") >= quality))


def with_centralities(edges: DataFrame, rounds: int = 8, damping: float = 0.85) -> DataFrame:
    """``edges`` (date, source, target, weight; weights positive) with source_influence_centrality and target_neighbor_centrality.

    Power iteration on each date's graph: a node's influence is what its targets pass on, each in proportion to its
    incoming weights, plus an equal share for all; after ``rounds`` rounds, times the number of nodes (1: as influential as the
    mean). A target's exposure is the mean influence of its sources by weight. A round is a join and an aggregation of tables
    of the size of the edges, by date and node; edges and the influence after each round are stored, so edges are made once
    and plans do not grow with the rounds. A date's mean is taken from sums by partition, not by moving its nodes together."""
    w = F.when(F.col("weight") > 0, F.col("weight"))
    all_ = stored(edges.withColumn("_share", w / F.sum(w).over(Window.partitionBy(DATE, "target"))))
    e = all_.where("_share is not null").select(DATE, "source", "target", F.col("_share").alias("share"))
    nodes = e.select(DATE, F.col("source").alias("node")).union(e.select(DATE, "target")).distinct()
    x = stored(nodes.withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        got = e.join(x.withColumnRenamed("node", "target"), [DATE, "target"]).groupBy(DATE, F.col("source").alias("node")).agg(F.sum(F.col("share") * F.col("x")).alias("in"))
        y = stored(x.join(got, [DATE, "node"], "left").select(DATE, "node", (1 - damping + damping * F.coalesce("in", F.lit(0.0))).alias("y")))
        mean = F.broadcast(y.groupBy(DATE).agg(F.avg("y").alias("m")))  # a row per date
        x = y.join(mean, DATE).select(DATE, "node", (F.col("y") / F.col("m")).alias("x"))
    out = all_.join(x.select(DATE, F.col("node").alias("source"), F.col("x").alias("source_influence_centrality")), [DATE, "source"], "left")
    near = F.sum(F.col("_share") * F.col("source_influence_centrality")).over(Window.partitionBy(DATE, "target"))
    return out.select(*edges.columns, "source_influence_centrality", near.alias("target_neighbor_centrality"))


def std_from_sums(sw, swx, swxx):
    """Weighted deviation from the sums of w, w x and w x x."""
    mean = swx / F.when(sw != 0, sw)
    return F.sqrt(F.greatest(swxx / F.when(sw != 0, sw) - mean * mean, F.lit(0.0)))


def relation_features(edges: DataFrame, returns: DataFrame, horizons=(1, 5, 20)) -> DataFrame:
    """By (date, target): weighted means of the sources' returns over all edges (weight of those with a return) and over
    stable, same-sector, quality and directed ones (their full weight); dispersion, the top peer's return, number and
    sum of weights; the weight of each kind; the peers' return one row late; mean quality and centralities by weight, where the
    edges have them. One join of edges with returns, one aggregation."""
    e = classify(edges).join(returns.withColumnRenamed(INSTRUMENT, "source"), [DATE, "source"], "left")
    agg = [F.count("*").alias("peers"), F.sum("weight").alias("weight_sum")]
    for n in horizons:
        x, w = F.col(f"ret_{n}"), F.col("weight")
        there = F.when(x.isNotNull(), w)
        agg.append((F.sum(w * x) / F.when(F.sum(there) != 0, F.sum(there))).alias(f"peer_ret_{n}"))
        for kind in ("stable", "sector", "quality", "directed"):
            own = F.when(F.col(f"is_{kind}"), w)
            agg.append((F.sum(own * x) / F.when(F.sum(own) != 0, F.sum(own))).alias(f"{kind}_peer_ret_{n}"))
        agg.append(std_from_sums(F.sum(there), F.sum(w * x), F.sum(w * x * x)).alias(f"peer_dispersion_{n}"))
    late, there = F.col("ret_1_lag"), F.when(F.col("ret_1_lag").isNotNull(), F.col("weight"))
    agg.append((F.sum(F.col("weight") * late) / F.when(F.sum(there) != 0, F.sum(there))).alias("lead_lag_peer_ret_1"))
    for kind in ("stable", "sector", "quality", "directed"):
        agg.append(F.coalesce(F.sum(F.when(F.col(f"is_{kind}"), F.col("weight"))), F.lit(0.0)).alias(f"{kind}_strength"))
    for kind in ("stable", "quality"):
        own = F.when(F.col(f"is_{kind}"), F.col("weight"))
        agg.append(std_from_sums(F.sum(own), F.sum(own * F.coalesce("ret_1", F.lit(0.0))), F.sum(own * F.coalesce(F.col("ret_1") * F.col("ret_1"), F.lit(0.0)))).alias(f"{kind}_peer_dispersion_1"))
    full = F.when(F.sum("weight") != 0, F.sum("weight"))
    agg += [(F.sum(F.col("weight") * F.coalesce(x, F.lit(0.0))) / full).alias(x) for x in ("source_influence_centrality", "edge_quality_score") if x in edges.columns]
    if "target_neighbor_centrality" in edges.columns:
        agg.append(F.avg("target_neighbor_centrality").alias("target_neighbor_centrality"))
    agg += [F.max(F.when(F.col("rank") == 1, F.col("ret_1"))).alias("top_peer_ret_1"), F.stddev_samp("ret_1").alias("peer_std_1")]
    return e.groupBy(DATE, F.col("target").alias(INSTRUMENT)).agg(*agg)


def attach(panel: DataFrame, features: DataFrame) -> DataFrame:
    return panel.join(features, [DATE, INSTRUMENT], "left")


def coverage(df: DataFrame, columns) -> DataFrame:
    """One row: the share of rows with any of the columns, and rows."""
    some = F.greatest(*(F.col(x).isNotNull() for x in columns)) if len(columns) > 1 else F.col(columns[0]).isNotNull()
    return df.agg(F.avg(some.cast("double")).alias("any_share"), F.count("*").alias("rows"))


def lag_selection(candidates: DataFrame, top: int) -> DataFrame:
    """Selected (source, target, factor, best_lag) of the ``top`` factors by number of pairs, then mean size of ic."""
    rows = candidates.where("selection_status = 'selected' and best_lag > 0")
    rank = rows.groupBy("factor").agg(F.count("*").alias("n"), F.avg(F.abs("ic")).alias("m")).orderBy(F.desc("n"), F.desc("m"), "factor").limit(top)
    return rows.join(F.broadcast(rank.select("factor")), "factor", "left_semi")


def lagged_relations(edges: DataFrame, factors: DataFrame, names, lags=(1, 2)) -> DataFrame:
    """By (date, target): for each factor and lag, the weighted mean of the sources' value so many of their rows before."""
    rows = factors.withColumn("_t", F.row_number().over(C.order())).unpivot([DATE, INSTRUMENT, "_t"], list(names), "factor", "value")
    now = rows.select(INSTRUMENT, DATE, "_t", "factor").withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    old = rows.select(INSTRUMENT, F.col("_t").alias("_s"), "factor", "value")
    lagged = now.withColumn("_s", F.col("_t") - F.col("lag")).join(old, [INSTRUMENT, "_s", "factor"]).select(F.col(INSTRUMENT).alias("source"), DATE, "factor", "lag", "value")
    e = edges.select(DATE, "source", "target", "weight").join(lagged, [DATE, "source"])
    w = F.when(F.col("value").isNotNull(), F.col("weight"))
    out = e.groupBy(DATE, F.col("target").alias(INSTRUMENT), F.concat_ws("_", F.lit("rel"), "factor", F.col("lag").cast("string")).alias("_name")).agg((F.sum(F.col("value") * F.col("weight")) / F.when(F.sum(w) != 0, F.sum(w))).alias("v"))
    return out.groupBy(DATE, INSTRUMENT).pivot("_name", [f"rel_{x}_{n}" for x in names for n in lags]).agg(F.first("v"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.withColumn("_k", F.row_number().over(Window.partitionBy(DATE, "target").orderBy(F.desc("weight"), "source"))).where(F.col("_k") <= k).drop("_k")
