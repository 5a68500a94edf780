"""Formula candidates: a catalogue compiled to columns, shared diagnostics, greedy selection over candidate tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions import expression as E
from quantloom.functions.columns import DATE, INSTRUMENT

from . import diagnostics
from .features import FORBIDDEN, FORBIDDEN_PREFIXES
from .preprocess import safe_zscore, winsorize

UNARY = {"neg": lambda x: -x, "abs": E.absolute, "tanh": E.tanh, "signed_sq": lambda x: E.sign(x) * x * x, "rank": E.rank}
BINARY = {"spread": lambda x, y: x - y, "interaction": lambda x, y: x * E.tanh(y), "ratio": lambda x, y: x / (1 + E.absolute(y)), "confirm": lambda x, y: x * E.sign(y)}


def compile_spec(spec) -> E.Expr:
    """A nested tuple as an expression: a field name, (unary, x), (binary, x, y) or ("blend", x, y, weight of x)."""
    if isinstance(spec, str):
        if spec in FORBIDDEN or spec.startswith(FORBIDDEN_PREFIXES):
            raise ValueError(f"not allowed in formulas: {spec}")
        return E.field(spec)
    kind, *args = spec
    if kind == "blend":
        x, y, w = args
        return compile_spec(x) * w + compile_spec(y) * (1 - w)
    return (UNARY | BINARY)[kind](*map(compile_spec, args))


def fields_of(spec) -> set[str]:
    return {spec} if isinstance(spec, str) else set().union(*(fields_of(x) for x in spec[1:] if not isinstance(x, (int, float))))


def evaluate(df: DataFrame, specs: dict[str, object], keep=(INSTRUMENT, DATE)) -> DataFrame:
    """All candidates in one layered pass."""
    return E.evaluate(df, {k: compile_spec(s) for k, s in specs.items()}, keep)


def standardized(df: DataFrame, names, q: float = 0.01) -> DataFrame:
    """Candidates winsorised and z-scored by date; dates without variation are null."""
    cut = df.withColumns({f"_c_{x}": winsorize(F.col(x), q) for x in names})
    dev = {x: F.stddev_pop(f"_c_{x}").over(C.section()) > 1e-12 for x in names}
    return cut.withColumns({x: F.when(dev[x], safe_zscore(F.col(f"_c_{x}"))) for x in names}).drop(*(f"_c_{x}" for x in names))


def signal_ranks(df: DataFrame, names) -> DataFrame:
    return df.withColumns({x: C.pct_rank(F.col(x)) for x in names})


def validate_zoo(zoo: DataFrame, allowed=None) -> DataFrame:
    """(candidate_id, problem) of repeated ids and of fields (``fields``, joined by |) that are forbidden or not allowed."""
    dup = zoo.groupBy("candidate_id").count().where("count > 1").select("candidate_id", F.lit("duplicate_id").alias("problem"))
    f = zoo.select("candidate_id", F.explode(F.split("fields", r"\|")).alias("f"))
    bad = F.col("f").isin(*FORBIDDEN) | reduce(lambda a, b: a | b, (F.col("f").startswith(p) for p in FORBIDDEN_PREFIXES))
    out = dup.union(f.where(bad).select("candidate_id", F.lit("forbidden_field")).distinct())
    if allowed is not None:
        out = out.union(f.where(~bad & ~F.col("f").isin(*allowed)).select("candidate_id", F.lit("unknown_field")).distinct())
    return out


def filter_pool(pool: DataFrame, conditions: dict[str, object], score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Candidates that meet all conditions, the best of each formula; and the funnel of counts, condition by condition."""
    aggs, so_far = [F.count("*").alias("all")], F.lit(True)
    for name, c in conditions.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        aggs.append(F.sum(so_far.cast("long")).alias(name))
    funnel = pool.agg(*aggs)
    best = Window.partitionBy("formula").orderBy(F.desc_nulls_last(score), "candidate_id")
    return pool.where(so_far).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k"), funnel


def family_cap(pool: DataFrame, cap: int, score: str = "score", top: int | None = None) -> DataFrame:
    own = Window.partitionBy("family").orderBy(F.desc_nulls_last(score), "candidate_id")
    out = pool.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= cap).drop("_k")
    return out if top is None else out.orderBy(F.desc_nulls_last(score), "candidate_id").limit(top)


def greedy_by_correlation(pool: DataFrame, pairs: DataFrame, most: float, cap: int | None = None, score: str = "score", size: int | None = None) -> DataFrame:
    """(candidate_id, kept, reason): from the best on, a candidate stays unless it correlates too much with one that
    stays, its family is full or the list is. The tables have a row per candidate and pair: the walk is on the driver."""
    near = {}
    for r in pairs.where(F.abs("corr") > most).collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    kept, families, out = [], {}, []
    for r in pool.orderBy(F.desc_nulls_last(score), "candidate_id").collect():
        fam = r.family if "family" in pool.columns else None
        close = next((x for x in kept if x in near.get(r.candidate_id, ())), None)
        reason = f"close to {close}" if close else "family full" if cap is not None and families.get(fam, 0) >= cap else "list full" if size is not None and len(kept) >= size else None
        if reason is None:
            kept.append(r.candidate_id)
            families[fam] = families.get(fam, 0) + 1
        out.append((r.candidate_id, reason is None, reason))
    return pool.sparkSession.createDataFrame(out, "candidate_id string, kept boolean, reason string")


def tokens(formula):
    """The identifiers in a formula."""
    return F.array_distinct(F.regexp_extract_all(formula, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))


def jaccard(a, b):
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.when(n > 0, n)).otherwise(0.0)


def family_of(formula, keywords: dict[str, str]):
    """The first family whose keyword the formula holds, else other."""
    out = F.lit("other")
    for family, pattern in reversed(list(keywords.items())):
        out = F.when(F.lower(formula).rlike(pattern), family).otherwise(out)
    return out


def composite(df: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Weighted unit ranks of metric columns, nulls one half."""
    return df.withColumn("composite", sum((w * diagnostics.unit_rank(F.col(x)) for x, w in parts.items()), F.lit(0.0)))


def dynamic_combination(spreads: DataFrame, window: int = 12, lag: int = 1) -> DataFrame:
    """(date, combined) of daily factor spreads (factor, date, spread): weights are the positive ratios of mean to deviation
    over ``window`` dates that end ``lag`` dates before; equal ones where none is positive."""
    w = Window.partitionBy("factor").orderBy(DATE).rowsBetween(-(lag + window - 1), -lag)
    dev = F.stddev_pop("spread").over(w)
    rows = spreads.withColumn("_ir", F.greatest(F.avg("spread").over(w) / F.when(dev > 1e-12, dev), F.lit(0.0)))
    day = Window.partitionBy(DATE)
    total = F.sum(F.coalesce("_ir", F.lit(0.0))).over(day)
    weight = F.when(total > 1e-12, F.coalesce("_ir", F.lit(0.0)) / F.when(total > 1e-12, total)).otherwise(1.0 / F.count(F.lit(1)).over(day))
    return rows.withColumn("_w", weight).groupBy(DATE).agg(F.sum(F.col("_w") * F.col("spread")).alias("combined"))


def perturbed(df: DataFrame, columns, noise: float = 0.05, dropout: float = 0.05, seed: int = 3) -> DataFrame:
    """Columns with noise in proportion to their deviation on the date, and with values dropped at random."""
    return df.withColumns({x: F.when(F.rand(seed + i) >= dropout, F.col(x) + noise * F.stddev_pop(x).over(C.section()) * F.randn(seed + 100 + i)) for i, x in enumerate(columns)})
