"""Approximate functional dependencies X -> Y: maps, summaries, reliability, features."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import token
from .asof import asof_join


def pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(lhs, rhs, n) of rows where both are given; counts combine before the shuffle."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(token(df, x).alias("lhs"), token(df, y).alias("rhs")).agg(F.count(F.lit(1)).alias("n"))


def ambiguity_map(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per X: majority_confidence, entropy (natural, 1e-12 inside the log), conflict_count,
    support_count, top1_margin."""
    total = F.sum("n").over(Window.partitionBy("lhs"))
    p = F.col("n") / F.col("total")
    c = pair_counts(df, x, y).withColumn("total", total).withColumn("r", F.row_number().over(Window.partitionBy("lhs").orderBy(F.desc("n"), "rhs")))
    n1, n2 = F.max(F.when(F.col("r") == 1, F.col("n"))), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0))
    return c.groupBy("lhs").agg((n1 / F.max("total")).alias("majority_confidence"), (-F.sum(p * F.log(p + 1e-12))).alias("entropy"), F.count(F.lit(1)).alias("conflict_count"), F.max("total").alias("support_count"), ((n1 - n2) / F.max("total")).alias("top1_margin"))


def edge_summary(fitted: DataFrame, df: DataFrame, x: str) -> DataFrame:
    """support, mean confidence, share of X with conflicts, coverage of the distinct X, acceptance."""
    known = df.filter(F.col(x).isNotNull()).agg(F.countDistinct(x).alias("distinct_lhs"))
    s = fitted.agg(F.coalesce(F.sum("support_count"), F.lit(0)).alias("support"), F.avg("majority_confidence").alias("confidence"), F.avg((F.col("conflict_count") > 1).cast("double")).alias("conflict_rate"), F.count(F.lit(1)).alias("groups"))
    out = s.crossJoin(F.broadcast(known)).withColumn("coverage", F.col("groups") / F.col("distinct_lhs"))  # one row each
    return out.withColumn("status", F.when(F.col("support") <= 0, "zero_support").when(F.col("coverage") <= 0.1, "coverage_below_threshold").otherwise("accepted")).drop("distinct_lhs")


def reliability(df: DataFrame, x: str, y: str) -> DataFrame:
    """Label-free reliability of the edge, leave-one-out included."""
    c = pair_counts(df, x, y)
    by = Window.partitionBy("lhs")
    best = Window.partitionBy("lhs").orderBy(F.desc("n"), "rhs")
    c = c.withColumn("total", F.sum("n").over(by)).withColumn("r", F.row_number().over(best))
    # Leaving one row of (x, y) out, y stays the mode unless another value then comes first.
    top = lambda k, v: F.max(F.when(F.col("r") == k, F.col(v))).over(by)
    c = c.withColumn("on", F.when(F.col("r") == 1, top(2, "n")).otherwise(top(1, "n"))).withColumn("oy", F.when(F.col("r") == 1, top(2, "rhs")).otherwise(top(1, "rhs")))
    left = F.col("n") - 1
    right = (left > 0) & (F.col("on").isNull() | (F.col("on") < left) | ((F.col("on") == left) & (F.col("rhs") < F.col("oy"))))
    p = F.col("n") / F.col("total")
    g = c.groupBy("lhs").agg(F.max("total").alias("total"), F.max("n").alias("top"), F.sum(-p * F.log(p)).alias("h"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("loo"))
    values = c.agg(F.countDistinct("rhs").alias("v"))
    many = F.col("total") >= 2
    total, non = F.sum("total"), F.sum(F.when(many, F.col("total")).otherwise(0))
    out = g.agg(
        total.alias("support"), F.count(F.lit(1)).alias("groups"), (F.sum("top") / total).alias("raw_reliability"), (non / total).alias("non_singleton_coverage"), (F.sum(F.when(many, F.col("top")).otherwise(0)) / F.nullif(non, F.lit(0))).alias("non_singleton_reliability"),
        (F.sum(F.col("total") * F.col("h")) / total).alias("_h"), (F.sum(F.when(many, F.col("loo")).otherwise(0)) / F.nullif(non, F.lit(0))).alias("loo_predictability"), F.avg((~many).cast("double")).alias("singleton_group_ratio"), F.avg("total").alias("mean_group_size"), F.percentile("total", F.lit(0.5)).alias("median_group_size"), F.max("total").alias("max_group_size"),
    )
    out = out.crossJoin(F.broadcast(values))  # one row each
    h = F.when(F.col("v") <= 1, 0.0).otherwise(F.col("_h") / F.log(F.col("v").cast("double")))
    return out.withColumn("normalized_entropy", h).withColumn("reliability_entropy", 1 - F.col("normalized_entropy")).drop("_h", "v")


def violations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per X the dominant Y (ties: smallest), rows that violate it and slots to receive swaps."""
    c = pair_counts(df, x, y)
    r = F.row_number().over(Window.partitionBy("lhs").orderBy(F.desc("n"), "rhs"))
    c = c.withColumn("r", r)
    g = c.groupBy("lhs").agg(F.max(F.when(F.col("r") == 1, F.col("rhs"))).alias("dominant"), F.sum("n").alias("support"), F.max("n").alias("top"))
    return g.select("lhs", "dominant", "support", (F.col("support") - F.col("top")).alias("violations"), F.greatest(F.lit(0), F.floor(F.col("support") / 2) - (F.col("support") - F.col("top"))).cast("long").alias("receive_slots"))


def discovery_stats(df: DataFrame, edges: list[tuple[str, str]], table: str, most: int = 64) -> DataFrame:
    """Support, coverage, largest group's share and conflict rate of each candidate edge, ranked.
    Perfect dependencies are rejected as uninformative."""
    out = None
    rows = df.count()
    for x, y in edges:
        g = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.count(y).alias("n"), F.countDistinct(y).alias("d"))
        s = g.agg(F.sum("n").alias("support"), (F.sum("n") / F.lit(max(rows, 1))).alias("coverage"), (F.max("n") / F.sum("n")).alias("confidence"), F.avg((F.col("d") > 1).cast("double")).alias("conflict_rate"), F.max("d").alias("most"))
        s = s.select(F.lit(f"{table}:{x}->{y}").alias("edge_id"), "support", "coverage", "confidence", "conflict_rate", F.when(F.col("most") <= 1, "constant_or_non_informative_edge").when(F.col("support") < 2, "support_below_threshold").when(F.col("coverage") <= 0.1, "coverage_below_threshold").otherwise("accepted").alias("status"))
        out = s if out is None else out.unionByName(s)
    return out.orderBy(F.desc("conflict_rate"), F.desc("support"), "edge_id").limit(most)


STATS = ("majority_confidence", "entropy", "conflict_count", "support_count", "top1_margin")


def features(targets: DataFrame, source: DataFrame, row_id: str, key: str, t_time: str, s_time: str, x: str, y: str, tie: list[str], horizon, table: str, strict: bool = True, start: str = "f_fd__") -> DataFrame:
    """The edge's five statistics and indicators for each target: X as of the target's time, looked
    up in the map fitted on all source rows up to the horizon."""
    fitted = ambiguity_map(source.filter(F.col(s_time) <= horizon), x, y)
    got = asof_join(targets, source, row_id, [key], t_time, s_time, [x], tie, strict)
    joined = got.withColumn("lhs", token(got, x)).join(fitted, "lhs", "left")
    prefix = f"{start}{table}:{x}__to__{y}__"
    return joined.select(row_id, *(F.col(s).cast("double").alias(prefix + s) for s in STATS), *(F.col(s).isNull().cast("int").alias(f"{prefix}{s}__is_missing") for s in STATS))
