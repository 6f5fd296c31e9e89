"""Metrics of predictions as aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, column: str, name: str, by: list[str] = ()) -> DataFrame:
    """Average ranks: values are counted first, so ranking sees one row a value."""
    c = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy(column))
    return df.join(c.select(*by, column, (upto - (F.col("_m") - 1) / 2).alias(name)), [*by, column])


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts per score; ties count half."""
    c = df.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    below = F.sum("n").over(Window.orderBy(score)) - F.col("n") / 2
    return c.select("p", "n", below.alias("b")).agg((F.sum(F.col("p") * F.col("b")) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    c = df.groupBy(score).agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(F.desc(score))
    return c.select("p", (F.sum("p").over(w) / F.sum("m").over(w)).alias("precision")).agg((F.sum(F.col("p") * F.col("precision")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy, macro, micro and weighted F1 from the confusion counts."""
    c = df.groupBy(y, p).agg(F.count(F.lit(1)).alias("n"))
    long = c.select(F.col(y).alias("k"), F.col("n").alias("t"), F.lit(0).alias("q"), F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).alias("h")).union(c.select(p, F.lit(0), "n", F.lit(0)))
    g = long.groupBy("k").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("h").alias("h")).withColumn("f", 2 * F.col("h") / (F.col("t") + F.col("q")))
    return g.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg("f").alias("macro_f1"), (2 * F.sum("h") / (F.sum("t") + F.sum("q"))).alias("micro_f1"), (F.sum(F.col("f") * F.col("t")) / F.sum("t")).alias("weighted_f1"))


def log_loss(y: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    r = average_rank(average_rank(df, x, "_rx"), y, "_ry")
    return r.agg(F.corr("_rx", "_ry").alias("rho"))


def quartile_summary(df: DataFrame, x: str, v: str) -> DataFrame:
    """Right-closed quartiles of x: rows, mean, median and positive share of v."""
    q = df.agg(F.percentile(F.col(x).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    i = F.when(F.col(x) <= F.col("q")[0], 1).when(F.col(x) <= F.col("q")[1], 2).when(F.col(x) <= F.col("q")[2], 3).otherwise(4)
    return df.crossJoin(F.broadcast(q)).groupBy(i.alias("quartile")).agg(F.count(F.lit(1)).alias("rows"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg((F.col(v) > 0).cast("double")).alias("positive_fraction"))  # q is one row


def seed_summary(df: DataFrame, by: list[str], v: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_sample"), F.stddev_pop(v).alias("std_population"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("sem"))


def fold_gain_summary(df: DataFrame, edge: str, gain: str, folds: int, delta: float = 0.0) -> DataFrame:
    """Edge screening: mean gain above delta and enough positive folds."""
    g = df.groupBy(edge).agg(F.avg(gain).alias("mean_gain"), F.min(gain).alias("worst_gain"), F.sum((F.col(gain) > 0).cast("long")).alias("positive_folds"))
    return g.withColumn("selected", (F.col("mean_gain") > delta) & (F.col("positive_folds") >= (folds + 1) // 2))


def every_seed_gate(df: DataFrame, by: list[str], gain: str, delta: float = 0.0) -> DataFrame:
    return df.groupBy(*by).agg(F.min(gain).alias("worst"), (F.min(gain) > delta).alias("passes"))


def win_tie_loss(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    d = F.col(delta)
    return df.groupBy(*by).agg(n(d > 0).alias("wins"), n(d == 0).alias("ties"), n(d < 0).alias("losses"), F.avg(d).alias("mean_delta"))
