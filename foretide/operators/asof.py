"""Point-in-time operators: one shuffle by key, one sort, one window pass.

Target and source rows are united with a tag; the tag's place in the order decides whether a source
row at the target's own time counts (`strict=False`) or not.  Rows of a target without time or key
match nothing; source rows without time or key are dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import DAY, days, micros


def _united(targets: DataFrame, source: DataFrame, row_id: str, key: list[str], t_time: str, s_key: list[str], s_time: str, cols: list[str], tie: list[str], strict: bool) -> DataFrame:
    names = [f"_k{i}" for i in range(len(key))]
    ties = [f"_tie{i}" for i in range(len(tie))]
    s = source.select(*(F.col(a).alias(b) for a, b in zip(s_key, names)), micros(s_time).alias("_t"), F.lit(1 if strict else 0).alias("_tag"), *(F.col(a).alias(b) for a, b in zip(tie, ties)), F.struct(F.col(s_time).alias("_time"), *cols).alias("_row"))
    s = s.filter(F.col("_t").isNotNull() & F.greatest(*(F.col(n).isNull().cast("int") for n in (*names, names[0]))).eqNullSafe(0))
    t = targets.select(F.col(row_id).alias("_id"), *(F.col(a).alias(b) for a, b in zip(key, names)), micros(t_time).alias("_t"), F.lit(0 if strict else 1).alias("_tag"))
    return t.unionByName(s, allowMissingColumns=True)


def asof_join(targets: DataFrame, source: DataFrame, row_id: str, key: list[str], t_time: str, s_time: str, cols: list[str], tie: list[str], strict: bool = False, s_key: list[str] | None = None) -> DataFrame:
    """row_id, matched_time and cols of the latest source row at (or strictly before) each target's
    time; among equal times the last by `tie`.  A latest row's nulls are returned as they are."""
    u = _united(targets, source, row_id, key, t_time, s_key or key, s_time, cols, tie, strict)
    ties = [c for c in u.columns if c.startswith("_tie")]
    w = Window.partitionBy(*[c for c in u.columns if c.startswith("_k")]).orderBy("_t", "_tag", *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = u.withColumn("_got", F.when(F.col("_t").isNotNull(), F.last("_row", True).over(w))).filter(F.col("_row").isNull())
    return found.select(F.col("_id").alias(row_id), F.col("_got._time").alias("matched_time"), *(F.col(f"_got.{c}").alias(c) for c in cols))


def asof_audit(matched: DataFrame, targets: DataFrame, row_id: str, t_time: str) -> DataFrame:
    """Counts of rows, matches, matches in the future and at the very time."""
    j = targets.select(row_id, F.col(t_time).alias("_t")).join(matched.select(row_id, "matched_time"), row_id)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    m = F.col("matched_time")
    return j.agg(F.count(F.lit(1)).alias("rows"), n(m.isNotNull()).alias("matched"), n(m > F.col("_t")).alias("future"), n(m == F.col("_t")).alias("exact"))


def strict_prior(targets: DataFrame, source: DataFrame, row_id: str, key: list[str], t_time: str, s_time: str, windows: dict[str, int], related: str | None = None, s_key: list[str] | None = None) -> DataFrame:
    """Counts in [T - W, T) days, distinct related values (nulls excluded) there, all-history count
    and days since the last event, 0 with an indicator where there is none."""
    cols = [related] if related else []
    u = _united(targets, source, row_id, key, t_time, s_key or key, s_time, cols, [], True)
    by = Window.partitionBy(*[c for c in u.columns if c.startswith("_k")]).orderBy("_t")
    is_row, past = F.col("_row").isNotNull(), by.rangeBetween(Window.unboundedPreceding, -1)
    out: list[Column] = []
    for name, n in windows.items():
        span = by.rangeBetween(-n * DAY, -1)
        out.append(F.count(F.when(is_row, 1)).over(span).alias(f"count_{name}"))
        if related:
            out.append(F.size(F.collect_set(F.col(f"_row.{related}")).over(span)).cast("long").alias(f"unique_{name}"))
    last = F.max(F.when(is_row, F.col("_t"))).over(past)
    out += [F.count(F.when(is_row, 1)).over(past).alias("prior_count"), F.coalesce(days(F.col("_t"), last), F.lit(0.0)).alias("days_since_last"), last.isNull().cast("int").alias("days_since_last_missing")]
    return u.select("_id", "_row", *out).filter(F.col("_row").isNull()).drop("_row").withColumnRenamed("_id", row_id)


def history(targets: DataFrame, source: DataFrame, row_id: str, key: list[str], t_time: str, s_time: str, numeric: str, category: str, tie: list[str], strict: bool = False, s_key: list[str] | None = None) -> DataFrame:
    """Running count, mean, population std, min, max, last, distinct count, recency, span and frequency
    of a key's events as of each target: one pass for all, plus one to mark first occurrences."""
    first = F.row_number().over(Window.partitionBy(*(s_key or key), category).orderBy(s_time, *tie)) == 1
    marked = source.withColumn("_first", (first & F.col(category).isNotNull()).cast("int"))
    u = _united(targets, marked, row_id, key, t_time, s_key or key, s_time, [numeric, "_first"], tie, strict)
    ties = [c for c in u.columns if c.startswith("_tie")]
    w = Window.partitionBy(*[c for c in u.columns if c.startswith("_k")]).orderBy("_t", "_tag", *ties).rowsBetween(Window.unboundedPreceding, 0)
    x, is_row = F.col(f"_row.{numeric}").cast("double"), F.col("_row").isNotNull()
    t = F.when(is_row, F.col("_t"))
    n, mean = F.count(F.when(is_row, 1)).over(w), F.avg(x).over(w)
    latest, earliest = F.max(t).over(w), F.min(t).over(w)
    span = days(latest, earliest)
    u = u.select(
        "_id", "_row", "_t", n.cast("double").alias("count"), mean.alias("mean"), F.when(mean.isNotNull(), F.sqrt(F.greatest(F.avg(x * x).over(w) - mean * mean, F.lit(0.0)))).alias("std"), F.min(x).over(w).alias("min"), F.max(x).over(w).alias("max"), F.last(x, True).over(w).alias("last"),
        F.coalesce(F.sum(F.col("_row._first")).over(w), F.lit(0)).cast("double").alias("nunique"), days(F.col("_t"), latest).alias("days_since_last"), span.alias("active_span_days"), (n / F.nullif(span, F.lit(0.0))).alias("event_frequency"),
    )
    return u.filter(F.col("_row").isNull()).drop("_row", "_t").withColumnRenamed("_id", row_id)


def with_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *(F.col(c).isNull().cast("int").alias(f"{c}__is_missing") for c in columns))


def activity(left: Column, right: Column) -> tuple[Column, Column]:
    """Product and ratio of two activities."""
    return left * right, left / F.greatest(right, F.lit(1.0))
