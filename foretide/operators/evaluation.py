"""Preparation of feature and label columns for evaluators, pooled predictions, ranks of true classes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column) -> Column:
    """A number where the value reads as one, else null."""
    return F.trim(c.cast("string")).try_cast("double")


def canonical_label(df: DataFrame, column: str) -> Column:
    """Labels as text: whole numbers without a fraction, others as they are written, blanks as null."""
    c, kind = F.col(column), df.schema[column].dataType
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("string")
    whole = text.try_cast("double")
    return F.when(F.isnan(whole), None).when((whole == F.round(whole)) & (F.abs(whole) < 1e15), whole.cast("long").cast("string")).otherwise(text)


def known_classes(train: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """Rows of `other` whose class train has seen."""
    seen = train.select(canonical_label(train, label).alias("_l")).filter("_l is not null").distinct()
    return other.withColumn("_l", canonical_label(other, label)).join(seen, "_l", "left_semi").drop("_l")


def joint_codes(train: DataFrame, other: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with categories as codes from 0 over the sorted values of both; missing ones are -1.
    Distinct values are ranked, one row each, and joined back."""
    for c in columns:
        values = train.select(F.col(c).alias("_v")).unionByName(other.select(F.col(c).alias("_v"))).filter("_v is not null").distinct()
        codes = values.withColumn("_code", F.row_number().over(Window.orderBy("_v")) - 1)
        put = lambda df: df.join(codes, F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")  # noqa: B023, E731
        train, other = put(train), put(other)
    return train, other


def binary_features(train: DataFrame, other: DataFrame, numeric: list[str], categorical: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with codes for categories, 0 for missing and infinite numbers, and without the columns
    that are constant in train; `other` has train's columns."""
    train, other = joint_codes(train, other, categorical)
    fine = lambda c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")), F.lit(0.0))
    train, other = train.withColumns({c: fine(c) for c in numeric}), other.withColumns({c: fine(c) for c in numeric if c in other.columns} | {c: F.lit(0.0) for c in numeric if c not in other.columns})
    cols = [*numeric, *categorical]
    r = train.agg(*((F.min(c) < F.max(c)).alias(c) for c in cols)).first().asDict()
    used = [c for c in cols if r[c]]
    return train.select(*keep, *used), other.select(*keep, *used), used


def pooled(folds: list[DataFrame]) -> DataFrame:
    """Out-of-fold predictions of all folds, each row with its fold."""
    return reduce(DataFrame.unionByName, [f.withColumn("fold", F.lit(i)) for i, f in enumerate(folds)])


def featurised_together(train: DataFrame, other: DataFrame, features) -> tuple[DataFrame, DataFrame]:
    """features(all rows) for both sides in one plan, split back by a tag that it must keep."""
    both = train.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    out = features(both)
    if "_side" not in out.columns:
        raise ValueError("side_lost")
    return out.filter("_side = 0").drop("_side"), out.filter("_side = 1").drop("_side")


def mrr(scores: DataFrame, row_id: str, cls: str, score: str, truth: str) -> DataFrame:
    """Mean reciprocal rank of the true class among a row's classes; ties count by class order."""
    place = F.row_number().over(Window.partitionBy(row_id).orderBy(F.desc(score), cls))
    own = scores.withColumn("_r", place).groupBy(row_id).agg(F.max(F.when(F.col(cls) == F.col(truth), 1 / F.col("_r")).otherwise(0.0)).alias("r"))
    return own.agg(F.avg("r").alias("mrr"), F.count(F.lit(1)).alias("rows"))


def single_edge(targets: DataFrame, key: str, source: DataFrame, s_key: str, fitted: DataFrame, lhs: Column, statistics: list[str]) -> DataFrame:
    """Statistics of a dependency for each target through a source without time: one row an entity, else it
    raises; missing ones come with indicators."""
    one = source.select(F.col(s_key).alias("_k"), lhs.alias("lhs")).groupBy("_k").agg(F.first("lhs").alias("lhs"), F.count(F.lit(1)).alias("_n"))
    one = one.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("source_entity_not_unique")).cast("boolean"))).drop("_n")
    j = targets.join(one, F.col(key) == F.col("_k"), "left").drop("_k").join(fitted.select("lhs", *statistics), "lhs", "left").drop("lhs")
    return j.select("*", *(F.col(s).isNull().cast("int").alias(f"{s}__is_missing") for s in statistics))


def seconds(text: Column) -> Column:
    """Elapsed times written s, m:s or h:m:s as seconds; null for others."""
    parts = F.reverse(F.split(F.trim(text), ":"))
    good = F.trim(text).rlike(r"^(?:\d+:)?(?:\d+:)?\d+(?:\.\d+)?$")
    return F.when(good, F.aggregate(F.transform(parts, lambda p, i: p.cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x))
