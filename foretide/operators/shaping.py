"""Splits, train-visible rows, folds, profiles, coverage, encodings, block alignment."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def temporal_split(df: DataFrame, time: str, train_end, validation_end) -> tuple[DataFrame, DataFrame]:
    if not train_end < validation_end:
        raise ValueError("inverted_split")
    t = F.col(time)
    n = df.agg(F.count_if(t.isNull()).alias("none"), F.count_if(t <= train_end).alias("a"), F.count_if((t > train_end) & (t <= validation_end)).alias("b")).first()
    if n.none:
        raise ValueError("missing_split_time")
    if not n.a or not n.b:
        raise ValueError("empty_split")
    return df.filter(t <= train_end), df.filter((t > train_end) & (t <= validation_end))


def fit_table(source: DataFrame, train: DataFrame, s_key: str, t_key: str, s_time: str | None = None, t_time: str | None = None) -> DataFrame:
    """Source rows of train entities, up to each entity's last train cutoff if both times are given."""
    if (s_time is None) != (t_time is None):
        raise ValueError("one_sided_time")
    if s_time is None:
        return source.join(train.select(F.col(t_key).alias(s_key)).distinct(), s_key, "left_semi")
    last = train.groupBy(F.col(t_key).alias(s_key)).agg(F.max(t_time).alias("_last"))
    return source.join(last, s_key).filter(F.col(s_time) <= F.col("_last")).drop("_last")


def inner_folds(df: DataFrame, time: str, folds: int) -> list[tuple]:
    """(train up to, validation up to) for each expanding fold.  One fold cuts at ceil(0.8 U) of the U
    distinct times; more take the last two fifths in equal chunks, larger ones first.  The distinct
    times are ranked in the cluster; only the cuts come here."""
    times = df.select(F.col(time).alias("t")).filter("t is not null").distinct()
    u = times.count()
    if u < 2:
        return []
    if folds == 1:
        cut = min(max(1, math.ceil(0.8 * u)), u - 1)
        ends = [cut, u]
    else:
        start = min(max(1, u - math.ceil(0.4 * u)), u - 1)
        k = min(folds, u - start)
        size, more = divmod(u - start, k)
        ends = [start]
        for i in range(k):
            ends.append(ends[-1] + size + (i < more))
    ranked = times.withColumn("r", F.row_number().over(Window.orderBy("t"))).filter(F.col("r").isin(ends))
    at = {r.r: r.t for r in ranked.collect()}
    return [(at[a], at[b]) for a, b in zip(ends, ends[1:])]


def coverage(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Referential coverage of non-null keys, and orphans."""
    j = child.filter(F.col(fk).isNotNull()).select(F.col(fk).alias("_k")).join(parent.select(F.col(pk).alias("_k")).distinct().withColumn("_in", F.lit(1)), "_k", "left")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("_in").isNotNull().cast("double")).alias("coverage"), F.coalesce(F.sum(F.col("_in").isNull().cast("long")), F.lit(0)).alias("orphans"))


def history_coverage(targets: DataFrame, key: str, t_time: str, child: DataFrame, c_key: str, c_time: str, strict: bool) -> DataFrame:
    first = child.groupBy(F.col(c_key).alias("_k")).agg(F.min(c_time).alias("_first"))
    j = targets.select(F.col(key).alias("_k"), F.col(t_time).alias("_t")).join(first, "_k", "left")
    seen = (F.col("_first") < F.col("_t")) if strict else (F.col("_first") <= F.col("_t"))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.coalesce(seen, F.lit(False)).cast("double")).alias("history_coverage"))


def nested(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, distinct values, uniqueness, constancy.  One job for all."""
    flat = [c for c in df.columns if c not in nested(df)]
    s = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(f"a_{i}") for i, c in enumerate(flat)), *(F.countDistinct(c).alias(f"b_{i}") for i, c in enumerate(flat)))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), F.col(f"a_{i}").alias("a"), F.col(f"b_{i}").alias("distinct_count")) for i, c in enumerate(flat)))).alias("x")
    out = s.select(each).select("x.*")
    return out.select("column", "rows", ((F.col("rows") - F.col("a")) / F.col("rows")).alias("null_fraction"), "distinct_count", ((F.col("a") == F.col("rows")) & (F.col("distinct_count") == F.col("rows"))).alias("unique_non_null"), (F.col("distinct_count") <= 1).alias("constant"))


ORDINAL, LOW, FREE = 16, 64, 256


def semantics(df: DataFrame, primary_key: str | None = None, foreign_keys=()) -> DataFrame:
    """A class for each column: from its type, its name and its profile."""
    stats = profile(df)
    lengths = {c.name: None for c in df.schema if isinstance(c.dataType, T.StringType)}
    if lengths:
        r = df.agg(*(F.avg(F.length(c)).alias(c) for c in lengths)).first()
        lengths = r.asDict()
    kinds = {f.name: f.dataType for f in df.schema}
    c, d, out = F.col("column"), F.col("distinct_count"), None

    def name_of(col: str):
        k = kinds[col]
        if col in foreign_keys:
            return F.lit("foreign_key")
        if col == primary_key or col.lower().endswith(("id", "key")):
            return F.lit("identifier")
        if isinstance(k, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.lit("timestamp")
        if isinstance(k, T.BooleanType):
            return F.lit("boolean")
        if isinstance(k, T.NumericType):
            return F.when(d <= ORDINAL, "ordinal").otherwise("continuous") if isinstance(k, T.IntegralType) else F.lit("continuous")
        return F.when((d > FREE) | F.lit((lengths.get(col) or 0) > 80), "free_text").when(d <= LOW, "low_cardinality_categorical").otherwise("high_cardinality_categorical")

    out = F.lit(None).cast("string")
    for col in kinds:
        if col not in nested(df):
            out = F.when(c == col, name_of(col)).otherwise(out)
    return stats.select("column", "distinct_count", out.alias("semantic"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def scalarize(df: DataFrame, column: str) -> DataFrame:
    """An array as columns col__0 .. col__{n-1}, n being the longest; missing places are null."""
    n = df.agg(F.max(F.size(column))).first()[0] or 0
    return df.select(*(c for c in df.columns if c != column), *(F.get(column, F.lit(i)).alias(f"{column}__{i}") for i in range(max(n, 0))))


def label_codes(df: DataFrame, column: str, start: int = 1) -> DataFrame:
    """(column, code): codes of the sorted distinct values.  Distinct values first, so the ranking
    sees one row a value."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1 + start)


def static_features(targets: DataFrame, key: str, entity: DataFrame, pk: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    one = keep_first(entity, [pk], [pk])
    for c in categorical:
        one = one.join(label_codes(one, c).withColumnRenamed("code", f"{c}__code"), c, "left")
    return targets.join(one.select(F.col(pk).alias(key), *numeric, *(f"{c}__code" for c in categorical)), key, "left")


def train_encoding(train: DataFrame, other: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """`other` encoded by what train shows: medians for missing and infinite numbers, indices of sorted
    train categories, -1 for unseen ones."""
    finite = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double"))
    medians = train.agg(*(F.percentile(finite(c), F.lit(0.5)).alias(c) for c in numeric)).first().asDict() if numeric else {}
    for c in categorical:
        other = other.join(label_codes(train, c, 0).withColumnRenamed("code", f"{c}__code"), c, "left").withColumn(f"{c}__code", F.coalesce(f"{c}__code", F.lit(-1)))
    return other.withColumns({c: F.coalesce(finite(c), F.lit(medians[c]), F.lit(0.0)) for c in numeric})


def align(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """One-to-one join of feature blocks in one pass; reading it raises on missing, extra or repeated rows."""
    one = right.withColumn("_again", F.count(F.lit(1)).over(Window.partitionBy(row_id))).withColumnRenamed(row_id, "_right")
    j = left.join(one, F.col(row_id) == F.col("_right"), "full")
    fault = F.when(F.col("_right").isNull(), "missing_rows").when(F.col(row_id).isNull(), "extra_rows").when(F.col("_again") > 1, "repeated_rows")
    return j.filter(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))).select(*left.columns, *(c for c in right.columns if c != row_id))


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), row_id), row_id).limit(n)
