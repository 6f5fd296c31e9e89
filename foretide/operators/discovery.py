"""Which columns can take part in dependencies, which dependencies there are, and how good columns are.

All columns of a table are profiled in one job: rows are unpivoted to (column, token), counted with a
map-side combine, and reduced to a row for each column.  Candidate edges are counted the same way, over
(determinant, dependent, x, y).  Only the names of eligible columns, bounded by the schema, come to the
driver.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import NULL, token

#: Names of identifiers, of unsafe columns and of long texts, and the form of a GUID.
IDENTIFIER = r"(?i)(^id$|_id$|id$|^key$|_key$|uuid|hash)"
GUID_NAME = r"(?i)(uuid|guid|hash)"
UNSAFE = r"(?i)(url|email|phone|postal|zip)"
LONG_TEXT = r"(?i)(^|_)(text|body|title|comment|comments|description|summary|content)$"
GUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


@dataclass(frozen=True)
class Roles:
    """What a table's columns are known to be."""

    label: str | None = None
    entity: str | None = None
    primary_key: str | None = None
    foreign_keys: tuple[str, ...] = field(default_factory=tuple)
    source_entity: str | None = None
    time: str | None = None


def identifier_like(name: str) -> bool:
    return re.search(IDENTIFIER, name) is not None


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n): how often each value of each column occurs; v is null for missing ones."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(token(df, c), F.lit(NULL)).alias("v")) for c in columns)))
    return df.select(cells.alias("c")).groupBy("c.column", "c.v").agg(F.count(F.lit(1)).alias("n"))


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: rows, values, lengths, words, repeated values, share of GUIDs, entropy in bits."""
    columns = columns or scalar_columns(df)
    c = column_counts(df, columns).withColumn("text", F.substring("v", 3, 1 << 30))
    given = F.col("v").isNotNull()
    n = F.when(given, F.col("n")).otherwise(0)
    per = c.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(n).alias("non_null"), F.count("v").alias("cardinality"), F.try_divide(F.sum(n * F.length("text")), F.sum(n)).alias("mean_length"), F.max(F.length("text")).alias("max_length"),
        F.try_divide(F.sum(n * F.regexp_count("text", F.lit(r"\S+"))), F.sum(n)).alias("mean_words"), F.count_if(given & (F.col("n") > 1)).alias("repeated_values"), F.sum(F.when(given & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("repeated_rows"),
        F.try_divide(F.sum(F.when(F.col("text").rlike(GUID), n).otherwise(0)), F.sum(n)).alias("guid_share"), F.sum(n * F.log2(F.col("n").cast("double"))).alias("_nlogn"), F.sum(F.when(F.col("v").isin("n:+inf", "n:-inf"), F.col("n")).otherwise(0)).alias("_infinite"),
    )
    entropy = F.when(F.col("non_null") > 0, F.log2(F.col("non_null").cast("double")) - F.col("_nlogn") / F.col("non_null")).otherwise(0.0)
    finite = F.when(F.col("non_null") > 0, 1 - F.col("_infinite") / F.col("non_null")).otherwise(0.0)
    return per.select("column", "rows", "non_null", "cardinality", (F.col("cardinality") / F.greatest("non_null", F.lit(1))).alias("unique_ratio"), "mean_length", "max_length", "mean_words", "repeated_values", "repeated_rows", F.coalesce("guid_share", F.lit(0.0)).alias("guid_share"), entropy.alias("entropy"), finite.alias("finite_rate"))


def _named_reason(name: str, kind: T.DataType, roles: Roles) -> str | None:
    """What the schema alone excludes."""
    if name == roles.label:
        return "target_named_column_excluded"
    if name == roles.entity:
        return "entity_key_excluded"
    if name == roles.primary_key:
        return "primary_key_excluded"
    if name in roles.foreign_keys:
        return "foreign_key_excluded"
    if name == roles.source_entity:
        return "source_entity_column_excluded"
    if name == roles.time or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp_excluded"
    if re.search(UNSAFE, name):
        return "unsafe_name_excluded"
    return "guid_like_excluded" if re.search(GUID_NAME, name) else None


def _measured_reason(name: str, kind: T.DataType, most: int, most_unique: float) -> Column:
    """What a column's statistics exclude; null where it is eligible."""
    c, many, unique = F.col("cardinality"), F.col("cardinality") > most, F.col("unique_ratio") > most_unique
    out = F.when((F.col("non_null") <= 0) | (c <= 1), "constant_or_empty_excluded").when(F.col("guid_share") >= 0.8, "guid_like_excluded")
    if isinstance(kind, T.BooleanType):
        return out
    if isinstance(kind, T.NumericType):
        return out.when(unique, "surrogate_key_identity_excluded").when(many, "high_cardinality_numeric_excluded")
    if not isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return out.otherwise("unsafe_or_unknown")
    if re.search(LONG_TEXT, name):
        out = out.when(c > 16, "free_text_name_excluded")
    return out.when(many | (F.col("mean_length") > 80) | (F.col("max_length") > 256) | (F.col("mean_words") > 12), "free_text_or_high_cardinality_excluded").when(unique, "surrogate_key_identity_excluded")


def eligibility(df: DataFrame, roles: Roles, most: int = 64, most_unique: float = 0.95, least_support: int = 2) -> DataFrame:
    """column_statistics with `exclusion_reason` (as a dependent) and `determinant_reason`; null: eligible."""
    stats, kinds = column_statistics(df), {f.name: f.dataType for f in df.schema}
    reason = F.lit(None).cast("string")
    for name in scalar_columns(df):
        named = _named_reason(name, kinds[name], roles)
        reason = F.when(F.col("column") == name, F.lit(named) if named else _measured_reason(name, kinds[name], most, most_unique)).otherwise(reason)
    out = stats.withColumn("exclusion_reason", reason)
    single = (F.col("repeated_values") <= 0) | (F.col("repeated_rows") < least_support)
    determinant = F.coalesce("exclusion_reason", F.when(single, "determinant_repeated_support_below_minimum"), F.when(F.col("cardinality") / F.greatest("rows", F.lit(1)) > most_unique, "surrogate_key_identity_excluded"))
    return out.withColumn("determinant_reason", determinant)


def edges(df: DataFrame, table: str, audit: DataFrame, least_support: int = 2, least_coverage: float = 0.1, binned: frozenset[str] = frozenset()) -> DataFrame:
    """Every determinant with every dependent: edge_id, support, coverage, confidence, conflict_rate, status.

    A perfect dependency tells nothing new, two binned columns are no pair: both are rejected."""
    found = audit.select("column", "exclusion_reason", "determinant_reason").collect()  # one row a column
    left = sorted(r.column for r in found if r.determinant_reason is None)
    right = sorted(r.column for r in found if r.exclusion_reason is None)
    pairs = [(x, y) for x in left for y in right if x != y and not {x, y} <= binned]
    schema = "edge_id string, lhs string, rhs string, support long, coverage double, confidence double, conflict_rate double, status string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    value = lambda c: F.nullif(token(df, c), F.lit(NULL))
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("lhs"), F.lit(y).alias("rhs"), value(x).alias("x"), value(y).alias("y")) for x, y in pairs)))
    counts = df.select(cells.alias("c")).groupBy("c.lhs", "c.rhs", "c.x", "c.y").agg(F.count(F.lit(1)).alias("n"))
    both, given = F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("x").isNotNull()
    group = counts.groupBy("lhs", "rhs", "x").agg(F.sum(F.when(both, F.col("n")).otherwise(0)).alias("n"), F.count_if(both).alias("d"), F.sum("n").alias("rows"), F.sum(F.when(given, F.col("n")).otherwise(0)).alias("given"))
    s = group.groupBy("lhs", "rhs").agg(F.sum("n").alias("support"), (F.sum("given") / F.sum("rows")).alias("coverage"), (F.max("n") / F.nullif(F.sum("n"), F.lit(0))).alias("confidence"), (F.count_if(F.col("d") > 1) / F.nullif(F.count_if(F.col("d") > 0), F.lit(0))).alias("conflict_rate"))
    status = F.when(F.col("support") <= 0, "zero_support").when(F.col("support") < least_support, "support_below_minimum").when(F.col("coverage") <= least_coverage, "coverage_below_threshold").when(F.coalesce("conflict_rate", F.lit(0.0)) == 0, "constant_or_non_informative_edge").otherwise("accepted")
    return s.select(F.concat(F.lit(table + ":"), "lhs", F.lit("->"), "rhs").alias("edge_id"), "lhs", "rhs", "support", "coverage", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("conflict_rate", F.lit(0.0)).alias("conflict_rate"), status.alias("status"))


def rejection_counts(found: DataFrame, reason: str) -> DataFrame:
    """How often each reason occurs, most often first."""
    return found.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def earliest_fold_edges(source: DataFrame, time: str, folds: list[tuple], table: str, roles: Roles) -> DataFrame:
    """Discovery on the rows that the first fold's training side sees, and no others."""
    if not folds:
        raise ValueError("no_inner_folds")
    seen = source.filter(F.col(time) <= folds[0][0])
    return edges(seen, table, eligibility(seen, roles))


def schema_scores(df: DataFrame, numeric: list[str], categorical: list[str], most: int = 64) -> DataFrame:
    """(column, kind, score, rank): how much a column promises, by what its values look like."""
    s = column_statistics(df, [*numeric, *categorical])
    known, varied = F.col("non_null") / F.greatest("rows", F.lit(1)), (F.col("cardinality") > 1).cast("double")
    ratio = ((F.col("unique_ratio") > 0) & (F.col("unique_ratio") < 0.95)).cast("double")
    even = F.when(F.col("cardinality") > 1, F.col("entropy") / F.log2(F.col("cardinality").cast("double"))).otherwise(0.0)
    n = 0.35 * known + 0.25 * varied + 0.25 * F.col("finite_rate") + 0.15 * ratio
    c = 0.40 * known + 0.20 * varied + 0.20 * (F.col("cardinality") <= most).cast("double") + 0.20 * even
    is_number = F.col("column").isin(numeric) if numeric else F.lit(False)
    return s.select("column", F.when(is_number, "numeric").otherwise("categorical").alias("kind"), F.when(is_number, n).otherwise(c).alias("score"))


def usable_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, reason): why a feature column tells nothing; null where it may."""
    x = lambda c: F.col(c).cast("double")
    finite = lambda c: F.when(~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), x(c))
    s = df.agg(*(F.count(c).alias(f"a{i}") for i, c in enumerate(columns)), *(F.count(finite(c)).alias(f"b{i}") for i, c in enumerate(columns)), *(F.var_pop(finite(c)).alias(f"v{i}") for i, c in enumerate(columns)))
    out = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"v{i}").alias("v")) for i, c in enumerate(columns))))
    constant = F.when(F.col("column").endswith("__is_missing"), "constant_missing_indicator").otherwise("zero_variance")
    return s.select(out.alias("x")).select("x.*").select("column", F.when(F.col("a") == 0, "all_missing").when(F.col("b") == 0, "no_finite_value").when(F.col("v") == 0, constant).alias("reason"))


def cell_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of cells that aren't 0, population variance and distinct values over all cells of the columns."""
    cells = df.select(F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("v is not null")
    n = F.nullif(F.sum("n"), F.lit(0))
    mean = F.sum(F.col("n") * F.col("v")) / n
    return cells.agg((F.sum(F.when(F.col("v") != 0, F.col("n")).otherwise(0)) / n).alias("nonzero_rate"), F.greatest(F.sum(F.col("n") * F.col("v") * F.col("v")) / n - mean * mean, F.lit(0.0)).alias("variance"), F.count(F.lit(1)).alias("unique_values"))


def duplicate_columns(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """One row: how many columns repeat an earlier one cell by cell, by order-free digests of (row, value)."""
    digest = lambda c: F.concat_ws(":", F.sum(F.xxhash64(row_id, F.col(c).cast("string")).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), row_id, F.col(c).cast("string")).cast("decimal(38,0)")))
    sums = df.agg(*(digest(c).alias(f"d{i}") for i, c in enumerate(columns)))
    return sums.select(F.lit(len(columns)).cast("long").alias("columns"), (F.lit(len(columns)) - F.size(F.array_distinct(F.array(*(f"d{i}" for i in range(len(columns))))))).cast("long").alias("duplicate_columns"))


def suitability(fitted: DataFrame, least_groups: int = 2, least_rows: int = 2) -> DataFrame:
    """Of a fitted dependency map: groups with conflicts, rows that violate, and whether swaps have room."""
    wrong = F.round(F.col("support_count") * (1 - F.col("majority_confidence"))).cast("long")
    s = fitted.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("support_count"), F.lit(0)).alias("rows"), F.count_if(F.col("conflict_count") > 1).alias("conflicting_groups"), F.coalesce(F.sum(wrong), F.lit(0)).alias("violations"), F.count_if(F.col("support_count") > 1).alias("repeated_groups"))
    return s.withColumn("suitable", (F.col("groups") >= least_groups) & (F.col("rows") >= least_rows) & (F.col("repeated_groups") > 0))


def edge_means(scores: DataFrame, edge: str, measures: list[str]) -> DataFrame:
    """The mean of each measure over the seeds of an edge, and their number."""
    return scores.groupBy(edge).agg(F.count(F.lit(1)).alias("seeds"), *(F.avg(m).alias(m) for m in measures))
