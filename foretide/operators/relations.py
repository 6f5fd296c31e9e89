"""Relations between tables: which keys hold, which relations serve a task, what features they give.

Metadata rules are decided on the driver (a row for each foreign key of the catalog); what needs data
is one aggregate for each key that passes them.
"""
from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import token
from ..sources.catalog import TableDef
from .shaping import history_coverage

RELATION = ("count", "days_since_last", "active_span_days", "event_frequency")
NUMERIC = ("mean", "std", "min", "max", "last")


def comparable(a: T.DataType, b: T.DataType) -> bool:
    return a == b or isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)


def join_keys(left: DataFrame, a: str, right: DataFrame, b: str) -> tuple[Column, Column]:
    """Both keys in one type: whole numbers as long, equal types as they are, all else as value tokens
    (a fraction never meets the whole number that it would be cut to)."""
    x, y = left.schema[a].dataType, right.schema[b].dataType
    if isinstance(x, T.IntegralType) and isinstance(y, T.IntegralType):
        return left[a].cast("long"), right[b].cast("long")
    return (left[a], right[b]) if x == y else (token(left, a), token(right, b))


def key_statistics(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: rows, non-null keys, coverage, orphans, and whether the parent's key is one."""
    x, y = join_keys(child, fk, parent, pk)
    per = parent.select(y.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("p"))
    keys = child.select(x.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # a key once, so no key is hot
    j = keys.join(per, "k", "full")
    n, given = F.coalesce("n", F.lit(0)), F.col("k").isNotNull()
    s = j.agg(F.sum(n).alias("rows"), F.sum(F.when(given, n).otherwise(0)).alias("keys"), F.sum(F.when(given & F.col("p").isNull(), n).otherwise(0)).alias("orphans"), (F.coalesce(F.max(F.when(given, F.col("p"))), F.lit(0)) <= 1).alias("one"), F.count_if(F.col("p").isNotNull() & ~given).alias("null_keys"))
    return s.select("rows", F.when(F.col("keys") > 0, 1 - F.col("orphans") / F.col("keys")).otherwise(0.0).alias("coverage"), "orphans", (F.col("one") & (F.col("null_keys") == 0)).alias("parent_key_proven"))


def foreign_keys(tables: Mapping[str, DataFrame], catalog: Mapping[str, TableDef], least_coverage: float = 0.98) -> DataFrame:
    """Every foreign key of the catalog, held against the data."""
    out = []
    for name in sorted(catalog):
        for fk, parent in sorted(catalog[name].foreign_keys.items()):
            pk = catalog[parent].primary_key
            s = key_statistics(tables[name], fk, tables[parent], pk)
            fits = comparable(tables[name].schema[fk].dataType, tables[parent].schema[pk].dataType)
            status = F.when(F.lit(not fits), "fk_dtype_incompatible").when(~F.col("parent_key_proven"), "parent_key_not_unique").when((F.col("coverage") < least_coverage) | (F.col("orphans") > 0), "referential_integrity_failure").otherwise("accepted")
            out.append(s.select(F.lit(name).alias("child_table"), F.lit(fk).alias("child_fk"), F.lit(parent).alias("parent_table"), "rows", "coverage", "orphans", status.alias("status")))
    return reduce(DataFrame.unionByName, out)


def resolve(found: DataFrame) -> DataFrame:
    """Of the keys between two tables: the accepted one, `ambiguous_foreign_key` where there are more,
    else the failure."""
    n = F.count_if(F.col("status") == "accepted").alias("accepted")
    return found.groupBy("child_table", "parent_table").agg(n, F.min("status").alias("first"), F.min(F.when(F.col("status") == "accepted", F.col("child_fk"))).alias("child_fk")).select("child_table", "parent_table", F.when(F.col("accepted") == 1, F.col("child_fk")).alias("child_fk"), F.when(F.col("accepted") == 1, "accepted").when(F.col("accepted") > 1, "ambiguous_foreign_key").otherwise(F.col("first")).alias("resolution"))


def relation_candidates(tables: Mapping[str, DataFrame], catalog: Mapping[str, TableDef], entity: str, target_table: str, targets: DataFrame, key: str, time: str, least_coverage: float = 0.98) -> DataFrame:
    """Every foreign key as a relation of the task, with the reason why it is not one.  A relation of the
    target table to itself sees strictly earlier rows only."""
    out, spark = [], targets.sparkSession
    for name in sorted(catalog):
        t = catalog[name]
        for fk, parent in sorted(t.foreign_keys.items()):
            pk = catalog[parent].primary_key
            reason = None
            if parent != entity:
                reason = "foreign_key_not_task_entity"
            elif name == entity:
                reason = "same_table_relation"
            elif fk not in tables[name].columns:
                reason = "missing_child_fk"
            elif not t.event_time:
                reason = "missing_child_event_time"
            elif not comparable(tables[name].schema[fk].dataType, tables[parent].schema[pk].dataType):
                reason = "fk_dtype_incompatible"
            head = [F.lit(name).alias("child_table"), F.lit(fk).alias("child_fk"), F.lit(t.event_time).cast("string").alias("event_time"), F.lit(name == target_table).alias("strict")]
            if reason:
                out.append(spark.range(1).select(*head, F.lit(None).cast("long").alias("child_rows"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("double").alias("history_coverage"), F.lit(reason).alias("status")))
                continue
            s = key_statistics(tables[name], fk, tables[parent], pk)
            h = history_coverage(targets, key, time, tables[name], fk, t.event_time, name == target_table).select("history_coverage")
            status = F.when(F.col("coverage") < least_coverage, "referential_coverage_below_threshold").when(F.col("history_coverage") <= 0, "no_source_data_before_training_targets").otherwise("accepted")
            out.append(s.crossJoin(F.broadcast(h)).select(*head, F.col("rows").alias("child_rows"), "coverage", "history_coverage", status.alias("status")))  # one row each
    return reduce(DataFrame.unionByName, out)


def rank_relations(found: DataFrame) -> DataFrame:
    """relation_rank: accepted ones first, then by history, coverage, rows and name.  A catalog's few rows."""
    order = [F.when(F.col("status") == "accepted", 0).otherwise(1), F.desc_nulls_last("history_coverage"), F.desc_nulls_last("coverage"), F.desc_nulls_last("child_rows"), "child_table", "child_fk"]
    return found.withColumn("relation_rank", F.row_number().over(Window.orderBy(*order)))


def choose_relation(ranked: DataFrame, explicit: tuple[str, str] | None = None) -> DataFrame:
    """The named relation, else the only accepted one, else the best ranked; names how it was chosen."""
    good = ranked.filter("status = 'accepted'")
    if explicit:
        return good.filter((F.col("child_table") == explicit[0]) & (F.col("child_fk") == explicit[1])).withColumn("chosen_by", F.lit("explicit"))
    n = good.agg(F.count(F.lit(1)).alias("n"))
    return good.orderBy("relation_rank").limit(1).crossJoin(F.broadcast(n)).withColumn("chosen_by", F.when(F.col("n") == 1, "single_verified").otherwise("ranked")).drop("n")


def score_bucket(score: Column, digits: int = 12) -> Column:
    """Scores that agree in so many digits are a tie."""
    return F.round(score, digits)


def ranked_columns(scores: DataFrame, by: str = "child_table") -> DataFrame:
    """schema_scores of several tables with rank_within_relation."""
    return scores.withColumn("rank_within_relation", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "kind", "column")))


def candidate_features(scores: DataFrame, relations: DataFrame, most_numeric: int = 4, most_categorical: int = 2, budget: int = 8) -> DataFrame:
    """feature_index, child_table, column, aggregation, family: four of each accepted relation, five of
    each of its best numbers, one of each of its best categories; the first max(4 budget, budget)."""
    ranked = ranked_columns(scores)
    per_kind = F.row_number().over(Window.partitionBy("child_table", "kind").orderBy("rank_within_relation", "column"))
    best = ranked.withColumn("k", per_kind).filter(((F.col("kind") == "numeric") & (F.col("k") <= most_numeric)) | ((F.col("kind") == "categorical") & (F.col("k") <= most_categorical)))
    lists = {"relation": RELATION, "numeric": NUMERIC, "categorical": ("nunique",)}
    listed = lambda kind: F.posexplode(F.array(*map(F.lit, lists[kind]))).alias("p", "aggregation")
    good = relations.filter("status = 'accepted'").select("child_table", "relation_rank")
    own = [good.select("child_table", "relation_rank", F.lit(0).alias("g"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("column"), F.lit("relation").alias("family"), listed("relation"))]
    for g, kind in ((1, "numeric"), (2, "categorical")):
        own.append(best.filter(F.col("kind") == kind).join(good, "child_table").select("child_table", "relation_rank", F.lit(g).alias("g"), "k", "column", F.lit(kind).alias("family"), listed(kind)))
    every = reduce(DataFrame.unionByName, own)
    index = F.row_number().over(Window.orderBy("relation_rank", "g", "k", "p"))  # a few features a column
    return every.withColumn("feature_index", index).filter(F.col("feature_index") <= max(4 * budget, budget)).select("feature_index", "child_table", "column", "aggregation", "family")


def baseline_features(scores: DataFrame) -> DataFrame:
    """The declared baseline of each table: its count and recency, mean, std, min and max of its best
    number, distinct values of its first category by name."""
    number = F.min(F.when(F.col("kind") == "numeric", F.struct((-F.col("score")).alias("s"), F.col("column").alias("c"))))["c"]
    category = F.min(F.when(F.col("kind") == "categorical", F.col("column")))
    t = scores.groupBy("child_table").agg(number.alias("number"), category.alias("category"))
    one = lambda column, agg: F.struct(column.alias("column"), F.lit(agg).alias("aggregation"))
    none = F.lit(None).cast("string")
    rows = F.array(one(none, "count"), one(none, "days_since_last"), *(one(F.col("number"), a) for a in NUMERIC[:4]), one(F.col("category"), "nunique"))
    return t.select("child_table", F.explode(rows).alias("f")).select("child_table", "f.column", "f.aggregation").filter("column is not null or aggregation in ('count', 'days_since_last')")


def random_edges(edge_ids: Sequence[str], k: int, seed: int) -> list[str]:
    """k edges drawn from the ids in order; a pool that is too small raises."""
    if k > len(edge_ids):
        raise ValueError("random_k_exceeds_pool")
    return sorted(random.Random(seed).sample(sorted(edge_ids), k))


def bijective(mapping: DataFrame, dense: str, raw: str) -> DataFrame:
    """The mapping, if no id of either side occurs twice or is null; else its use raises."""
    bad = mapping.agg((F.count(F.lit(1)) != F.countDistinct(dense)).alias("a"), (F.count(F.lit(1)) != F.countDistinct(raw)).alias("b")).select(F.assert_true(~(F.col("a") | F.col("b")), "id_mapping_not_bijective").isNull().alias("_fine"))
    return mapping.crossJoin(F.broadcast(bad)).filter("_fine").drop("_fine")  # one row


def raw_ids(df: DataFrame, column: str, mapping: DataFrame, dense: str, raw: str) -> DataFrame:
    """df with the dense ids of a column turned back into raw ones; an id without one raises."""
    m = bijective(mapping.select(F.col(dense).alias("_dense"), F.col(raw).alias("_raw")), "_dense", "_raw")
    j = df.join(m, F.col(column) == F.col("_dense"), "left")
    known = F.when(F.col(column).isNull() | F.col("_raw").isNotNull(), F.col("_raw")).otherwise(F.raise_error(F.concat(F.lit("unmapped_id:"), F.col(column).cast("string"))).cast(mapping.schema[raw].dataType))
    return j.select(*(known.alias(c) if c == column else F.col(c) for c in df.columns))


def resolve_join_column(entity: DataFrame, wanted: str, least_unique: float = 0.95) -> str:
    """The entity table's column for a key: of that name, of that name normalised, ending in it, a common
    id, or the only nearly unique one."""
    plain = lambda c: c.lower().replace("_", "")
    names = entity.columns
    for fits in (lambda c: c == wanted, lambda c: plain(c) == plain(wanted), lambda c: plain(c).endswith(plain(wanted)) or plain(wanted).endswith(plain(c)), lambda c: plain(c) in ("id", "key")):
        found = [c for c in names if fits(c)]
        if len(found) == 1:
            return found[0]
    r = entity.agg(F.count(F.lit(1)).alias("_n"), *(F.countDistinct(c).alias(c) for c in names)).first().asDict()
    unique = [c for c in names if r[c] > least_unique * max(r["_n"], 1)]
    if len(unique) != 1:
        raise ValueError("entity_join_column_unresolved")
    return unique[0]


def enrich(targets: DataFrame, row_id: str, source: DataFrame, key: str, columns: Sequence[str], t_time: str | None = None, s_time: str | None = None) -> DataFrame:
    """targets with columns of the row of `source` that has their row_id.  A repeated key, a row without
    one, or times that differ raise when the result is read."""
    n = F.count(F.lit(1))
    one = source.groupBy(F.col(key).alias("_key")).agg(n.alias("_n"), *(F.first(c).alias(c) for c in columns), *([F.first(s_time).alias("_time")] if s_time else []))
    j = targets.join(one, F.col(row_id) == F.col("_key"), "left")
    fine = F.col("_n").eqNullSafe(F.lit(1)) & (F.col(t_time).eqNullSafe(F.col("_time")) if s_time else F.lit(True))
    return j.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("enrichment_not_one_to_one")).cast("boolean"))).select(*targets.columns, *columns)


def target_only(targets: DataFrame, key: str, entity: DataFrame, pk: str, drop: Sequence[str]) -> DataFrame:
    """The entity's own columns for each target row, without key, time, label and split columns."""
    one = entity.dropDuplicates([pk]).withColumnRenamed(pk, "_pk")
    out = targets.join(one, F.col(key) == F.col("_pk"), "left")
    return out.select(*(c for c in out.columns if c not in {*drop, key, "_pk", "index"} and not c.endswith("_split")))


def declared(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
