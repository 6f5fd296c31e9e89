"""Queries of relations, discovery, screening, selection and evaluation, with their SQL."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.tokens import token
from .operators import discovery, evaluation, fd, metrics, relations, shaping
from .operators.asof import activity, with_indicators
from .operators.shaping import inner_folds
from .plans import screening
from .queries import SHIPMENTS, _cuts, _CUTS, _orders, _shipments, query, rounded
from .sources.catalog import STAR, row_fingerprint, table

_FKS = [(t.name, fk, parent, STAR[parent].primary_key) for t in sorted(STAR.values(), key=lambda t: t.name) for fk, parent in sorted(t.foreign_keys.items())]


def _tables(spark, sf_dir):
    return {name: table(spark, sf_dir, name) for name in STAR}


def _fk_sql(child, fk, parent, pk):
    return f"""
SELECT '{child}' AS child_table, '{fk}' AS child_fk, '{parent}' AS parent_table, (SELECT count(*) FROM {child}) AS rows, round(1 - orphans / nullif(keys, 0), 6) AS coverage, orphans,
  CASE WHEN (SELECT count(*) > count(DISTINCT {pk}) FROM {parent}) THEN 'parent_key_not_unique' WHEN orphans > 0 THEN 'referential_integrity_failure' ELSE 'accepted' END AS status
FROM (SELECT count({fk}) AS keys, count({fk}) FILTER ({fk} NOT IN (SELECT {pk} FROM {parent})) AS orphans FROM {child})"""


@query(" UNION ALL ".join(_fk_sql(*x) for x in _FKS))
def foreign_key_verification(spark, sf_dir):
    return rounded(relations.foreign_keys(_tables(spark, sf_dir), STAR), "coverage")


@query(f"SELECT child_table, parent_table, CASE WHEN count(*) FILTER (status = 'accepted') = 1 THEN min(child_fk) FILTER (status = 'accepted') END AS child_fk, CASE count(*) FILTER (status = 'accepted') WHEN 0 THEN min(status) WHEN 1 THEN 'accepted' ELSE 'ambiguous_foreign_key' END AS resolution FROM ({' UNION ALL '.join(_fk_sql(*x) for x in _FKS)}) GROUP BY 1, 2")
def foreign_key_resolution(spark, sf_dir):
    return relations.resolve(relations.foreign_keys(_tables(spark, sf_dir), STAR))


_RELATIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS child_table, '{fk}' AS child_fk, CAST({repr(STAR[c].event_time) if STAR[c].event_time else 'NULL'} AS VARCHAR) AS event_time, {c == 'orders'} AS strict, CAST(NULL AS BIGINT) AS child_rows, CAST(NULL AS DOUBLE) AS coverage, CAST(NULL AS DOUBLE) AS history_coverage, 'foreign_key_not_task_entity' AS status"
    if parent != "customer" else
    f"""SELECT '{c}', '{fk}', '{STAR[c].event_time}', {c == 'orders'}, n, cov, h, CASE WHEN cov < 0.98 THEN 'referential_coverage_below_threshold' WHEN h <= 0 THEN 'no_source_data_before_training_targets' ELSE 'accepted' END
FROM (SELECT count(*) AS n, avg(CAST({fk} IN (SELECT c_custkey FROM customer) AS INT)) AS cov FROM {c}), (SELECT avg(CAST(coalesce(f {'<' if c == 'orders' else '<='} o_orderdate, false) AS INT)) AS h FROM orders o LEFT JOIN (SELECT {fk} AS k, min({STAR[c].event_time}) AS f FROM {c} GROUP BY 1) ON k = o.o_custkey)"""
    for c, fk, parent, _ in sorted(_FKS, key=lambda x: x[2] == "customer")
)


def _candidates(spark, sf_dir) -> DataFrame:
    return relations.relation_candidates(_tables(spark, sf_dir), STAR, "customer", "orders", _orders(spark, sf_dir), "o_custkey", "o_orderdate")


@query(f"SELECT child_table, child_fk, event_time, strict, child_rows, round(coverage, 6) AS coverage, round(history_coverage, 6) AS history_coverage, status, CAST(row_number() OVER (ORDER BY status <> 'accepted', history_coverage DESC NULLS LAST, coverage DESC NULLS LAST, child_rows DESC NULLS LAST, child_table, child_fk) AS INTEGER) AS relation_rank FROM ({_RELATIONS})")
def relation_ranking(spark, sf_dir):
    return rounded(relations.rank_relations(_candidates(spark, sf_dir)), "coverage", "history_coverage")


@query("SELECT 'orders' AS child_table, 'o_custkey' AS child_fk, 'single_verified' AS chosen_by")
def relation_choice(spark, sf_dir):
    return relations.choose_relation(relations.rank_relations(_candidates(spark, sf_dir))).select("child_table", "child_fk", "chosen_by")


_SCORED = {"orders": (["o_totalprice"], ["o_orderstatus", "o_orderpriority"]), "events": (["value"], ["event_type"])}


def _scores(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, [discovery.schema_scores(table(spark, sf_dir, t), n, c).withColumn("child_table", F.lit(t)) for t, (n, c) in _SCORED.items()])


def _score_sql(t, c, number):
    stats = f"(SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u FROM {t})"
    if number:
        return f"SELECT '{t}' AS child_table, '{c}' AS \"column\", 'numeric' AS kind, 0.35 * k / n + 0.25 * CAST(u > 1 AS INT) + 0.25 * (SELECT avg(CAST(isfinite({c}) AS INT)) FROM {t} WHERE {c} IS NOT NULL) + 0.15 * CAST(u / k < 0.95 AS INT) AS score FROM {stats}"
    entropy = f"(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))"
    return f"SELECT '{t}', '{c}', 'categorical', 0.4 * k / n + 0.2 * CAST(u > 1 AS INT) + 0.2 * CAST(u <= 64 AS INT) + 0.2 * CASE WHEN u > 1 THEN {entropy} / log2(u) ELSE 0 END FROM {stats}"


_SCORES = " UNION ALL ".join(_score_sql(t, c, c in n) for t, (n, k) in _SCORED.items() for c in (*n, *k))


@query(f"SELECT child_table, \"column\", kind, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY child_table ORDER BY round(score, 6) DESC, kind, \"column\") AS INTEGER) AS rank_within_relation FROM ({_SCORES})")
def schema_rank_scores(spark, sf_dir):
    return relations.ranked_columns(rounded(_scores(spark, sf_dir), "score"))


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY child_table, kind ORDER BY round(score, 6) DESC, "column") AS k FROM ({_SCORES}) WHERE child_table = 'orders'),
f AS (SELECT 0 AS g, 0 AS k, CAST(NULL AS VARCHAR) AS "column", 'relation' AS family, ['count', 'days_since_last', 'active_span_days', 'event_frequency'] AS l
  UNION ALL SELECT 1, k, "column", kind, ['mean', 'std', 'min', 'max', 'last'] FROM s WHERE kind = 'numeric' AND k <= 4 UNION ALL SELECT 2, k, "column", kind, ['nunique'] FROM s WHERE kind = 'categorical' AND k <= 2),
u AS (SELECT g, k, "column", family, unnest(l) AS aggregation, unnest(range(len(l))) AS p FROM f)
SELECT CAST(row_number() OVER (ORDER BY g, k, p) AS INTEGER) AS feature_index, 'orders' AS child_table, "column", aggregation, family FROM u
""")
def candidate_features(spark, sf_dir):
    return relations.candidate_features(rounded(_scores(spark, sf_dir), "score"), relations.rank_relations(_candidates(spark, sf_dir)))


@query(f"""
WITH s AS ({_SCORES}), t AS (SELECT child_table, arg_min("column", (-round(score, 6), "column")) FILTER (kind = 'numeric') AS a, min("column") FILTER (kind = 'categorical') AS b FROM s GROUP BY 1)
SELECT child_table, NULL AS "column", unnest(['count', 'days_since_last']) AS aggregation FROM t UNION ALL SELECT child_table, a, unnest(['mean', 'std', 'min', 'max']) FROM t UNION ALL SELECT child_table, b, 'nunique' FROM t
""")
def baseline_features(spark, sf_dir):
    return relations.baseline_features(rounded(_scores(spark, sf_dir), "score"))


#: Tables that dependencies are looked for in, with what their columns are known to be.
ROLES = {
    "lineitem": discovery.Roles(foreign_keys=("l_orderkey", "l_partkey", "l_suppkey"), time="l_shipdate"),
    "part": discovery.Roles(primary_key="p_partkey"),
    "events": discovery.Roles(primary_key="event_id", foreign_keys=("user_id",), time="ts"),
}
_COLUMNS = {
    "lineitem": {"l_orderkey": 0, "l_partkey": 0, "l_suppkey": 0, "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s", "l_shipdate": 1},
    "part": {"p_partkey": 2, "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"},
    "events": {"event_id": 2, "ts": 1, "user_id": 0, "event_type": "s", "value": "n", "props": "s"},
}
_NAMED = {0: "foreign_key_excluded", 1: "timestamp_excluded", 2: "primary_key_excluded"}


def _audit_sql(t):
    def one(c, kind):
        text = f"CAST({c} AS VARCHAR)"
        if kind == "n":
            rule = "WHEN u / greatest(k, 1) > 0.95 THEN 'surrogate_key_identity_excluded' WHEN u > 64 THEN 'high_cardinality_numeric_excluded'"
        else:
            rule = f"WHEN u > 64 OR (SELECT avg(length({text})) > 80 OR max(length({text})) > 256 OR avg(len(regexp_extract_all({text}, '\\S+'))) > 12 FROM {t}) THEN 'free_text_or_high_cardinality_excluded' WHEN u / greatest(k, 1) > 0.95 THEN 'surrogate_key_identity_excluded'"
        reason = f"'{_NAMED[kind]}'" if kind in _NAMED else f"CASE WHEN u <= 1 THEN 'constant_or_empty_excluded' {rule} END"
        return f"SELECT '{c}' AS \"column\", n AS rows, k AS non_null, u AS cardinality, r AS repeated_rows, {reason} AS exclusion_reason FROM (SELECT count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u FROM {t}), (SELECT CAST(coalesce(sum(m), 0) AS BIGINT) AS r FROM (SELECT count(*) AS m FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))"

    rows = " UNION ALL ".join(one(c, k) for c, k in _COLUMNS[t].items())
    return f"SELECT '{t}' AS source_table, *, coalesce(exclusion_reason, CASE WHEN repeated_rows < 2 THEN 'determinant_repeated_support_below_minimum' WHEN cardinality / greatest(rows, 1) > 0.95 THEN 'surrogate_key_identity_excluded' END) AS determinant_reason FROM ({rows})"


_AUDITS = " UNION ALL ".join(map(_audit_sql, ROLES))


def _audits(spark, sf_dir) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {t: (df := table(spark, sf_dir, t), discovery.eligibility(df, roles)) for t, roles in ROLES.items()}


def _audit(spark, sf_dir) -> DataFrame:
    return reduce(DataFrame.unionByName, [a.withColumn("source_table", F.lit(t)) for t, (_, a) in _audits(spark, sf_dir).items()])


@query(_AUDITS)
def column_eligibility(spark, sf_dir):
    return _audit(spark, sf_dir).select("source_table", "column", "rows", "non_null", "cardinality", "repeated_rows", "exclusion_reason", "determinant_reason")


@query(f"SELECT exclusion_reason AS reason, count(*) AS n FROM ({_AUDITS}) WHERE exclusion_reason IS NOT NULL GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    return discovery.rejection_counts(_audit(spark, sf_dir), "exclusion_reason")


def _edges_sql(t, source=None):
    source = source or t
    cols = [c for c, k in _COLUMNS[t].items() if k in ("n", "s")]
    pairs = " UNION ALL ".join(
        f"""SELECT '{t}:{x}->{y}' AS edge_id, '{x}' AS lhs, '{y}' AS rhs, CAST(sum(n) AS BIGINT) AS support, (SELECT count({x}) / count(*) FROM {source}) AS coverage, max(n) / sum(n) AS confidence, avg(CAST(d > 1 AS INT)) AS conflict_rate
FROM (SELECT {x}, count(*) AS n, count(DISTINCT {y}) AS d FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)"""
        for x in cols for y in cols if x != y
    )
    audit = _audit_sql(t).replace(f"FROM {t}", f"FROM {source}")
    return f"SELECT edge_id, lhs, rhs, support, round(coverage, 6) AS coverage, round(confidence, 6) AS confidence, round(conflict_rate, 6) AS conflict_rate, CASE WHEN support < 2 THEN 'support_below_minimum' WHEN conflict_rate = 0 THEN 'constant_or_non_informative_edge' ELSE 'accepted' END AS status FROM ({pairs}) WHERE lhs IN (SELECT \"column\" FROM ({audit}) WHERE determinant_reason IS NULL) AND rhs IN (SELECT \"column\" FROM ({audit}) WHERE exclusion_reason IS NULL)"


@query(" UNION ALL ".join(map(_edges_sql, ROLES)))
def fd_discovery(spark, sf_dir):
    found = [discovery.edges(df, t, a) for t, (df, a) in _audits(spark, sf_dir).items()]
    return rounded(reduce(DataFrame.unionByName, found), "coverage", "confidence", "conflict_rate")


_FIRST = "(SELECT * FROM lineitem WHERE l_shipdate <= (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS u FROM (SELECT DISTINCT l_shipdate AS d FROM lineitem)) WHERE r = u - CAST(ceil(0.4 * u) AS BIGINT)))"


@query(_edges_sql("lineitem", _FIRST))
def fd_discovery_earliest_fold(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(discovery.earliest_fold_edges(li, "l_shipdate", inner_folds(li, "l_shipdate", 3), "lineitem", ROLES["lineitem"]), "coverage", "confidence", "conflict_rate")


@query("""
WITH g AS (SELECT l_returnflag, count(*) AS n, max(m) AS m, any_value(k) AS k, any_value(t) AS t FROM (SELECT l_returnflag, count(*) AS m, count(*) OVER (PARTITION BY l_returnflag) AS k, sum(count(*)) OVER (PARTITION BY l_returnflag) AS t FROM lineitem GROUP BY l_returnflag, l_linestatus) GROUP BY 1)
SELECT count(*) AS groups, CAST(sum(t) AS BIGINT) AS rows, count(*) FILTER (k > 1) AS conflicting_groups, CAST(sum(t - m) AS BIGINT) AS violations, count(*) FILTER (t > 1) AS repeated_groups, count(*) >= 2 AND sum(t) >= 2 AND count(*) FILTER (t > 1) > 0 AS suitable FROM g
""")
def edge_suitability(spark, sf_dir):
    return discovery.suitability(fd.ambiguity_map(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


_FEATURES = ["l_quantity", "l_discount", "l_tax", "a", "b", "b__is_missing"]


def _residual(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.lit(None).cast("double").alias("a"), F.lit(7.0).alias("b"), (F.col("l_quantity") + 0).alias("c"))
    return with_indicators(li, ["b"])


@query("SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'a', 'b', 'b__is_missing']) AS \"column\", unnest([NULL, NULL, NULL, 'all_missing', 'zero_variance', 'constant_missing_indicator']) AS reason")
def residual_usability(spark, sf_dir):
    return discovery.usable_columns(_residual(spark, sf_dir), _FEATURES)


@query("WITH c AS (SELECT unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem) SELECT round(avg(CAST(v <> 0 AS INT)), 6) AS nonzero_rate, round(var_pop(v), 4) AS variance, count(DISTINCT v) AS unique_values FROM c WHERE v IS NOT NULL")
def residual_statistics(spark, sf_dir):
    return rounded(discovery.cell_statistics(_residual(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"]), "nonzero_rate").withColumn("variance", F.round("variance", 4))


@query("SELECT CAST(4 AS BIGINT) AS columns, CAST(1 AS BIGINT) AS duplicate_columns")
def duplicate_features(spark, sf_dir):
    return discovery.duplicate_columns(_residual(spark, sf_dir).withColumn("row", F.col("l_orderkey") * 100 + F.col("l_linenumber")), ["l_quantity", "l_discount", "l_tax", "c"], "row")


#: Scores of edges by fold, made from data: an edge a nation, a fold a market segment.
_FOLDS = "(SELECT 'e' || c_nationkey AS edge, c_mktsegment AS fold, CASE WHEN c_nationkey % 11 = 10 THEN CAST('nan' AS DOUBLE) ELSE max(c_acctbal) - 7500 END AS gain, max(c_acctbal) AS base, c_nationkey % 7 AS usable, count(*) AS added FROM customer GROUP BY c_nationkey, c_mktsegment)"


def _folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("base"), F.count(F.lit(1)).alias("added"))
    return c.select(F.concat(F.lit("e"), "c_nationkey").alias("edge"), F.col("c_mktsegment").alias("fold"), F.when(F.col("c_nationkey") % 11 == 10, float("nan")).otherwise(F.col("base") - 7500).alias("gain"), "base", (F.col("c_nationkey") % 7).alias("usable"), "added")


def _screen_sql(mean, enough, why, count, delta=50.0):
    return f"""
WITH f AS (SELECT *, CASE WHEN isfinite(gain) THEN gain END AS g FROM {_FOLDS}),
s AS (SELECT edge, avg(g) AS mean_gain, min(g) AS worst_gain, stddev_pop(g) AS gain_std, count(g) AS folds, count(*) FILTER (g > 0) AS positive_folds, count(*) FILTER (g > {delta}) AS passing_folds, avg(g) AS aggregate_gain, max(usable) AS us, coalesce(max(greatest(0.0, -g) / greatest(abs(base), 1e-12)), 0.0) AS worst_degradation FROM f GROUP BY 1),
r AS (SELECT *, CASE WHEN us <= 0 THEN 'no_usable_features' WHEN NOT coalesce({mean}, false) THEN '{why}' WHEN worst_degradation > 0.3 THEN 'excessive_worst_fold_relative_degradation' WHEN NOT ({enough}) THEN '{count}' END AS reason FROM s)
SELECT edge, round(mean_gain, 4) AS mean_gain, round(worst_gain, 4) AS worst_gain, round(gain_std, 3) AS gain_std, folds, positive_folds, passing_folds, round(aggregate_gain, 4) AS aggregate_gain, round(worst_degradation, 6) AS worst_degradation, reason, CASE WHEN us <= 0 THEN 'no_usable_features' WHEN reason IS NULL THEN 'screened_in' ELSE 'screened_out' END AS status FROM r"""


def _screened(spark, sf_dir, **how):
    out = screening.screen(_folds(spark, sf_dir), "edge", "gain", screening.folds_needed(5), 50.0, baseline="base", usable="usable", most_degradation=0.3, **how)
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("mean_gain", "worst_gain", "aggregate_gain")} | {"gain_std": F.round("gain_std", 3), "worst_degradation": F.round("worst_degradation", 6) + 0.0})


@query(_screen_sql("mean_gain > 50.0", "positive_folds >= 3", "non_positive_mean_gain", "insufficient_positive_folds"))
def edge_screening_fixed_count(spark, sf_dir):
    return _screened(spark, sf_dir)


@query(_screen_sql("aggregate_gain > 50.0", "true", "non_positive_aggregate_gain", ""))
def edge_screening_pooled(spark, sf_dir):
    return _screened(spark, sf_dir, rule="pooled_oof")


@query(_screen_sql("mean_gain > 0", "passing_folds >= 3", "non_positive_mean_gain", "insufficient_delta_passing_folds"))
def pair_screening(spark, sf_dir):
    return _screened(spark, sf_dir, pairs=True)


@query(f"WITH f AS (SELECT edge, avg(gain) AS score, sum(added) AS added FROM {_FOLDS} WHERE isfinite(gain) GROUP BY 1) SELECT edge, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY round(score, 4) DESC, added, edge) AS INTEGER) AS rank FROM f")
def candidate_ranking(spark, sf_dir):
    f = _folds(spark, sf_dir).filter(screening.finite(F.col("gain")).isNotNull()).groupBy("edge").agg(F.round(F.avg("gain"), 4).alias("score"), F.sum("added").alias("added_features"))
    return screening.rank_candidates(f.withColumn("complexity", F.lit(1)), True, ident="edge").select("edge", "score", "rank")


@query(f"WITH b AS (SELECT usable, avg(base) AS s FROM {_FOLDS} GROUP BY 1) SELECT min(usable) AS usable, round(any_value(m), 4) AS best FROM b, (SELECT max(s) AS m FROM b) WHERE m - s <= 40")
def smallest_budget(spark, sf_dir):
    return screening.smallest_budget(_folds(spark, sf_dir), "usable", "base", 40.0, True).withColumn("best", F.round("best", 4))


@query(f"WITH e AS (SELECT edge, round(avg(base), 4) AS score, count(*) AS edges FROM {_FOLDS} GROUP BY 1) SELECT edge, score, edges FROM e WHERE (SELECT max(score) FROM e) - score <= 500 ORDER BY edges, score DESC, edge LIMIT 1")
def joint_strategy(spark, sf_dir):
    e = _folds(spark, sf_dir).groupBy("edge").agg(F.round(F.avg("base"), 4).alias("score"), F.count(F.lit(1)).alias("edges"))
    return screening.choose_strategy(e, "edge", "score", "edges", 500.0, True)


@query(f"""
WITH s AS (SELECT edge, count(*) AS seeds, count(*) FILTER (gain > 0) AS wins, avg(gain) AS mean_gain, min(gain) AS worst_gain FROM {_FOLDS} WHERE isfinite(gain) GROUP BY 1 UNION ALL SELECT DISTINCT edge, 0, 0, NULL, NULL FROM {_FOLDS} WHERE NOT isfinite(gain)),
r AS (SELECT *, CASE WHEN seeds < 4 THEN 'too_few_seeds' WHEN wins < 3 THEN 'too_few_wins' WHEN NOT mean_gain > 0 THEN 'mean_gain_below_threshold' END AS reason FROM s)
SELECT edge, seeds, wins, round(mean_gain, 4) AS mean_gain, round(worst_gain, 4) AS worst_gain, reason, reason IS NULL AS stable FROM r
""")
def stability_gate(spark, sf_dir):
    out = screening.stability(_folds(spark, sf_dir), ["edge"], "rmse")
    return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("mean_gain", "worst_gain")})


_POOL = f"(SELECT edge AS program_id, CASE WHEN usable = 5 THEN 'other' ELSE 't' END AS task, CASE WHEN usable = 4 THEN 'auc' ELSE 'rmse' END AS metric, 'lower' AS direction, CASE WHEN usable = 3 THEN 'Test' ELSE 'validation' END AS split, avg(gain) AS score, usable <> 2 AS eligible, usable <> 1 AS leakage_safe, true AS temporally_safe, CASE WHEN usable = 0 THEN NULL ELSE true END AS provenance_safe, sum(added) AS added_features, 1 AS complexity FROM {_FOLDS} GROUP BY edge, usable)"


@query(f"""
WITH p AS (SELECT *, CASE WHEN task <> 't' THEN 'task_mismatch' WHEN metric <> 'rmse' THEN 'metric_mismatch' WHEN lower(split) = 'test' THEN 'test_split' WHEN NOT isfinite(score) THEN 'non_finite_score' WHEN NOT eligible THEN 'ineligible' WHEN NOT (leakage_safe AND coalesce(provenance_safe, false)) THEN 'unsafe_or_unknown' END AS rejection FROM {_POOL}),
r AS (SELECT program_id, row_number() OVER (ORDER BY score, added_features, program_id) AS rank, score FROM p WHERE rejection IS NULL)
SELECT p.program_id, rejection, CAST(rank AS INTEGER) AS rank, coalesce(rank = 1 AND r.score < 1000, false) AS selected FROM p LEFT JOIN r USING (program_id)
""")
def candidate_selection(spark, sf_dir):
    f = _folds(spark, sf_dir).groupBy("edge", "usable").agg(F.avg("gain").alias("score"), F.sum("added").alias("added_features"))
    u = F.col("usable")
    pool = f.select(F.col("edge").alias("program_id"), F.when(u == 5, "other").otherwise("t").alias("task"), F.when(u == 4, "auc").otherwise("rmse").alias("metric"), F.lit("lower").alias("direction"), F.when(u == 3, "Test").otherwise("validation").alias("split"), "score", (u != 2).alias("eligible"), (u != 1).alias("leakage_safe"), F.lit(True).alias("temporally_safe"), F.when(u != 0, True).alias("provenance_safe"), "added_features", F.lit(1).alias("complexity"))
    return screening.select_candidate(pool, "t", "rmse", "lower", 1000.0).select("program_id", "rejection", "rank", "selected")


@query("SELECT s_suppkey AS id, round(s_acctbal - avg(c_acctbal), 4) AS gain FROM supplier JOIN customer ON c_custkey = s_suppkey GROUP BY s_suppkey, s_acctbal")
def paired_scores(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return screening.paired(c, s, ["id"], "v", True).select("id", F.round("gain", 4).alias("gain"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = round(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS label, TRY_CAST(trim(l_returnflag) AS DOUBLE) AS flag_number, TRY_CAST(CAST(l_linenumber AS VARCHAR) AS DOUBLE) AS line_number FROM lineitem WHERE l_quantity = round(l_quantity)")
def label_canonicalisation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.filter(F.col("l_quantity") == F.round("l_quantity")).select("l_orderkey", "l_linenumber", evaluation.canonical_label(li, "l_quantity").alias("label"), evaluation.number(F.col("l_returnflag")).alias("flag_number"), evaluation.number(F.col("l_linenumber")).alias("line_number"))


@query(f"SELECT o_orderkey FROM orders, {_CUTS} WHERE epoch_us(o_orderdate) > a AND o_orderpriority IN (SELECT o_orderpriority FROM orders, {_CUTS} WHERE epoch_us(o_orderdate) <= a)")
def known_classes(spark, sf_dir):
    o = _orders(spark, sf_dir)
    end = F.lit(_cuts(o)[0])
    return evaluation.known_classes(o.filter(F.col("o_orderdate") <= end), o.filter(F.col("o_orderdate") > end), "o_orderpriority").select("o_orderkey")


@query(f"SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority, epoch_us(o_orderdate) > a AS validation FROM orders, {_CUTS}")
def joint_factorisation(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_orderdate")
    end = F.lit(_cuts(o)[0])
    a, b = evaluation.joint_codes(o.filter(F.col("o_orderdate") <= end), o.filter(F.col("o_orderdate") > end), ["o_orderpriority"])
    return a.withColumn("validation", F.lit(False)).unionByName(b.withColumn("validation", F.lit(True))).drop("o_orderdate")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag FROM lineitem")
def binary_evaluator_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.lit(float("inf")).alias("a"), F.lit(7.0).alias("b"))
    train, _, _ = evaluation.binary_features(li, li, ["l_quantity", "a", "b"], ["l_returnflag"], ["l_orderkey", "l_linenumber"])
    return train


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS t FROM q)
SELECT round(avg(1 / r), 6) AS mrr, count(*) AS rows FROM s WHERE l_linenumber = t
""")
def mean_reciprocal_rank(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    first = li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("truth"))
    return rounded(evaluation.mrr(li.join(first, "l_orderkey"), "l_orderkey", "l_linenumber", "l_quantity", "truth"), "mrr")


@query("SELECT o_orderkey, coalesce(o_totalprice, 0) * (o_orderkey % 5) AS product, coalesce(o_totalprice, 0) / greatest(o_orderkey % 5, 1.0) AS ratio FROM orders")
def activity_features(spark, sf_dir):
    product, ratio = activity(F.coalesce("o_totalprice", F.lit(0.0)), F.col("o_orderkey") % 5)
    return _orders(spark, sf_dir).select("o_orderkey", product.alias("product"), ratio.alias("ratio"))


@query("SELECT o_orderkey, c_nationkey, c_acctbal, c_mktsegment, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def target_only_matrix(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.lit("x").alias("row_split"))
    return relations.target_only(o, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", ["o_totalprice", "o_orderdate"])


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def key_enrichment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return relations.enrich(li, "l_orderkey", _orders(spark, sf_dir), "o_orderkey", ["o_custkey"])


@query("SELECT c_custkey, n_name AS c_nationkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def dense_id_inverse(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return relations.raw_ids(c, "c_nationkey", table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name")


@query("SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def normalised_key_join(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    a, b = relations.join_keys(s, "s_nationkey", n, "n_nationkey")
    return s.join(n, a == b).select("s_suppkey", "n_regionkey")


@query(f"SELECT o_orderkey, count(*) FILTER (s.ts IS NOT NULL) AS shipments, CASE WHEN epoch_us(any_value(o_orderdate)) <= any_value(a) THEN 'train' ELSE 'validation' END AS side FROM orders JOIN {_CUTS} ON true LEFT JOIN {SHIPMENTS} s ON s.user_id = o_custkey AND s.ts < o_orderdate GROUP BY 1")
def featurised_together(spark, sf_dir):
    from .operators.asof import strict_prior

    o, s = _orders(spark, sf_dir), _shipments(spark, sf_dir)
    end = F.lit(_cuts(o)[0])
    count = lambda both: both.join(strict_prior(both, s, "o_orderkey", ["o_custkey"], "o_orderdate", "ts", {}, s_key=["user_id"]), "o_orderkey").select("o_orderkey", F.col("prior_count").alias("shipments"), "_side")
    a, b = evaluation.featurised_together(o.filter(F.col("o_orderdate") <= end), o.filter(F.col("o_orderdate") > end), count)
    return a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("validation")))


@query("SELECT count(*) AS shared FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def fingerprint_intersect(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).select(row_fingerprint(["k"]).alias("f"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).select(row_fingerprint(["k"]).alias("f"))
    return c.intersect(s).agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT fold, count(*) AS n, round(sum(l_quantity), 2) AS total FROM (SELECT l_quantity, CAST(l_linenumber % 3 AS INTEGER) AS fold FROM lineitem) GROUP BY 1")
def pooled_out_of_fold(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return evaluation.pooled([li.filter(F.col("l_linenumber") % 3 == i).select("l_quantity") for i in range(3)]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


_ENTITY = "(SELECT c_custkey, c_mktsegment, c_nationkey FROM customer)"


@query("""
WITH c AS (SELECT c_mktsegment AS x, c_nationkey AS y, count(*) AS n FROM customer GROUP BY ALL), m AS (SELECT x, max(n) / sum(n) AS majority_confidence, count(*) AS conflict_count FROM c GROUP BY 1)
SELECT o_orderkey, round(majority_confidence, 6) AS majority_confidence, conflict_count, CAST(majority_confidence IS NULL AS INTEGER) AS majority_confidence__is_missing, CAST(conflict_count IS NULL AS INTEGER) AS conflict_count__is_missing FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN m ON x = c_mktsegment
""")
def static_single_edge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = evaluation.single_edge(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey", fd.ambiguity_map(c, "c_mktsegment", "c_nationkey"), token(c, "c_mktsegment"), ["majority_confidence", "conflict_count"])
    return rounded(out, "majority_confidence").drop("o_custkey")


@query("SELECT round(-avg(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(greatest(least(1 - p, 1 - 1e-15), 1e-15))), 6) AS log_loss FROM (SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_quantity / 51 AS p FROM lineitem)")
def metric_log_loss(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 51).alias("p"))
    return rounded(li.agg(metrics.log_loss(F.col("y"), F.col("p")).alias("log_loss")), "log_loss")


@query(f"SELECT edge, round(min(gain), 4) AS worst, min(gain) > 50 AS passes FROM {_FOLDS} WHERE isfinite(gain) GROUP BY 1")
def every_seed(spark, sf_dir):
    f = _folds(spark, sf_dir).filter(screening.finite(F.col("gain")).isNotNull())
    return metrics.every_seed_gate(f, ["edge"], "gain", 50.0).withColumn("worst", F.round("worst", 4))


@query(f"SELECT edge, count(*) AS seeds, round(avg(base), 4) AS base, round(avg(added), 6) AS added FROM {_FOLDS} GROUP BY 1")
def edge_means(spark, sf_dir):
    return discovery.edge_means(_folds(spark, sf_dir), "edge", ["base", "added"]).withColumn("base", F.round("base", 4)).withColumn("added", F.round("added", 6))


@query("SELECT o_orderkey, t FROM (SELECT o_orderkey, CAST(o_orderkey % 60 AS DOUBLE) + (o_orderkey // 60 % 60) * 60 + (o_orderkey // 3600) * 3600 AS t FROM orders)")
def elapsed_seconds(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat_ws(":", F.floor(k / 3600).cast("string"), (F.floor(k / 60) % 60).cast("string"), (k % 60).cast("string"))
    return _orders(spark, sf_dir).select("o_orderkey", evaluation.seconds(text).alias("t"))


@query("SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, 's:' || s_name || '|n:' || s_nationkey AS t FROM supplier) JOIN (SELECT c_custkey, 's:' || replace(c_name, 'Customer', 'Supplier') || '|n:' || c_nationkey AS t FROM customer) USING (t)")
def composite_token_join(spark, sf_dir):
    from .functions.tokens import composite

    s = table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer").withColumn("c_name", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")))
    a = s.select("s_suppkey", composite(s, ["s_name", "s_nationkey"]).alias("t"))
    return a.join(c.select("c_custkey", composite(c, ["c_name", "c_nationkey"]).alias("t")), "t").select("s_suppkey", "c_custkey")


@query("SELECT CAST(200 AS BIGINT) AS rows, CAST(200 AS BIGINT) AS distinct_rows")
def seeded_sample(spark, sf_dir):
    s = shaping.seeded_sample(_orders(spark, sf_dir), "o_orderkey", 200, 7)
    return s.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("distinct_rows"))
