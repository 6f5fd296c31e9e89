"""Named queries of the temporal feature engine and the SQL that they are held against.

The SQL is written independently (theta joins, correlated subqueries), not as the window plans are.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .operators import corruption, fd, metrics, shaping
from .operators.asof import asof_audit, asof_join, history, strict_prior
from .functions.tokens import bin_label, quantile_bounds
from .plans.program import HistorySpec, PairSpec, Task, compile_task
from .sources.catalog import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
D = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), D) + 0.0 for c in columns})


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


#: Shipments of a customer's orders: a history that precedes later orders.
SHIPMENTS = "(SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS event_id, o_custkey AS user_id, l_shipdate AS ts, l_returnflag AS event_type, l_quantity AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _shipments(spark, sf_dir):
    o = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("event_id"), "user_id", F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("event_type"), F.col("l_quantity").alias("value"))


def _cuts(o):
    """Ends of the train and validation sides: three and four fifths of the time range."""
    lo, hi = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    us = dt.timedelta(microseconds=1)
    return tuple(lo + (hi - lo) // us * k // 5 * us for k in (3, 4))


_CUTS = "(SELECT lo + (hi - lo) * 3 // 5 AS a, lo + (hi - lo) * 4 // 5 AS z FROM (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM orders))"

_PRIOR = """
SELECT t.o_orderkey, (SELECT count(*) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderdate < t.o_orderdate) AS prior_count,
  (SELECT count(*) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderdate < t.o_orderdate AND s.o_orderdate >= t.o_orderdate - INTERVAL 90 DAY) AS count_90d,
  coalesce((SELECT round(epoch_us(t.o_orderdate - max(s.o_orderdate)) / 86400000000.0, 6) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderdate < t.o_orderdate), 0.0) AS days_since_last,
  CAST((SELECT count(*) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderdate < t.o_orderdate) = 0 AS INTEGER) AS days_since_last_missing
FROM orders t
"""


@query(_PRIOR)
def flagship(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return rounded(strict_prior(o, o, "o_orderkey", ["o_custkey"], "o_orderdate", "o_orderdate", {"90d": 90}), "days_since_last")


def _asof_sql(op: str) -> str:
    return f"""
SELECT t.o_orderkey, s.o_orderdate AS matched_time, s.o_orderkey AS previous, s.o_orderstatus AS status
FROM orders t LEFT JOIN LATERAL (SELECT * FROM orders x WHERE x.o_custkey = t.o_custkey AND x.o_orderdate {op} t.o_orderdate ORDER BY x.o_orderdate DESC, x.o_orderkey DESC LIMIT 1) s ON true
"""


def _asof(spark, sf_dir, strict):
    o = _orders(spark, sf_dir)
    s = o.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("previous"), F.col("o_orderstatus").alias("status"))
    return asof_join(o, s, "o_orderkey", ["o_custkey"], "o_orderdate", "o_orderdate", ["previous", "status"], ["o_orderkey"], strict)


@query(_asof_sql("<"))
def asof_strict_orders(spark, sf_dir):
    return _asof(spark, sf_dir, True)


@query(_asof_sql("<="))
def asof_inclusive_orders(spark, sf_dir):
    return _asof(spark, sf_dir, False)


@query(f"""
SELECT count(*) AS rows, count(m) AS matched, CAST(0 AS BIGINT) AS future, count(*) FILTER (m = o_orderdate) AS exact
FROM (SELECT t.o_orderdate, (SELECT max(s.ts) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts <= t.o_orderdate) AS m FROM orders t)
""")
def asof_audit_shipments(spark, sf_dir):
    o, e = _orders(spark, sf_dir), _shipments(spark, sf_dir)
    m = asof_join(o, e, "o_orderkey", ["o_custkey"], "o_orderdate", "ts", ["event_type"], ["event_id"], s_key=["user_id"])
    return asof_audit(m, o, "o_orderkey", "o_orderdate")


@query("""
SELECT t.event_id,
  (SELECT count(*) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts AND s.ts >= t.ts - INTERVAL 1 DAY) AS count_1d,
  (SELECT count(*) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts AND s.ts >= t.ts - INTERVAL 7 DAY) AS count_7d,
  (SELECT count(DISTINCT s.event_type) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts AND s.ts >= t.ts - INTERVAL 1 DAY) AS unique_1d,
  (SELECT count(DISTINCT s.event_type) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts AND s.ts >= t.ts - INTERVAL 7 DAY) AS unique_7d,
  (SELECT count(*) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts) AS prior_count,
  coalesce((SELECT round(epoch_us(t.ts - max(s.ts)) / 86400000000.0, 6) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts), 0.0) AS days_since_last,
  CAST((SELECT count(*) FROM events s WHERE s.user_id = t.user_id AND s.ts < t.ts) = 0 AS INTEGER) AS days_since_last_missing
FROM events t
""")
def strict_prior_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(strict_prior(e, e, "event_id", ["user_id"], "ts", "ts", {"1d": 1, "7d": 7}, "event_type"), "days_since_last")


@query("""
SELECT t.o_orderkey, (SELECT count(*) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND s.o_orderdate < t.o_orderdate) AS prior_count,
  coalesce((SELECT round(epoch_us(t.o_orderdate - max(s.o_orderdate)) / 86400000000.0, 6) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND s.o_orderdate < t.o_orderdate), 0.0) AS days_since_last,
  CAST((SELECT count(*) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND s.o_orderdate < t.o_orderdate) = 0 AS INTEGER) AS days_since_last_missing
FROM orders t
""")
def pair_history_orders(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return rounded(strict_prior(o, o, "o_orderkey", ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderdate", {}), "days_since_last")


_HISTORY = ("mean", "min", "max", "last", "days_since_last", "active_span_days", "event_frequency")


def _history_sql(target, tid, tkey, tt, source, skey, st, x, cat, tie, op="<="):
    return f"""
WITH j AS (SELECT t.{tid}, t.{tt} AS tt, s.{st} AS st, CAST(s.{x} AS DOUBLE) AS x, s.{cat} AS c, s.{tie} AS tie FROM {target} t JOIN {source} s ON s.{skey} = t.{tkey} AND s.{st} {op} t.{tt}),
a AS (SELECT {tid}, CAST(count(*) AS DOUBLE) AS count, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, arg_max(x, (st, tie)) AS last, CAST(count(DISTINCT c) AS DOUBLE) AS nunique,
  epoch_us(any_value(tt) - max(st)) / 86400000000.0 AS r, epoch_us(max(st) - min(st)) / 86400000000.0 AS span FROM j GROUP BY 1)
SELECT t.{tid}, coalesce(a.count, 0.0) AS count, round(a.mean, 6) AS mean, round(a.std, 4) AS std, round(a.min, 6) AS min, round(a.max, 6) AS max, round(a.last, 6) AS last, coalesce(a.nunique, 0.0) AS nunique,
  round(r, 6) AS days_since_last, round(span, 6) AS active_span_days, round(a.count / nullif(span, 0), 6) AS event_frequency FROM {target} t LEFT JOIN a ON a.{tid} = t.{tid}
"""


@query(_history_sql("orders", "o_orderkey", "o_custkey", "o_orderdate", SHIPMENTS, "user_id", "ts", "value", "event_type", "event_id"))
def history_baseline_shipments(spark, sf_dir):
    o, e = _orders(spark, sf_dir), _shipments(spark, sf_dir)
    return rounded(history(o, e, "o_orderkey", ["o_custkey"], "o_orderdate", "ts", "value", "event_type", ["event_id"], s_key=["user_id"]), *_HISTORY).withColumn("std", F.round("std", 4))


@query(_history_sql("orders", "o_orderkey", "o_custkey", "o_orderdate", "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderkey", "<"))
def history_orders_self(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return rounded(history(o, o, "o_orderkey", ["o_custkey"], "o_orderdate", "o_orderdate", "o_totalprice", "o_orderpriority", ["o_orderkey"], True), *_HISTORY).withColumn("std", F.round("std", 4))


def _map_sql(t, x, y, px="s:", py="s:"):
    return f"""
WITH c AS (SELECT '{px}' || {x} AS lhs, '{py}' || {y} AS rhs, count(*) AS n FROM {t} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
s AS (SELECT lhs, sum(n) AS total, list(n ORDER BY n DESC) AS l FROM c GROUP BY 1)
SELECT s.lhs, round(l[1] / total, 6) AS majority_confidence, round((SELECT -sum(c.n / s.total * ln(c.n / s.total + 1e-12)) FROM c WHERE c.lhs = s.lhs), 6) + 0.0 AS entropy, CAST(len(l) AS BIGINT) AS conflict_count, CAST(total AS BIGINT) AS support_count, round((l[1] - coalesce(l[2], 0)) / total, 6) AS top1_margin FROM s
"""


_EDGES = {"returnflag_linestatus": ("lineitem", "l_returnflag", "l_linestatus", "s:"), "brand_type": ("part", "p_brand", "p_type", "s:"), "mktsegment_nation": ("customer", "c_mktsegment", "c_nationkey", "n:")}


def _edge(name, t, x, y, py):
    def fd_map(spark, sf_dir):
        return rounded(fd.ambiguity_map(table(spark, sf_dir, t), x, y), "majority_confidence", "entropy", "top1_margin")

    fd_map.__name__ = f"fd_map_{name}"
    query(_map_sql(t, x, y, "s:", py))(fd_map)


for _n, _e in _EDGES.items():
    _edge(_n, *_e)


@query("""
WITH c AS (SELECT p_brand AS x, p_type AS y, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT x, sum(n) AS t, max(n) AS m, count(*) AS k FROM c GROUP BY 1)
SELECT CAST(sum(t) AS BIGINT) AS support, round(avg(m / t), 6) AS confidence, round(avg(CAST(k > 1 AS INT)), 6) AS conflict_rate, count(*) AS groups, round(count(*) / (SELECT count(DISTINCT p_brand) FROM part), 6) AS coverage, 'accepted' AS status FROM g
""")
def fd_edge_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rounded(fd.edge_summary(fd.ambiguity_map(p, "p_brand", "p_type"), p, "p_brand"), "confidence", "conflict_rate", "coverage")


@query("""
WITH r AS (SELECT row_number() OVER () AS id, p_brand AS x, p_type AS y FROM part), c AS (SELECT x, y, count(*) AS n FROM r GROUP BY ALL), g AS (SELECT x, sum(n) AS t, max(n) AS m, -sum(n / tt * ln(n / tt)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY x) AS tt FROM c) GROUP BY 1),
loo AS (SELECT avg(CAST((SELECT arg_min(y2, (-k, y2)) FROM (SELECT c.y AS y2, c.n - CASE WHEN c.y = r.y THEN 1 ELSE 0 END AS k FROM c WHERE c.x = r.x) WHERE k > 0) = r.y AS INT)) AS v FROM r WHERE (SELECT t FROM g WHERE g.x = r.x) >= 2)
SELECT CAST(sum(t) AS BIGINT) AS support, count(*) AS groups, round(sum(m) / sum(t), 6) AS raw_reliability, round(sum(t) FILTER (t >= 2) / sum(t), 6) AS non_singleton_coverage, round(sum(m) FILTER (t >= 2) / sum(t) FILTER (t >= 2), 6) AS non_singleton_reliability, round((SELECT v FROM loo), 6) AS loo_predictability,
 round(avg(CAST(t < 2 AS INT)), 6) AS singleton_group_ratio, round(avg(t), 6) AS mean_group_size, round(quantile_cont(t, 0.5), 6) AS median_group_size, CAST(max(t) AS BIGINT) AS max_group_size, round(sum(t * h) / sum(t) / ln((SELECT count(DISTINCT y) FROM r)), 6) AS normalized_entropy, round(1 - sum(t * h) / sum(t) / ln((SELECT count(DISTINCT y) FROM r)), 6) AS reliability_entropy FROM g
""")
def fd_reliability(spark, sf_dir):
    return rounded(fd.reliability(table(spark, sf_dir, "part"), "p_brand", "p_type"), "raw_reliability", "non_singleton_coverage", "non_singleton_reliability", "loo_predictability", "singleton_group_ratio", "mean_group_size", "median_group_size", "normalized_entropy", "reliability_entropy")


@query("""
WITH c AS (SELECT 's:' || p_brand AS lhs, 's:' || p_type AS rhs, count(*) AS n FROM part GROUP BY ALL)
SELECT lhs, arg_min(rhs, (-n, rhs)) AS dominant, CAST(sum(n) AS BIGINT) AS support, CAST(sum(n) - max(n) AS BIGINT) AS violations, CAST(greatest(0, floor(sum(n) / 2) - (sum(n) - max(n))) AS BIGINT) AS receive_slots FROM c GROUP BY 1
""")
def fd_violations(spark, sf_dir):
    return fd.violations(table(spark, sf_dir, "part"), "p_brand", "p_type")


def _discovery_sql(x, y):
    return f"""SELECT 'lineitem:{x}->{y}' AS edge_id, CAST(sum(n) AS BIGINT) AS support, round(sum(n) / (SELECT count(*) FROM lineitem), 6) AS coverage, round(max(n) / sum(n), 6) AS confidence, round(avg(CAST(d > 1 AS INT)), 6) AS conflict_rate,
 CASE WHEN max(d) <= 1 THEN 'constant_or_non_informative_edge' WHEN sum(n) < 2 THEN 'support_below_threshold' WHEN sum(n) / (SELECT count(*) FROM lineitem) <= 0.1 THEN 'coverage_below_threshold' ELSE 'accepted' END AS status FROM (SELECT {x}, count({y}) AS n, count(DISTINCT {y}) AS d FROM lineitem GROUP BY 1)"""


_LINE_EDGES = [("l_returnflag", "l_linestatus"), ("l_linestatus", "l_returnflag"), ("l_discount", "l_tax"), ("l_linenumber", "l_returnflag")]


@query(" UNION ALL ".join(_discovery_sql(*e) for e in _LINE_EDGES))
def candidate_edges(spark, sf_dir):
    return rounded(fd.discovery_stats(table(spark, sf_dir, "lineitem"), _LINE_EDGES, "lineitem"), "coverage", "confidence", "conflict_rate")


def _fd_features_sql():
    p = "f_fd__shipments:event_type__to__bin__"
    cols = ", ".join(f'round(CAST(m.{s} AS DOUBLE), 6) + 0.0 AS "{p}{s}"' for s in fd.STATS)
    miss = ", ".join(f'CAST(m.{s} IS NULL AS INTEGER) AS "{p}{s}__is_missing"' for s in fd.STATS)
    return f"""
WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS b FROM {SHIPMENTS}),
e AS (SELECT v.*, 'bin_' || len(list_filter(b, lambda x: x <= value)) AS bin FROM {SHIPMENTS} v, q),
h AS (SELECT a AS hz FROM {_CUTS}),
c AS (SELECT event_type AS lhs, bin AS rhs, count(*) AS n FROM e, h WHERE epoch_us(ts) <= hz GROUP BY ALL),
s AS (SELECT lhs, sum(n) AS total, list(n ORDER BY n DESC) AS l FROM c GROUP BY 1),
m AS (SELECT lhs, l[1] / total AS majority_confidence, (SELECT -sum(c.n / s.total * ln(c.n / s.total + 1e-12)) FROM c WHERE c.lhs = s.lhs) AS entropy, len(l) AS conflict_count, total AS support_count, (l[1] - coalesce(l[2], 0)) / total AS top1_margin FROM s)
SELECT t.o_orderkey, {cols}, {miss} FROM orders t
LEFT JOIN LATERAL (SELECT event_type FROM {SHIPMENTS} x WHERE x.user_id = t.o_custkey AND x.ts < t.o_orderdate ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) a ON true LEFT JOIN m ON m.lhs = a.event_type
"""


@query(_fd_features_sql())
def fd_features_shipments(spark, sf_dir):
    e, o = _shipments(spark, sf_dir), _orders(spark, sf_dir)
    b = e.withColumn("bin", bin_label(F.col("value"), quantile_bounds(e, "value", 4))).withColumnRenamed("user_id", "o_custkey")
    out = fd.features(o, b, "o_orderkey", "o_custkey", "o_orderdate", "ts", "event_type", "bin", ["event_id"], F.lit(_cuts(o)[0]), "shipments")
    return rounded(out, *(c for c in out.columns if c.startswith("f_fd") and not c.endswith("is_missing")))


@query("""
WITH q AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS b FROM lineitem)
SELECT 'bin_' || len(list_filter(b, lambda x: x <= l_extendedprice)) AS bin, count(*) AS n FROM lineitem, q GROUP BY 1
""")
def quantile_bins_extendedprice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(bin_label(F.col("l_extendedprice"), quantile_bounds(li, "l_extendedprice", 8)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT epoch_us(min(o_orderdate)) AS lo, epoch_us(max(o_orderdate)) AS hi FROM orders), b AS (SELECT lo + (hi - lo) * 3 // 5 AS a, lo + (hi - lo) * 4 // 5 AS z FROM m)
SELECT CASE WHEN epoch_us(o_orderdate) <= a THEN 'train' ELSE 'validation' END AS split, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, b WHERE epoch_us(o_orderdate) <= z GROUP BY 1
""")
def temporal_split(spark, sf_dir):
    o = _orders(spark, sf_dir)
    lo, hi = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    us = dt.timedelta(microseconds=1)
    a, z = (lo + (hi - lo) // us * k // 5 * us for k in (3, 4))
    train, validation = shaping.temporal_split(o, "o_orderdate", a, z)
    both = train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""
WITH c AS (SELECT o_custkey, max(o_orderdate) AS m FROM orders, {_CUTS} WHERE epoch_us(o_orderdate) <= a GROUP BY 1)
SELECT e.event_id, e.user_id FROM {SHIPMENTS} e JOIN c ON c.o_custkey = e.user_id AND e.ts <= c.m
""")
def fit_table(spark, sf_dir):
    o = _orders(spark, sf_dir)
    train, _ = shaping.temporal_split(o, "o_orderdate", *_cuts(o))
    return shaping.fit_table(_shipments(spark, sf_dir), train, "user_id", "o_custkey", "ts", "o_orderdate").select("event_id", "user_id")


@query("""
WITH t AS (SELECT o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate) AS r FROM (SELECT DISTINCT o_orderdate FROM orders)), u AS (SELECT count(*) AS n FROM t), s AS (SELECT n, n - CAST(ceil(0.4 * n) AS BIGINT) AS st FROM u),
e AS (SELECT n, st, (n - st) // 3 AS q, (n - st) % 3 AS m FROM s), f AS (SELECT 1 AS fold, st AS a, st + q + CAST(m > 0 AS INT) AS b FROM e UNION ALL SELECT 2, st + q + CAST(m > 0 AS INT), st + 2 * q + CAST(m > 0 AS INT) + CAST(m > 1 AS INT) FROM e UNION ALL SELECT 3, st + 2 * q + CAST(m > 0 AS INT) + CAST(m > 1 AS INT), n FROM e)
SELECT CAST(fold AS INTEGER) AS fold, (SELECT d FROM t WHERE r = a) AS train_upto, (SELECT d FROM t WHERE r = b) AS validation_upto FROM f
""")
def inner_folds(spark, sf_dir):
    folds = shaping.inner_folds(_orders(spark, sf_dir), "o_orderdate", 3)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(folds, 1)], "fold int, train_upto timestamp_ntz, validation_upto timestamp_ntz")


@query("SELECT count(*) AS rows, round(avg(CAST(c_custkey IS NOT NULL AS INT)), 6) AS coverage, count(*) FILTER (c_custkey IS NULL) AS orphans FROM events LEFT JOIN customer ON c_custkey = user_id WHERE user_id IS NOT NULL")
def referential_coverage(spark, sf_dir):
    return rounded(shaping.coverage(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "customer"), "c_custkey"), "coverage")


@query(f"SELECT count(*) AS rows, round(avg(CAST(EXISTS (SELECT 1 FROM {SHIPMENTS} e WHERE e.user_id = o_custkey AND e.ts < o_orderdate) AS INT)), 6) AS history_coverage FROM orders")
def history_coverage(spark, sf_dir):
    return rounded(shaping.history_coverage(_orders(spark, sf_dir), "o_custkey", "o_orderdate", _shipments(spark, sf_dir), "user_id", "ts", True), "history_coverage")


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, round((count(*) - count({c})) / count(*), 6) AS null_fraction, count(DISTINCT {c}) AS distinct_count, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS unique_non_null, count(DISTINCT {c}) <= 1 AS constant FROM customer" for c in _CUSTOMER))
def table_profile(spark, sf_dir):
    return rounded(shaping.profile(table(spark, sf_dir, "customer")), "null_fraction")


@query("""
SELECT 'event_id' AS "column", count(DISTINCT event_id) AS distinct_count, 'identifier' AS semantic FROM events UNION ALL SELECT 'ts', count(DISTINCT ts), 'timestamp' FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id), 'foreign_key' FROM events
UNION ALL SELECT 'event_type', count(DISTINCT event_type), CASE WHEN count(DISTINCT event_type) > 256 OR avg(length(event_type)) > 80 THEN 'free_text' WHEN count(DISTINCT event_type) <= 64 THEN 'low_cardinality_categorical' ELSE 'high_cardinality_categorical' END FROM events
UNION ALL SELECT 'value', count(DISTINCT value), 'continuous' FROM events UNION ALL SELECT 'props', count(DISTINCT props), CASE WHEN count(DISTINCT props) > 256 OR avg(length(props)) > 80 THEN 'free_text' WHEN count(DISTINCT props) <= 64 THEN 'low_cardinality_categorical' ELSE 'high_cardinality_categorical' END FROM events
""")
def column_semantics(spark, sf_dir):
    return shaping.semantics(table(spark, sf_dir, "events"), "event_id", ("user_id",))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM (SELECT o_custkey, o_orderdate FROM orders) GROUP BY o_custkey, o_orderdate)")
def duplicate_keys(spark, sf_dir):
    return shaping.duplicate_rows(_orders(spark, sf_dir).select("o_custkey", "o_orderdate"))


@query("SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embedding__{i}" for i in range(64)) + " FROM embeddings")
def scalarize_embedding(spark, sf_dir):
    return shaping.scalarize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")


@query("SELECT o_orderkey, round(c_acctbal, 6) AS c_acctbal, CAST(d AS INTEGER) AS c_mktsegment__code FROM orders LEFT JOIN (SELECT *, dense_rank() OVER (ORDER BY c_mktsegment) AS d FROM customer) ON c_custkey = o_custkey")
def static_customer_features(spark, sf_dir):
    out = shaping.static_features(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"], ["c_mktsegment"])
    return rounded(out, "c_acctbal").drop("o_custkey")


@query(f"""
WITH tr AS (SELECT orders.* FROM orders, {_CUTS} WHERE epoch_us(o_orderdate) <= a), m AS (SELECT quantile_cont(o_totalprice, 0.5) AS md FROM tr), k AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS c FROM (SELECT DISTINCT o_orderpriority FROM tr))
SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate) <= a THEN 'train' ELSE 'other' END AS split, round(coalesce(o_totalprice, md), 6) AS o_totalprice, CAST(coalesce(c, -1) AS INTEGER) AS o_orderpriority__code FROM orders JOIN m ON true JOIN {_CUTS} ON true LEFT JOIN k ON p = o_orderpriority
""")
def train_only_encoding(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    end = F.lit(_cuts(o)[0])
    out = shaping.train_encoding(o.filter(F.col("o_orderdate") <= end), o.withColumn("split", F.when(F.col("o_orderdate") <= end, "train").otherwise("other")), ["o_totalprice"], ["o_orderpriority"])
    return rounded(out, "o_totalprice").select("o_orderkey", "split", "o_totalprice", "o_orderpriority__code")


def _scored(spark, sf_dir):
    """Deterministic labels and scores with ties."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") * (1 + F.col("l_discount"))).cast("int").alias("s"), "l_extendedprice", "l_quantity", "l_tax", "l_linestatus", "l_returnflag")


_S = "WITH z AS (SELECT CAST(l_returnflag = 'R' AS INT) AS y, CAST(floor(l_quantity * (1 + l_discount)) AS INT) AS s, * FROM lineitem)"


@query(f"{_S}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM z) SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def metric_auc(spark, sf_dir):
    return rounded(metrics.auc(_scored(spark, sf_dir), "y", "s"), "auc")


@query(f"{_S}, g AS (SELECT s, sum(y) AS p, count(*) AS m FROM z GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) / sum(m) OVER (ORDER BY s DESC) AS pr FROM g) SELECT round(sum(p * pr) / sum(p), 6) AS average_precision FROM c")
def metric_ap(spark, sf_dir):
    return rounded(metrics.average_precision(_scored(spark, sf_dir), "y", "s"), "average_precision")


@query("SELECT round(sqrt(avg((l_quantity - 25 - 10 * l_tax) ** 2)), 6) AS rmse, round(avg((l_quantity - 25 - 10 * l_tax) ** 2), 6) AS mse, round(avg(abs(l_quantity - 25 - 10 * l_tax)), 6) AS mae, round(1 - sum((l_quantity - 25 - 10 * l_tax) ** 2) / (var_pop(l_quantity) * count(*)), 6) AS r2 FROM lineitem")
def metric_rmse(spark, sf_dir):
    return rounded(metrics.regression(_scored(spark, sf_dir).withColumn("p", 25 + 10 * F.col("l_tax")), "l_quantity", "p"), "rmse", "mse", "mae", "r2")


@query("""
WITH z AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 30 THEN 'N' WHEN l_quantity > 15 THEN 'R' ELSE 'A' END AS p FROM lineitem), k AS (SELECT DISTINCT y AS k FROM z UNION SELECT DISTINCT p FROM z),
f AS (SELECT k, (SELECT count(*) FROM z WHERE y = k) AS t, (SELECT count(*) FROM z WHERE p = k) AS q, (SELECT count(*) FROM z WHERE p = k AND y = k) AS h FROM k)
SELECT round(sum(h) / sum(t), 6) AS accuracy, round(avg(2 * h / (t + q)), 6) AS macro_f1, round(2 * sum(h) / (sum(t) + sum(q)), 6) AS micro_f1, round(sum(2 * h / (t + q) * t) / sum(t), 6) AS weighted_f1 FROM f
""")
def metric_macro_f1(spark, sf_dir):
    z = _scored(spark, sf_dir).withColumn("p", F.when(F.col("l_quantity") > 30, "N").when(F.col("l_quantity") > 15, "R").otherwise("A"))
    return rounded(metrics.f1(z, "l_returnflag", "p"), "accuracy", "macro_f1", "micro_f1", "weighted_f1")


@query(f"{_S}, r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM z) SELECT round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, sf_dir):
    return rounded(metrics.spearman(_scored(spark, sf_dir), "s", "l_extendedprice"), "rho")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS b, avg(o_totalprice) AS m FROM orders)
SELECT CASE WHEN o_totalprice <= b[1] THEN 1 WHEN o_totalprice <= b[2] THEN 2 WHEN o_totalprice <= b[3] THEN 3 ELSE 4 END AS quartile, count(*) AS rows, round(avg(o_orderkey % 7 - 3), 6) AS mean, round(quantile_cont(CAST(o_orderkey % 7 - 3 AS DOUBLE), 0.5), 6) AS median, round(avg(CAST(o_orderkey % 7 - 3 > 0 AS INT)), 6) AS positive_fraction FROM orders, q GROUP BY 1
""")
def quartile_summary(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("v", (F.col("o_orderkey") % 7 - 3).cast("double"))
    return rounded(metrics.quartile_summary(o, "o_totalprice", "v"), "mean", "median", "positive_fraction")


@query("""
SELECT o_orderpriority AS edge, round(avg(g), 6) AS mean_gain, round(min(g), 6) AS worst_gain, count(*) FILTER (g > 0) AS positive_folds, avg(g) > 0 AND count(*) FILTER (g > 0) >= 2 AS selected
FROM (SELECT o_orderpriority, year(o_orderdate) % 3 AS fold, avg((o_orderkey % 11) - 5) AS g FROM orders GROUP BY ALL) GROUP BY 1
""")
def fold_gain_summary(spark, sf_dir):
    g = _orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("edge"), (F.year("o_orderdate") % 3).alias("fold")).agg(F.avg(F.col("o_orderkey") % 11 - 5).alias("g"))
    return rounded(metrics.fold_gain_summary(g, "edge", "g", 3), "mean_gain", "worst_gain")


@query("""
SELECT o_orderpriority AS program, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std_sample, round(stddev_pop(o_totalprice), 6) AS std_population, round(stddev_pop(o_totalprice) / sqrt(count(*)), 6) AS sem FROM orders GROUP BY 1
""")
def seed_summary(spark, sf_dir):
    return rounded(metrics.seed_summary(_orders(spark, sf_dir).withColumnRenamed("o_orderpriority", "program"), ["program"], "o_totalprice"), "mean", "std_sample", "std_population", "sem")


@query("""
SELECT o_orderstatus AS predictor, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, round(avg(d), 6) AS mean_delta FROM (SELECT o_orderstatus, o_orderkey % 5 - 2 AS d FROM orders) GROUP BY 1
""")
def win_tie_loss(spark, sf_dir):
    d = _orders(spark, sf_dir).select(F.col("o_orderstatus").alias("predictor"), (F.col("o_orderkey") % 5 - 2).alias("d"))
    return rounded(metrics.win_tie_loss(d, ["predictor"], "d"), "mean_delta")


_P = "f_pairwise__"


@query(f"""
SELECT t.o_orderkey, t.o_orderstatus,
  (SELECT count(*) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate AND s.ts >= t.o_orderdate - INTERVAL 30 DAY) AS {_P}left__count_30d,
  (SELECT count(*) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate AND s.ts >= t.o_orderdate - INTERVAL 90 DAY) AS {_P}left__count_90d,
  (SELECT count(*) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate AND s.ts >= t.o_orderdate - INTERVAL 365 DAY) AS {_P}left__count_365d,
  (SELECT count(DISTINCT event_type) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate AND s.ts >= t.o_orderdate - INTERVAL 30 DAY) AS {_P}left__unique_neighbors_30d,
  (SELECT count(DISTINCT event_type) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate AND s.ts >= t.o_orderdate - INTERVAL 90 DAY) AS {_P}left__unique_neighbors_90d,
  coalesce((SELECT round(epoch_us(t.o_orderdate - max(s.ts)) / 86400000000.0, 6) FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate), 0.0) AS {_P}left__days_since_last,
  CAST(NOT EXISTS (SELECT 1 FROM {SHIPMENTS} s WHERE s.user_id = t.o_custkey AND s.ts < t.o_orderdate) AS INTEGER) AS {_P}left__days_since_last__is_missing,
  (SELECT count(*) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND s.o_orderdate < t.o_orderdate) AS {_P}pair__prior_count,
  coalesce((SELECT round(epoch_us(t.o_orderdate - max(s.o_orderdate)) / 86400000000.0, 6) FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND s.o_orderdate < t.o_orderdate), 0.0) AS {_P}pair__days_since_last,
  CAST(NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_custkey = t.o_custkey AND s.o_orderstatus = t.o_orderstatus AND s.o_orderdate < t.o_orderdate) AS INTEGER) AS {_P}pair__days_since_last__is_missing
FROM orders t
""")
def compiled_pairwise_program(spark, sf_dir):
    o, e = _orders(spark, sf_dir), _shipments(spark, sf_dir)
    task = Task("o_orderkey", "o_orderdate", "o_totalprice", ("o_orderstatus",), (HistorySpec("left", "o_custkey", "user_id", "ts", "event_type"),), PairSpec(("o_custkey", "o_orderstatus"), ("o_custkey", "o_orderstatus"), "o_orderdate"))
    out = compile_task(task, o, {"left": e, "pair": o})
    return rounded(out, f"{_P}left__days_since_last", f"{_P}pair__days_since_last")


@query()
def fd_corruption_summary(spark, sf_dir):
    """Seeded hashes choose the swaps, so there is no SQL; tests hold it against its invariants."""
    o = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus")
    return corruption.corruption_summary(o, corruption.corrupt(o, "o_orderkey", "o_custkey", "o_orderstatus", 0.5, 17), "o_orderkey", "o_custkey", "o_orderstatus")


from . import queries_selection  # noqa: E402, F401  registers its queries here
