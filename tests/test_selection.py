"""Relations, discovery, screening, gates and audits: SQL comparisons have values in them, and rules hold
on small cases."""
import math

import oracle
import pytest
from pyspark.sql import functions as F

from foretide import queries
from foretide.functions.tokens import token
from foretide.operators import discovery, evaluation, relations, shaping
from foretide.plans import safety, screening

SF = "/root/testdata/sf0.001"
#: Answers that are one verdict, for which a constant is right.
CONSTANT = {"duplicate_keys", "referential_coverage", "duplicate_features", "relation_choice", "seeded_sample", "rejection_reasons"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def meaningful(rows):
    """Some column that is not a key has a value that is neither null nor zero."""
    return bool(rows) and any(v not in (None, 0, 0.0, "", False) for r in rows for v in list(r)[1:] or list(r))


@pytest.mark.parametrize("name", [n for n, f in queries.QUERIES.items() if f.__module__.endswith("queries_selection")])
def test_query_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    assert (oracle.difference(df, con, queries.ORACLE_SQL[name]) or "~").startswith("~")
    assert name in CONSTANT or meaningful(df.collect())


@pytest.mark.parametrize("name", ["fit_table", "asof_audit_shipments", "history_baseline_shipments", "history_coverage", "fd_features_shipments", "compiled_pairwise_program", "train_only_encoding"])
def test_histories_are_there(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert meaningful(rows)
    if len(rows) > 1:  # some generated column has more than one value
        assert any(len({r[c] for r in rows}) > 1 for c in range(1, len(rows[0])))


def test_tokens_have_no_exponents(spark):
    values = [0.00001, 12345678.5, 1e20, -1.5e-7, 0.1, -0.0, 123.0, 1.25e16, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(token(df, "x")).collect()]
    assert got == ["n:0.00001", "n:12345678.5", "n:100000000000000000000", "n:-0.00000015", "n:0.1", "n:0", "n:123", "n:12500000000000000", "n:+inf", "__NULL__"]


def test_folds_needed():
    assert screening.folds_needed(5) == 3 and screening.folds_needed(3, "positive_fraction", fraction="0.67") == 3 and screening.folds_needed(3, "pooled_oof", fraction="0.5") == 2
    with pytest.raises(ValueError):
        screening.folds_needed(3, least=4)
    with pytest.raises(ValueError):
        screening.folds_needed(3, "other")


def test_strategies():
    alone = {"a": [3, 1, 2], "b": [1, 1, 1], "c": [-1, 0.5, -1], "d": [0, 0, 0]}
    gains = lambda s: [sum(alone[e][i] for e in s) - (2 if {"a", "b"} <= set(s) else 0) for i in range(3)]
    assert screening.choose_edges("abcd", gains, 2, "independent") == ["a", "b"]
    assert screening.choose_edges("abcd", gains, 2) == ["a"]  # b adds nothing to a
    only_pairs = lambda s: [1.0 if {"c", "d"} <= set(s) else -1.0] * 3
    assert sorted(screening.choose_edges("abcd", only_pairs, 2)) == ["c", "d"]
    assert screening.choose_edges("ab", lambda s: [math.nan] * 3, 2) == []
    step = {("a",): 3, ("b",): 2, ("c",): 1, ("a", "b"): 4, ("a", "c"): 3.5, ("b", "c"): 6, ("a", "b", "c"): 6}
    back = lambda s: [float(step[tuple(s)])] * 3
    assert screening.choose_edges("abc", back, 2) == ["a", "b", "c"] and screening.choose_edges("abc", back, 2, "greedy_backward") == ["b", "c"]


def test_safety():
    assert safety.leakage(["x", "y"], "label").safe
    bad = safety.leakage(["label", "id", "p1", "agg", "x", "x"], "label", ["id"], ["p1"], {"agg": False})
    assert not bad.safe and len(bad.reasons) == 5
    good = safety.Step("f", safety.GENERATE, "s", "s_time", "t_time", "s_time < t_time")
    assert safety.temporal([good]).safe and safety.temporal([safety.Step("f", safety.GENERATE, "s", "s_time", "t_time", "t.t_time > s.s_time")]).safe
    for p in ("s_time <= t_time", "s_time < other", "t_time < s_time", None):
        assert safety.temporal([safety.Step("f", safety.GENERATE, "s", "s_time", "t_time", p)]).safe is False
    assert safety.provenance([good]).safe and not safety.provenance([safety.Step("e", safety.EXTERNAL)]).safe
    assert safety.merged([safety.Verdict(True), safety.Verdict(False, ("x",))]).safe is False and safety.merged([safety.Verdict(True), safety.Verdict(None)]).safe is None
    assert safety.bindings([("a", "x"), ("b", "y")], ["a", "b"], ["y", "x"]) == [("b", "y"), ("a", "x")]
    for pairs, wanted in (([("a", "x"), ("a", "y")], ["x"]), ([("z", "x")], ["x"]), ([("a", "x")], ["y"])):
        with pytest.raises(ValueError):
            safety.bindings(pairs, ["a", "b"], wanted)


def test_relations_refuse(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "d long, r long")
    twice = a.union(spark.createDataFrame([(1, 30)], "d long, r long"))
    df = spark.createDataFrame([(1,), (None,), (2,)], "x long")
    assert sorted((r.x for r in relations.raw_ids(df, "x", a, "d", "r").collect()), key=str) == [10, 20, None]
    for bad, m in ((df, twice), (spark.createDataFrame([(9,)], "x long"), a)):
        with pytest.raises(Exception, match="id_mapping_not_bijective|unmapped_id"):
            relations.raw_ids(bad, "x", m, "d", "r").collect()
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row long, v string")
    assert relations.enrich(rows, "row", a, "d", ["r"]).count() == 2
    with pytest.raises(Exception, match="enrichment_not_one_to_one"):
        relations.enrich(rows, "row", twice, "d", ["r"]).collect()
    assert relations.random_edges(["c", "a", "b"], 2, 4) == relations.random_edges(["a", "b", "c"], 2, 4)
    with pytest.raises(ValueError):
        relations.random_edges(["a"], 2, 1)
    entity = spark.createDataFrame([(1, "x"), (2, "x")], "User_Id long, name string")
    assert relations.resolve_join_column(entity, "userid") == "User_Id" and relations.resolve_join_column(entity, "other") == "User_Id"


def test_edges_of_small_tables(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2], float(i % 3), None, f"u{i}") for i in range(30)], "id long, a string, b string, c double, d string, url string")
    audit = discovery.eligibility(df, discovery.Roles(primary_key="id"))
    reasons = {r.column: (r.exclusion_reason, r.determinant_reason) for r in audit.collect()}
    assert reasons["id"][0] == "primary_key_excluded" and reasons["url"][0] == "unsafe_name_excluded" and reasons["d"][0] == "constant_or_empty_excluded" and reasons["a"] == (None, None)
    got = {r.edge_id: r.status for r in discovery.edges(df, "t", audit).collect()}
    assert got["t:a->c"] == "constant_or_non_informative_edge" and got["t:a->b"] == "accepted" and len(got) == 6
    assert "t:a->c" not in {r.edge_id for r in discovery.edges(df, "t", audit, binned=frozenset("ac")).collect()}
    empty = df.limit(0)
    assert discovery.edges(empty, "t", discovery.eligibility(empty, discovery.Roles())).count() == 0
    with pytest.raises(ValueError):
        discovery.earliest_fold_edges(df, "id", [], "t", discovery.Roles())


def test_labels_and_times(spark):
    df = spark.createDataFrame([("1.0",), (" 2 ",), ("x",), ("",), (None,), ("2.5",)], "l string")
    assert [r[0] for r in df.select(evaluation.canonical_label(df, "l")).collect()] == ["1", "2", "x", None, None, "2.5"]
    t = spark.createDataFrame([("12.5",), ("1:02",), ("1:00:01",), ("a",)], "t string")
    assert [r[0] for r in t.select(evaluation.seconds(F.col("t"))).collect()] == [12.5, 62.0, 3601.0, None]


def test_splits_refuse_missing_times_and_empty_sides(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(1, day(1)), (2, day(5)), (3, day(9))], "id long, t timestamp_ntz")
    a, b = shaping.temporal_split(df, "t", day(2), day(6))
    assert (a.count(), b.count()) == (1, 1)
    for bad in ((df, day(2), day(4)), (df.union(spark.createDataFrame([(4, None)], "id long, t timestamp_ntz")), day(2), day(6)), (df, day(6), day(2))):
        with pytest.raises(ValueError):
            shaping.temporal_split(bad[0], "t", *bad[1:])
