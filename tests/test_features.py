"""Golden values, and every SQL-backed query of the feature engine against DuckDB on the small tables."""
import datetime as dt
import os

import oracle
import pytest
from pyspark.sql import functions as F

from foretide import queries
from foretide.functions.tokens import bin_label, quantile_bounds, token
from foretide.operators import fd, shaping
from foretide.operators.asof import asof_join, history, strict_prior
from foretide.plans import selection
from foretide.plans.program import HistorySpec, Task, compile_task

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    said = oracle.difference(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.ORACLE_SQL[name])
    assert said is None or said.startswith("~"), said


def day(n):
    return dt.datetime(2026, 6, 1) + dt.timedelta(days=n)


def test_window_bounds(spark):
    """[T - W, T): the lower bound counts, the upper does not."""
    t = spark.createDataFrame([(1, "u", day(0))], "id int, k string, t timestamp_ntz")
    s = spark.createDataFrame([("u", day(-31), "old"), ("u", day(-30), "a"), ("u", day(-10), "a"), ("u", day(-1), "b"), ("u", day(0), "c")], "k string, e timestamp_ntz, beer string")
    r = strict_prior(t, s, "id", ["k"], "t", "e", {"30d": 30}, "beer").first()
    assert (r.count_30d, r.unique_30d, r.days_since_last, r.prior_count) == (3, 2, 1.0, 4)
    none = strict_prior(t, s.filter("k = 'x'"), "id", ["k"], "t", "e", {"30d": 30}).first()
    assert (none.count_30d, none.days_since_last, none.days_since_last_missing) == (0, 0.0, 1)


def test_asof(spark):
    d = lambda s: dt.datetime.fromisoformat(s)
    t = spark.createDataFrame([(0, "d1", d("2020-01-05")), (1, "d1", d("2020-01-15")), (2, "d2", d("2020-01-10")), (3, "d1", d("2019-12-31")), (4, None, d("2020-01-15")), (5, "d1", None)], "id int, k string, t timestamp_ntz")
    s = spark.createDataFrame([("d1", d("2020-01-01"), 1, 0), ("d1", d("2020-01-10"), 2, 1), ("d1", d("2020-02-01"), 99, 2), ("d2", d("2020-01-01"), 7, 3), (None, d("2020-01-01"), 5, 4), ("d1", None, 6, 5)], "k string, e timestamp_ntz, wins int, pos int")
    got = {r.id: r.wins for r in asof_join(t, s, "id", ["k"], "t", "e", ["wins"], ["pos"]).collect()}
    assert got == {0: 1, 1: 2, 2: 7, 3: None, 4: None, 5: None}
    tie = spark.createDataFrame([("d1", d("2020-01-10"), 1, 0), ("d1", d("2020-01-10"), None, 1)], s.schema)
    assert asof_join(t.filter("id = 1"), tie, "id", ["k"], "t", "e", ["wins"], ["pos"]).first().wins is None  # the latest row's null stays
    at = spark.createDataFrame([(0, "d1", d("2020-01-10"))], t.schema)
    assert asof_join(at, s, "id", ["k"], "t", "e", ["wins"], ["pos"]).first().wins == 2
    assert asof_join(at, s, "id", ["k"], "t", "e", ["wins"], ["pos"], strict=True).first().wins == 1


def test_history(spark):
    t = spark.createDataFrame([("u1", day(10)), ("u2", day(10)), ("u3", day(10))], "k string, t timestamp_ntz")
    s = spark.createDataFrame([(1, "u1", day(0), 10.0, "a"), (2, "u1", day(5), 20.0, "b"), (3, "u3", day(1), 7.0, "a"), (4, "u3", day(20), 9.0, "b"), (5, "u1", day(20), 99.0, "c")], "id int, k string, e timestamp_ntz, x double, c string")
    r = {x.k: x for x in history(t, s, "k", ["k"], "t", "e", "x", "c", ["id"]).collect()}
    u1, u2, u3 = r["u1"], r["u2"], r["u3"]
    assert (u1["count"], u1.mean, u1.std, u1.min, u1.max, u1.last, u1.days_since_last, u1.nunique, u1.active_span_days) == (2, 15, 5, 10, 20, 20, 5.0, 2, 5.0)
    assert (u2["count"], u2.mean, u2.std, u2.days_since_last, u2.nunique) == (0, None, None, None, 0)
    assert (u3["count"], u3.mean, u3.nunique, u3.event_frequency) == (1, 7, 1, None)


@pytest.mark.parametrize("x,y,want", [
    (["06236"] * 4 + ["07011"], ["gold", "gold", "silver", "silver", "bronze"], {"raw_reliability": 0.6, "non_singleton_coverage": 0.8, "non_singleton_reliability": 0.5}),
    (list("aabb"), list("uuvv"), {"raw_reliability": 1.0, "loo_predictability": 1.0, "normalized_entropy": 0.0}),
    (list("aabb"), list("uvuv"), {"raw_reliability": 0.5, "normalized_entropy": 1.0}),
    (list("abc"), list("uvw"), {"raw_reliability": 1.0, "non_singleton_coverage": 0.0, "loo_predictability": None}),
    (list("aaaa"), list("uuvv"), {"loo_predictability": 0.0}),
    (["a", "a", None, "b", "b"], ["u", None, "v", "w", "w"], {"support": 3, "groups": 2, "raw_reliability": 1.0}),
])
def test_reliability(spark, x, y, want):
    r = fd.reliability(spark.createDataFrame(list(zip(x, y)), "x string, y string"), "x", "y").first()
    for k, v in want.items():
        assert r[k] == (pytest.approx(v) if v is not None else None), k


def test_ambiguity_map(spark):
    r = fd.ambiguity_map(spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1)], "x string, y int"), "x", "y").collect()
    m = {x.lhs: x for x in r}
    assert set(m) == {"s:a", "s:b"} and m["s:a"].top1_margin == pytest.approx(1 / 3) and m["s:a"].conflict_count == 2 and m["s:b"].top1_margin == 1


def test_fit_table(spark):
    s = spark.createDataFrame([(i, day(i)) for i in (1, 2, 3, 4)], "u int, e timestamp_ntz")
    t = spark.createDataFrame([(1, day(1)), (1, day(9)), (3, day(2))], "u int, t timestamp_ntz")
    assert [r.u for r in shaping.fit_table(s, t, "u", "u").orderBy("u").collect()] == [1, 3]
    assert [r.u for r in shaping.fit_table(s, t, "u", "u", "e", "t").collect()] == [1]
    with pytest.raises(ValueError):
        shaping.fit_table(s, t, "u", "u", "e")


def test_tokens_and_bins(spark):
    df = spark.createDataFrame([(1.0, 3, True, "x"), (0.5, None, None, None)], "d double, i int, b boolean, s string")
    got = [tuple(r) for r in df.select(*(token(df, c) for c in df.columns)).collect()]
    assert got == [("n:1", "n:3", "b:1", "s:x"), ("n:0.5", "__NULL__", "__NULL__", "__NULL__")]
    n = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9)], "v double")
    assert quantile_bounds(n, "v", 4) == [1.75, 3.0, 5.25]
    assert [r[0] for r in n.select(bin_label(F.col("v"), [1.75, 3.0])).collect()] == ["bin_0", "bin_1", "bin_2", "bin_2"]


def test_folds(spark):
    df = spark.createDataFrame([(day(i),) for i in range(10) for _ in range(2)], "t timestamp_ntz")
    assert shaping.inner_folds(df, "t", 1) == [(day(7), day(9))]
    assert shaping.inner_folds(df, "t", 3) == [(day(5), day(7)), (day(7), day(8)), (day(8), day(9))]


def test_align_and_compile_raise(spark):
    a, b = spark.createDataFrame([(1, 2)], "id int, x int"), spark.createDataFrame([(2, 2)], "id int, z int")
    # alignment is one join, which raises when it is read
    for left, right, what in ((a, b, "missing_rows|extra_rows"), (a, a.selectExpr("id", "x AS z").union(a), "repeated_rows")):
        with pytest.raises(Exception, match=what):
            shaping.align(left, right, "id").collect()
    assert shaping.align(a, a.selectExpr("id", "x AS z"), "id").collect() == [(1, 2, 2)]
    t = spark.createDataFrame([(1, None, day(0))], "id int, k string, t timestamp_ntz")
    with pytest.raises(ValueError, match="null_target"):
        compile_task(Task("id", "t", histories=(HistorySpec("l", "k", "k", "t"),)), t, {"l": t})


def test_selection():
    assert selection.windows_for(90) == (30, 90, 365)
    assert selection.consistent_gate([1, 1], [2, 2], True) and not selection.consistent_gate([1, 1], [2, 1], True)
    with pytest.raises(ValueError):
        selection.consistent_gate([1], [float("nan")], True)
    worth = {"a": 3, "b": 2, "c": 0}
    chosen, trace = selection.forward_backward(list(worth), lambda s: sum(worth[x] for x in s), 3)
    assert chosen == ["a", "b"] and len(trace) == 2
    assert selection.joint_variant({"declared": 1, "auto": 1, "auto+fd": 2}) == "auto+fd"
    assert selection.budgets(20) == {"features": 8, "candidate_edges": 16, "selected_edges": 16}


def test_entry_without_training_data_operators(tmp_path):
    """The rest works where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/foretide", tmp_path / "foretide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[0] == str(len(queries.QUERIES))


def test_corruption_keeps_marginals_and_grows_with_the_rate(spark):
    from foretide.operators import corruption

    made = [(i, f"x{i % 4}", None if i % 17 == 0 else f"y{i % 4 if i % 10 else (i + 1) % 4}", i * 3) for i in range(400)]
    df = spark.createDataFrame(made, "id int, x string, y string, z int").cache()

    def changed(rate, seed=5):
        rows = corruption.corrupt(df, "id", "x", "y", rate, seed).orderBy("id").collect()
        assert [(r.id, r.x, r.z) for r in rows] == [(a, b, d) for a, b, _, d in made]
        assert sorted(map(str, (r.y for r in rows))) == sorted(str(m[2]) for m in made)
        out = {r.id: r.y for r, m in zip(rows, made) if r.y != m[2]}
        assert not any(made[i][2] is None for i in out)
        return out

    none, half, whole = changed(0.0), changed(0.5), changed(1.0)
    assert not none and 0 < len(half) < len(whole) and set(half) <= set(whole) and len(whole) % 2 == 0
    assert changed(0.5) == half
    after = corruption.corrupt(df, "id", "x", "y", 1.0, 5)
    for r in fd.violations(after, "x", "y").collect():
        assert 2 * r.violations <= r.support
    assert corruption.corrupt(df.limit(0), "id", "x", "y", 1.0, 5).count() == 0
    for bad, rate in ((df, 1.5), (df.union(df), 0.5)):
        with pytest.raises(ValueError):
            corruption.corrupt(bad, "id", "x", "y", rate, 5)


def test_replayed_edges(spark, tmp_path):
    from foretide.sources import replay

    tables = {"t": spark.createDataFrame([(1, "a", 2.0)], "id int, x string, v double")}
    edges = [replay.Edge("e1", "t", ("x", "id"), "v_bin", {"v_bin": "v"}), replay.Edge("e2", "t", ("id",), "x")]
    (tmp_path / "e.json").write_text(replay.dump_edges(edges))
    (tmp_path / "e.csv").write_text("edge_id,source_table,lhs_columns,rhs_column\ne1,t,x|id,v\n")
    assert replay.load_edges(spark, str(tmp_path / "e.json"), tables) == edges
    assert replay.load_edges(spark, str(tmp_path / "e.json"), tables, 1) == edges[:1]
    assert replay.load_edges(spark, str(tmp_path / "e.csv"), tables)[0].lhs_columns == ("x", "id")
    assert replay.parse("[]", "json") == []
    for bad in ({"edge_id": "e", "source_table": "u", "lhs_columns": "x", "rhs_column": "v"}, {"edge_id": "e", "source_table": "t", "lhs_columns": "x", "rhs_column": "w"}, {"edge_id": "e", "source_table": "t"}):
        with pytest.raises(ValueError):
            replay.check([replay._edge(bad)], tables)
    for text, suffix in (("edge_id,source_table,lhs_columns,rhs_column\n", "csv"), ('{"edges": []}', "json"), ("", "txt")):
        with pytest.raises(ValueError):
            replay.parse(text, suffix)


def test_corruption_of_orders(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    r = queries.QUERIES["fd_corruption_summary"](spark, SMALL).first()
    assert 0 < r.changed_rows < r.eligible_rows and r.marginals_preserved and r.violations_after > r.violations_before
