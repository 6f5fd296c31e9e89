"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document d of source s gets a rate r_d in [0, 2], how often the mix takes it.  Among all
rates whose words meet the source's target T_s, the mix has those nearest to 1 in relative
entropy: min sum(r log r - r) subject to sum(size_d r_d) = T_s.  The convex dual has one
multiplier a source, and r_d = min(2, exp(lambda_s size_d / scale_s)).  Newton steps on the dual
(guarded by a bracket) are aggregations over (source, size) classes.  Rates become whole copies by
systematic rounding along the sizes, followed by greedy corrections of the residual.

Defined cases: null or wordless texts have size 0 and are taken 0 words; an empty table gives no
rows; repeated rows are mixed one by one; a null source is a source of its own, ordered last;
a source without words has target 0.  Rows that share an id, or have none, are mixed one by one;
among rows of one source and size the order of ids decides, and among equal ids that of texts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, table

#: Parts that the documents of a class are ranked in, so that a class of any size is spread out.
PARTS = 64


def source_targets(classes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """classes(source, skey, size, n) -> one row a source with its size and target.

    `share` times all words are dealt by weight; a target stops at `most` times its source's size
    and the excess is dealt again.  The fixed point is target = min(most * size, weight * level);
    the level follows from prefix sums over the sources in the order in which they fill up.
    """
    per = classes.groupBy("source", "skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("worded")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.first(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), True).over(whole))
    return per.select("source", "skey", "source_size", "worded", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def tilt(classes: DataFrame, sources: DataFrame, most: float, most_steps: int = 120) -> DataFrame:
    """sources with the multiplier `lam` that solves each source's dual.

    Steps go on until every source has settled.  A bracket guards them and halves where Newton's step
    leaves it, so each settles well before `most_steps`; where one has not, it raises."""
    state = sources.select(
        "*", (F.col("source_size") / F.greatest(F.col("worded"), F.lit(1))).alias("scale"),
        F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"), F.lit(False).alias("settled"),
    ).withColumn("scale", F.greatest(F.col("scale"), F.lit(1.0)))
    keep = state.columns
    groups = classes.filter("size > 0").select("skey", "size", "n")
    for step in range(1, most_steps + 1):
        x, r = F.col("size") / F.col("scale"), F.exp(F.col("lam") * F.col("size") / F.col("scale"))
        words = F.col("size") * F.col("n")
        sums = groups.join(state.filter("not settled").select("skey", "lam", "scale"), "skey").groupBy("skey").agg(
            F.sum(words * F.least(r, F.lit(most))).alias("g"), F.sum(F.when(r < most, words * r * x).otherwise(0.0)).alias("h")
        )
        state = state.join(sums, "skey", "left")
        over = F.col("g") > F.col("target")
        state = state.withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam")))
        newton = F.col("lam") - (F.col("g") - F.col("target")) / F.when(F.col("h") > 0, F.col("h"))
        half = F.when(F.col("hi") >= 700.0, F.greatest(F.col("lo") * 2, F.lit(0.25))).when(F.col("lo") <= -700.0, F.least(F.col("hi") * 2, F.lit(-0.25))).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 8)
        # A target of nothing, or of all that can be taken, needs no multiplier: `mix` sets those rates.
        bound = (F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))
        narrow = F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.lit(1.0), F.abs("lam"))
        done = F.col("settled") | F.col("g").isNull() | bound | narrow | (F.abs(F.col("g") - F.col("target")) <= 1e-9 * F.col("target"))
        state = state.withColumn("settled", done).withColumn("lam", F.when(F.col("settled"), F.col("lam")).when(inside, newton).otherwise(half)).select(*keep)
        if step % 3 == 0:
            state = table(state, "mix-state")
            if not state.filter("not settled").limit(1).count():
                return state
    raise RuntimeError("the dual did not settle")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, source, size, source_size, target, rate, copies, taken, and the columns `keep`."""
    slim = table(docs.select(
        F.col(id_col), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("_text"), *keep,
    ).withColumn("part", F.pmod(F.xxhash64(F.col(id_col)), F.lit(PARTS)).cast("int")), "mix-slim")
    parts = table(slim.groupBy("source", "skey", "size", "part").agg(F.count(F.lit(1)).alias("m")), "mix-parts")
    classes = parts.groupBy("source", "skey", "size").agg(F.sum("m").alias("n"))
    classes = table(classes, "mix-classes")
    sources = table(source_targets(classes, weights, share, most), "mix-sources")
    solved = tilt(classes, sources, float(most))

    at, along = Window.partitionBy("skey"), Window.partitionBy("skey").orderBy("size")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), float(most)).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    c = classes.join(solved.select("skey", "source_size", "target", "lam", "scale"), "skey").withColumn("rate", rate)
    mass = F.sum(F.col("n") * F.col("rate")).over(along)
    c = c.withColumn("upto", F.floor(mass + 0.5))
    c = c.withColumn("k", F.greatest(F.lit(0), F.least(most * F.col("n"), F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)))))
    c = table(c.select("skey", "size", "n", "k", "source_size", "target", "rate"), "mix-copies")
    while True:
        # Each turn moves copies of the largest size that fits into what is missing, so it shrinks.
        for _ in range(3):
            c = c.withColumn("miss", F.floor(F.col("target") + 0.5) - F.sum(F.col("k") * F.col("size")).over(at))
            room = F.when(F.col("miss") > 0, most * F.col("n") - F.col("k")).otherwise(F.col("k"))
            fits = (F.col("size") > 0) & (room > 0) & (F.col("size") <= F.abs("miss"))
            c = c.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(at))
            moved = F.when(F.col("size") == F.col("pick"), F.least(room, F.floor(F.abs("miss") / F.col("size"))) * F.signum(F.col("miss").cast("double"))).otherwise(0)
            c = c.withColumn("k", F.col("k") + moved.cast("long"))
        c = table(c.select("skey", "size", "n", "k", "source_size", "target", "rate", "pick"), "mix-copies")
        if not c.filter("pick is not null").limit(1).count():
            break
    c = c.drop("pick")

    in_class = Window.partitionBy("skey", "size").orderBy("part")
    dealt = parts.join(c, ["skey", "size"]).withColumn("first", F.sum("m").over(in_class) - F.col("m")).select("skey", "size", "part", "first", "n", "k", "source_size", "target", "rate")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "part").orderBy(F.xxhash64(F.lit(7), F.col(id_col)), F.col(id_col), "_text"))
    out = slim.join(dealt, ["skey", "size", "part"]).withColumn("rank", F.col("first") + rank)
    copies = (F.floor(F.col("k") / F.col("n")) + F.when(F.col("rank") <= F.col("k") % F.col("n"), 1).otherwise(0)).cast("long")
    return out.select(F.col(id_col), "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


_KEY = "_foretide_row"


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with each row as often as the mix takes it (rows without words: never); same columns.  Rows
    go by a key of their own, written once."""
    keyed = table(docs.withColumn(_KEY, F.monotonically_increasing_id()), "mix-keyed")
    taken = mix(keyed.select(id_col, text_col, source_col, _KEY), id_col=id_col, text_col=text_col, source_col=source_col, keep=(_KEY,), **how)
    often = taken.filter("copies > 0").select(_KEY, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(_KEY)
    return keyed.join(often, _KEY).select(*docs.columns)
