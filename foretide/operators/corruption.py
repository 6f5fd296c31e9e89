"""Corruption of a dependency X -> Y by swaps of Y between rows: Y's marginal counts stay."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import token
from .fd import violations

#: Rows of a group that one task ranks; rows of a bucket that are paired; rounds of pairing; cells of the cut.
GROUP_ROWS, BUCKET_ROWS, ROUNDS, CELLS = 100_000, 10_000, 4, 4096


def _slotted(rows: DataFrame, groups: DataFrame, seed: int) -> DataFrame:
    """At most receive_slots rows of each X, the first by a seeded hash.  A large X is ranked in
    salted parts whose sizes are added up, never in one task."""
    r = rows.join(groups.filter("receive_slots > 0").select("lhs", "dominant", "support", "receive_slots"), "lhs")
    r = r.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("salt", F.pmod("h", F.ceil(F.col("support") / GROUP_ROWS)))
    before = F.sum("n").over(Window.partitionBy("lhs").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    parts = r.groupBy("lhs", "salt").agg(F.count(F.lit(1)).alias("n")).select("lhs", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("lhs", "salt").orderBy("h", "id"))
    return r.withColumn("rank", rank).join(parts, ["lhs", "salt"]).filter("rank + before <= receive_slots").select("id", "rhs", "value", "dominant")


def swap_plan(df: DataFrame, row_id: str, x: str, y: str, seed: int) -> DataFrame:
    """(id, mate): rows that can swap Y.  Mates differ in Y, neither receives its X's dominant Y, and
    no X takes part with more rows than leave its dominant Y at least half of it.

    Rows are dealt into buckets by a seeded hash, sorted there by Y and paired half a bucket apart;
    rows without a mate are dealt anew in each round.  What the rounds find is the most that can be
    changed."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = both.select(F.col(row_id).alias("id"), token(df, x).alias("lhs"), token(df, y).alias("rhs"), F.col(y).alias("value"))
    groups = violations(df, x, y)
    buckets = max(1, math.ceil((groups.agg(F.sum("receive_slots")).first()[0] or 0) / BUCKET_ROWS))
    side = df.select(F.struct(F.col(row_id).alias("id"), F.col(y).alias("value")).alias("mate")).schema["mate"].dataType
    found = _slotted(rows, groups, seed).withColumn("mate", F.lit(None).cast(side))
    for turn in range(ROUNDS):
        bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "id"), F.lit(buckets))
        dealt = found.withColumn("b", F.when(F.col("mate").isNull(), bucket).otherwise(-1 - bucket))
        half = F.floor(F.count(F.lit(1)).over(Window.partitionBy("b")) / 2)
        at = F.row_number().over(Window.partitionBy("b").orderBy("rhs", F.xxhash64(F.lit(seed), F.lit(turn), "id"), "id")) - 1
        dealt = dealt.withColumn("half", half).withColumn("at", at).withColumn("cell", F.when(F.col("at") < F.col("half"), F.col("at")).otherwise(F.col("at") - F.col("half")))
        pair = Window.partitionBy("b", "cell").orderBy("at")
        me = F.struct("id", "value", "rhs", "dominant", "at")
        other = F.when(F.col("at") < F.col("half"), F.lead(me).over(pair)).when(F.col("at") < 2 * F.col("half"), F.lag(me).over(pair))
        fits = "b >= 0 and o is not null and o.rhs <> rhs and o.rhs <> dominant and rhs <> o.dominant"
        dealt = dealt.withColumn("o", other).withColumn("mate", F.when(F.expr(fits), F.struct("o.id", "o.value")).otherwise(F.col("mate")))
        found = dealt.select("id", "rhs", "value", "dominant", "mate")
    return found.filter("mate is not null").select("id", "mate")


def corrupt(df: DataFrame, row_id: str, x: str, y: str, rate: float, seed: int) -> DataFrame:
    """df with Y swapped in `rate` of the rows that can change (rounded, in whole pairs).

    Only Y changes; the same seed gives the same rows, and a higher rate changes those of a lower one
    and more.  A repeated row_id raises.  Nulls in X or Y stay; an empty table, or one without feasible
    swaps, comes back as it is.  A rate outside 0 to 1 raises."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate_outside_0_to_1")
    for c in (row_id, x, y):
        if c not in df.columns:
            raise ValueError(f"missing_column:{c}")
    if df.groupBy(row_id).count().filter("count > 1").limit(1).count():
        raise ValueError("repeated_row_id")
    plan = swap_plan(df, row_id, x, y, seed)
    key = F.xxhash64(F.lit(seed), F.least("id", "mate.id"), F.greatest("id", "mate.id"))
    plan = plan.withColumn("key", key).withColumn("cell", F.pmod("key", F.lit(CELLS)))
    counts = sorted((r["cell"], r["n"]) for r in plan.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # at most CELLS rows
    wanted = round(rate * sum(n for _, n in counts))
    wanted -= wanted % 2
    taken, cut = 0, CELLS
    for cell, n in counts:
        if taken + n > wanted:
            cut = cell
            break
        taken += n
    first = Window.partitionBy("cell").orderBy("key", F.least("id", "mate.id"), "id")  # a CELLS-th of the plan
    edge = plan.filter(F.col("cell") == cut).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= wanted - taken).drop("r")
    new = plan.filter(F.col("cell") < cut).union(edge).select(F.col("id").alias("_swap_id"), F.col("mate.value").alias("_swap_value"))
    out = df.join(new, F.col(row_id) == F.col("_swap_id"), "left")
    return out.select(*(F.coalesce("_swap_value", y).alias(y) if c == y else F.col(c) for c in df.columns))


def corruption_summary(before: DataFrame, after: DataFrame, row_id: str, x: str, y: str) -> DataFrame:
    """One row: source rows, eligible rows, changed rows and their share, violations before and after,
    and whether Y's counts are preserved."""
    two = before.select(F.col(row_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("was")).join(after.select(F.col(row_id).alias("id"), F.col(y).alias("now")), "id")
    eligible = F.col("x").isNotNull() & F.col("was").isNotNull()
    changed = ~F.col("was").eqNullSafe(F.col("now"))
    s = two.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(eligible).alias("eligible_rows"), F.count_if(changed).alias("changed_rows"))
    for name, df in (("violations_before", before), ("violations_after", after)):
        s = s.crossJoin(F.broadcast(violations(df, x, y).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias(name))))  # one row each
    counts = two.select(F.col("was").alias("v"), F.lit(1).alias("d")).union(two.select("now", F.lit(-1))).groupBy("v").agg(F.sum("d").alias("d"))
    s = s.crossJoin(F.broadcast(counts.agg(F.coalesce(F.bool_and(F.col("d") == 0), F.lit(True)).alias("marginals_preserved"))))
    return s.withColumn("changed_share", F.col("changed_rows") / F.greatest(F.lit(1), "eligible_rows"))
