"""Screening of edges and pairs, selection strategies over score tables, and stability gates.

Screens and gates are aggregates over fold or seed scores.  Strategies walk over sets of edges with a
scorer that the caller gives; what they look at is bounded by the pool of edges.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP = -1e-12
RULES = ("fixed_count", "positive_fraction", "pooled_oof")


def folds_needed(folds: int, rule: str = "fixed_count", least: int | None = None, fraction: str = "0.6666666666666666") -> int:
    """Folds that must gain: half of them, `least`, or a fraction; always rounded up."""
    if rule not in RULES:
        raise ValueError(f"unknown_screening_rule: {rule}")
    if rule == "fixed_count":
        n = math.ceil(folds / 2) if least is None else int(least)
        if n > folds:
            raise ValueError("min_positive_folds_exceeds_folds")
    else:
        n = max(1, int((Decimal(max(1, folds)) * Decimal(fraction)).to_integral_value(rounding=ROUND_CEILING)))
    if n < 1:
        raise ValueError("min_positive_folds_must_be_at_least_1")
    return n


def finite(c: Column) -> Column:
    """The number, or null for null, NaN and infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def relative_degradation(gain: Column, score: Column) -> Column:
    return F.greatest(F.lit(0.0), -finite(gain)) / F.greatest(F.abs(finite(score)), F.lit(1e-12))


def screen(scores: DataFrame, edge: str, gain: str, needed: int, delta: float = 0.0, rule: str = "fixed_count", baseline: str | None = None, pooled: str | None = None, usable: str | None = None, most_degradation: float | None = None, pairs: bool = False) -> DataFrame:
    """One row an edge (or, with `pairs`, a pair: its mean must gain at all, and its folds by more than
    delta): mean, worst and positive folds, worst relative degradation, status and reason."""
    g = finite(F.col(gain))
    per = scores.groupBy(edge).agg(
        F.avg(g).alias("mean_gain"), F.min(g).alias("worst_gain"), F.stddev_pop(g).alias("gain_std"), F.count(g).alias("folds"), F.count_if(g > 0).alias("positive_folds"), F.count_if(g > delta).alias("passing_folds"),
        (F.first(finite(F.col(pooled)), True) if pooled else F.avg(g)).alias("aggregate_gain"), (F.max(F.coalesce(F.col(usable), F.lit(0))) if usable else F.lit(1)).alias("_usable"),
        F.coalesce(F.max(relative_degradation(F.col(gain), F.col(baseline))) if baseline else F.lit(0.0), F.lit(0.0)).alias("worst_degradation"),
    )
    mean = F.coalesce(F.col("aggregate_gain" if rule == "pooled_oof" else "mean_gain") > (0.0 if pairs and rule != "pooled_oof" else delta), F.lit(False))
    enough = F.lit(True) if rule == "pooled_oof" else F.col("passing_folds" if pairs else "positive_folds") >= needed
    gentle = F.lit(True) if most_degradation is None else F.col("worst_degradation") <= most_degradation
    reason = F.when(F.col("_usable") <= 0, "no_usable_features").when(~mean, "non_positive_aggregate_gain" if rule == "pooled_oof" else "non_positive_mean_gain").when(~gentle, "excessive_worst_fold_relative_degradation").when(~enough, "insufficient_delta_passing_folds" if pairs else "insufficient_positive_folds")
    return per.withColumn("reason", reason).withColumn("status", F.when(F.col("_usable") <= 0, "no_usable_features").when(reason.isNull(), "screened_in").otherwise("screened_out")).drop("_usable")


def pair_pool(edges: Sequence[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(sorted(edges), 2))


Gains = Callable[[tuple[str, ...]], Sequence[float]]


def passes(gains: Sequence[float], needed: int, delta: float) -> bool:
    good = [g for g in gains if math.isfinite(g)]
    return bool(good) and sum(good) / len(good) > delta and sum(g > 0 for g in good) >= needed


def _mean(gains: Sequence[float]) -> float:
    good = [g for g in gains if math.isfinite(g)]
    return sum(good) / len(good) if good else -math.inf


def choose_edges(edges: Sequence[str], gains: Gains, needed: int, strategy: str = "greedy", delta: float = 0.0, most: int | None = None) -> list[str]:
    """Edges by `independent`, `greedy` or `greedy_backward` selection.

    gains(set): fold gains of the set over no edges.  Greedy adds the best edge whose step passes, over
    the set so far; if no single edge passes it may begin with the best passing pair.  Backward then
    removes edges whose absence costs nothing (mean gain of removing at least KEEP)."""
    if strategy not in ("independent", "greedy", "greedy_backward"):
        raise ValueError(f"unknown_strategy: {strategy}")
    known: dict[tuple[str, ...], Sequence[float]] = {(): [0.0]}

    def at(chosen) -> Sequence[float]:
        key = tuple(sorted(chosen))
        if key not in known:
            known[key] = gains(key)
        return known[key]

    def step(new, old) -> list[float]:
        a, b = at(new), at(old)
        return [x - y for x, y in zip(a, b if len(b) == len(a) else [0.0] * len(a))]

    alone = [e for e in sorted(edges) if passes(at([e]), needed, delta)]
    if strategy == "independent":
        return sorted(alone, key=lambda e: (-_mean(at([e])), e))[:most]
    chosen: list[str] = []
    while most is None or len(chosen) < most:
        trials = [[*chosen, e] for e in sorted(edges) if e not in chosen]
        good = [t for t in trials if passes(step(t, chosen), needed, delta)]
        if not good and not chosen and (most is None or most > 1):
            good = [list(p) for p in pair_pool(edges) if passes(at(p), needed, delta)]
        if not good:
            break
        chosen = max(good, key=lambda t: (_mean(step(t, chosen)), [-ord(c) for c in t[-1]]))
    while strategy == "greedy_backward" and len(chosen) > 1:
        less = [[x for x in chosen if x != e] for e in chosen]
        best = max(less, key=lambda t: (_mean(step(t, chosen)), t))
        if _mean(step(best, chosen)) < KEEP:
            break
        chosen = best
    return chosen


def rank_candidates(found: DataFrame, higher: bool, score: str = "score", added: str = "added_features", complexity: str = "complexity", ident: str = "program_id") -> DataFrame:
    """rank: by score, then fewer added features (unknown ones last), lower complexity, id.  A pool's rows."""
    order = [F.desc_nulls_last(score) if higher else F.asc_nulls_last(score), F.asc_nulls_last(added), complexity, ident]
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def smallest_budget(scores: DataFrame, budget: str, score: str, tolerance: float, higher: bool) -> DataFrame:
    """The smallest budget whose mean score is within tolerance of the best one."""
    per = scores.groupBy(budget).agg(F.avg(finite(F.col(score))).alias("score"))
    best = per.agg((F.max("score") if higher else F.min("score")).alias("best"))
    near = per.crossJoin(F.broadcast(best)).filter((F.col("best") - F.col("score") if higher else F.col("score") - F.col("best")) <= tolerance)  # one row
    return near.agg(F.min(budget).alias(budget), F.first("best").alias("best"))


def choose_strategy(scores: DataFrame, strategy: str, score: str, edges: str, tolerance: float, higher: bool) -> DataFrame:
    """Of strategies within tolerance of the best: the fewest edges, then the better score, then the name."""
    best = scores.agg((F.max(finite(F.col(score))) if higher else F.min(finite(F.col(score)))).alias("best"))
    near = scores.crossJoin(F.broadcast(best)).filter((F.col("best") - F.col(score) if higher else F.col(score) - F.col("best")) <= tolerance)  # one row
    return near.orderBy(edges, F.desc(score) if higher else F.asc(score), strategy).limit(1).drop("best")


SAFETY = ("leakage_safe", "temporally_safe", "provenance_safe")


def select_candidate(found: DataFrame, task: str, metric: str, direction: str, baseline: float) -> DataFrame:
    """Candidates with `rejection` and `selected`: others' tasks or metrics, test splits, scores that are
    not numbers, ineligible ones and any safety flag that is false or unknown are rejected; the best of
    the rest is selected if it beats the baseline."""
    higher = direction == "higher"
    safe = F.lit(True)
    for flag in SAFETY:
        safe = safe & F.coalesce(F.col(flag), F.lit(False))
    reason = (
        F.when(~F.col("task").eqNullSafe(F.lit(task)), "task_mismatch").when(~F.col("metric").eqNullSafe(F.lit(metric)), "metric_mismatch").when(~F.col("direction").eqNullSafe(F.lit(direction)), "direction_mismatch")
        .when(F.lower("split").eqNullSafe(F.lit("test")), "test_split").when(finite(F.col("score")).isNull(), "non_finite_score").when(~F.coalesce(F.col("eligible"), F.lit(False)), "ineligible").when(~safe, "unsafe_or_unknown")
    )
    out = found.withColumn("rejection", reason)
    beats = (F.col("score") > baseline) if higher else (F.col("score") < baseline)
    ranked = rank_candidates(out.filter("rejection is null"), higher).select("program_id", "rank")
    return out.join(F.broadcast(ranked), "program_id", "left").withColumn("selected", F.coalesce((F.col("rank") == 1) & beats, F.lit(False)))  # a pool of programs


def paired(scores: DataFrame, candidate: DataFrame, keys: list[str], score: str, higher: bool) -> DataFrame:
    """Scores of both by seed, and what the candidate gains."""
    j = scores.select(*keys, F.col(score).alias("base")).join(candidate.select(*keys, F.col(score).alias("score")), keys)
    return j.withColumn("gain", F.col("score") - F.col("base") if higher else F.col("base") - F.col("score"))


def stability(gains: DataFrame, by: list[str], metric: str, least_seeds: int = 4, least_wins: int = 3, strict: bool = False) -> DataFrame:
    """One row a program: seeds, wins, mean gain, verdict and reason.  Accuracy must gain over 0.001; the
    strict form, for exports, wants every seed to win."""
    g = finite(F.col("gain"))
    s = gains.groupBy(*by).agg(F.count(g).alias("seeds"), F.count_if(g > 0).alias("wins"), F.avg(g).alias("mean_gain"), F.min(g).alias("worst_gain"))
    least = 0.001 if metric == "accuracy" else 0.0
    wins = F.col("wins") < F.col("seeds") if strict else F.col("wins") < least_wins
    reason = F.when(F.col("seeds") < least_seeds, "too_few_seeds").when(wins, "too_few_wins").when(~(F.col("mean_gain") > least), "mean_gain_below_threshold")
    return s.withColumn("reason", reason).withColumn("stable", reason.isNull())
