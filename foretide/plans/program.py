"""Declarative feature programs: a pairwise task compiled to columns of one matrix."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import strict_prior
from ..operators.shaping import align


@dataclass(frozen=True)
class HistorySpec:
    role: str
    key: str
    source_key: str
    time: str
    related: str | None = None
    windows: tuple[int, ...] = (30, 90, 365)
    neighbour_windows: tuple[int, ...] = (30, 90)


@dataclass(frozen=True)
class PairSpec:
    keys: tuple[str, str]
    source_keys: tuple[str, str]
    time: str


@dataclass(frozen=True)
class Task:
    row_id: str
    time: str
    label: str | None = None
    passthrough: tuple[str, ...] = ()
    histories: tuple[HistorySpec, ...] = ()
    pair: PairSpec | None = None


def audit(task: Task, matrix: DataFrame) -> None:
    if task.label and task.label in matrix.columns:
        raise ValueError("label_leakage")
    if len(set(matrix.columns)) != len(matrix.columns):
        raise ValueError("repeated_columns")


def compile_task(task: Task, targets: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """identity, passed-through and generated columns; every generated one sees strictly prior events.
    Null keys or times of targets raise, as do those of sources."""
    keys = {h.key for h in task.histories} | set(task.pair.keys if task.pair else ())
    for df, cols, code in [(targets, [*keys, task.time], "null_target_key_or_time"), *((sources[h.role], [h.source_key, h.time], "null_group_key_or_time") for h in task.histories), *([(sources["pair"], [*task.pair.source_keys, task.pair.time], "null_pair_key_or_time")] if task.pair else [])]:
        bad = None
        for c in cols:
            bad = F.col(c).isNull() if bad is None else bad | F.col(c).isNull()
        if df.filter(bad).take(1):
            raise ValueError(code)
    out = targets.select(task.row_id, *task.passthrough)
    for h in task.histories:
        got = strict_prior(targets, sources[h.role], task.row_id, [h.key], task.time, h.time, {f"{w}d": w for w in h.windows}, h.related, [h.source_key])
        p = f"f_pairwise__{h.role}__"  # fixed value: the output columns' names
        cols = [F.col(f"count_{w}d").alias(f"{p}count_{w}d") for w in h.windows]
        if h.related:
            cols += [F.col(f"unique_{w}d").alias(f"{p}unique_neighbors_{w}d") for w in h.neighbour_windows]
        out = align(out, got.select(task.row_id, *cols, F.col("days_since_last").alias(f"{p}days_since_last"), F.col("days_since_last_missing").alias(f"{p}days_since_last__is_missing")), task.row_id)
    if task.pair:
        got = strict_prior(targets, sources["pair"], task.row_id, list(task.pair.keys), task.time, task.pair.time, {}, None, list(task.pair.source_keys))
        p = "f_pairwise__pair__"
        out = align(out, got.select(task.row_id, F.col("prior_count").alias(f"{p}prior_count"), F.col("days_since_last").alias(f"{p}days_since_last"), F.col("days_since_last_missing").alias(f"{p}days_since_last__is_missing")), task.row_id)
    audit(task, out)
    return out
