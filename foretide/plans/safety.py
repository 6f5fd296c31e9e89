"""Audits of feature plans: leakage, time, provenance.  A plan is a handful of rows, judged on the driver."""
from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

GENERATE, PASSTHROUGH, EXTERNAL = "generate", "passthrough", "external"


@dataclass(frozen=True)
class Step:
    output: str
    kind: str
    source: str | None = None
    source_time: str | None = None
    target_time: str | None = None
    predicate: str | None = None
    materializable: bool = True
    evidence: str | None = None


@dataclass(frozen=True)
class Verdict:
    """safe is None where nothing proves either."""

    safe: bool | None
    reasons: tuple[str, ...] = ()


def leakage(features: Iterable[str], label: str | None, surrogates: Iterable[str] = (), candidate_ids: Iterable[str] = (), target_aggregates: Mapping[str, bool] | None = None) -> Verdict:
    """No feature is the label, a surrogate key or a candidate's id, or aggregates the target unless it was
    fitted across folds (target_aggregates: feature -> fitted so)."""
    names, out = list(features), []
    repeated = sorted({n for n in names if names.count(n) > 1})
    out += [f"repeated_feature:{n}" for n in repeated]
    for n in dict.fromkeys(names):
        if n == label:
            out.append(f"label:{n}")
        if n in set(surrogates):
            out.append(f"surrogate_key:{n}")
        if n in set(candidate_ids):
            out.append(f"candidate_id:{n}")
        if (target_aggregates or {}).get(n) is False:
            out.append(f"target_aggregate_not_cross_fitted:{n}")
    return Verdict(not out, tuple(out))


def temporal(steps: Sequence[Step]) -> Verdict:
    """Every generated step with a time compares source < target strictly, in a predicate that names both."""
    out = []
    for s in steps:
        if s.kind != GENERATE or not (s.source_time or s.target_time):
            continue
        if not (s.source_time and s.target_time and s.predicate):
            out.append(f"missing_temporal_predicate:{s.output}")
        elif not all(re.search(rf"(?<!\w){re.escape(c)}(?!\w)", s.predicate) for c in (s.source_time, s.target_time)):
            out.append(f"predicate_without_both_times:{s.output}")
        elif re.search(r"<=|>=|=", s.predicate) or "<" not in s.predicate and ">" not in s.predicate:
            out.append(f"predicate_not_strict:{s.output}")
        else:
            a, op, b = re.match(r"\s*(\S+)\s*([<>])\s*(\S+)", s.predicate).groups()
            first, second = (a, b) if op == "<" else (b, a)
            if not (first.endswith(s.source_time) and second.endswith(s.target_time)):
                out.append(f"predicate_looks_ahead:{s.output}")
    return Verdict(not out, tuple(out))


def provenance(steps: Sequence[Step]) -> Verdict:
    """Generated columns are proven if they can be made; passed-through and external ones need evidence."""
    out = []
    for s in steps:
        if s.kind == GENERATE and not s.materializable:
            out.append(f"not_materializable:{s.output}")
        elif s.kind in (PASSTHROUGH, EXTERNAL) and s.evidence != "proven":
            out.append(f"{s.kind}_without_evidence:{s.output}")
        elif s.kind not in (GENERATE, PASSTHROUGH, EXTERNAL):
            out.append(f"unknown_kind:{s.output}")
    return Verdict(not out, tuple(out))


def merged(verdicts: Iterable[Verdict]) -> Verdict:
    """Evidence that disagrees is never merged into a yes."""
    found = list(verdicts)
    reasons = tuple(dict.fromkeys(r for v in found for r in v.reasons))
    states = {v.safe for v in found}
    return Verdict(True if states == {True} else False if False in states else None, reasons)


def bindings(pairs: Sequence[tuple[str, str]], available: Iterable[str], wanted: Sequence[str]) -> list[tuple[str, str]]:
    """The passed-through (source, output) pairs in the order of `wanted`; repeated, unknown and missing
    ones raise."""
    outputs = [b for _, b in pairs]
    if len(set(outputs)) < len(outputs) or len({a for a, _ in pairs}) < len(pairs):
        raise ValueError("repeated_binding")
    if unknown := [a for a, _ in pairs if a not in set(available)]:
        raise ValueError(f"unknown_source: {unknown[0]}")
    of = {b: a for a, b in pairs}
    if missing := [w for w in wanted if w not in of]:
        raise ValueError(f"missing_binding: {missing[0]}")
    return [(of[w], w) for w in wanted]
