"""Gates and greedy selection over small score tables (driver side, one row a candidate)."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence


def windows_for(horizon: int) -> tuple[int, int, int]:
    """Look-back windows of a horizon in days: a third, itself, four times (a year if near one)."""
    long = 4 * horizon
    return max(1, round(horizon / 3)), horizon, 365 if 350 <= long <= 380 else long


def improvement(baseline: float, candidate: float, higher_is_better: bool) -> float:
    return candidate - baseline if higher_is_better else baseline - candidate


def consistent_gate(baseline: Sequence[float], candidate: Sequence[float], higher_is_better: bool, delta: float = 0.0) -> bool:
    """Every seed must improve by more than delta."""
    if len(baseline) != len(candidate) or not baseline:
        raise ValueError("seed scores must pair up")
    if any(math.isnan(x) for x in (*baseline, *candidate)):
        raise ValueError("a score is not a number")
    return all(improvement(b, c, higher_is_better) > delta for b, c in zip(baseline, candidate))


def forward_backward(candidates: Sequence[str], score: Callable[[tuple[str, ...]], float], budget: int, delta: float = 0.0) -> tuple[list[str], list[dict]]:
    """Forward selection by the best gain, then backward cleanup; scores are maximised."""
    chosen: list[str] = []
    best, trace = score(()), []
    while len(chosen) < budget:
        gains = sorted(((score((*chosen, c)), c) for c in candidates if c not in chosen), key=lambda x: (-x[0], x[1]))
        if not gains or gains[0][0] - best <= delta:
            break
        best = gains[0][0]
        chosen.append(gains[0][1])
        trace.append({"step": "add", "feature": gains[0][1], "score": best})
    for c in list(chosen):
        rest = tuple(x for x in chosen if x != c)
        if (s := score(rest)) >= best - 1e-12:
            chosen, best = list(rest), s
            trace.append({"step": "remove", "feature": c, "score": s})
    return chosen, trace


def joint_variant(scores: dict[str, float], delta: float = 0.0) -> str:
    """declared -> auto -> auto+fd, each only if strictly better by more than delta."""
    at = "declared"
    for nxt in ("auto", "auto+fd"):
        if nxt in scores and scores[nxt] - scores[at] > delta:
            at = nxt
    return at


def budgets(columns: int) -> dict[str, int]:
    """Feature and edge budgets by the number of columns."""
    features = 8 if columns <= 32 else 12 if columns <= 128 else 16
    edges = 8 if columns <= 16 else 16 if columns <= 64 else 32 if columns <= 256 else 64
    return {"features": features, "candidate_edges": edges, "selected_edges": min(edges, 32)}
