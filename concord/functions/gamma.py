"""Resolution values: grids, discovery batches, budgets. Lists of a few dozen numbers, on the driver."""

from __future__ import annotations

import math
from bisect import bisect_left

PRIMARY_BUDGET, SECONDARY_BUDGET, LOG_GAP = 8, 4, 0.08


def is_log(objective: str) -> bool:
    return objective == "CPM"


def _even(left: float, right: float, n: int, log: bool) -> list[float]:
    if n == 1:
        return [left]
    if log:
        a, b = math.log(left), math.log(right)
        return [math.exp(a + (b - a) * i / (n - 1)) for i in range(n)]
    return [left + (right - left) * i / (n - 1) for i in range(n)]


def grid(left: float, right: float, objective: str, tolerance: float, steps: int = 11) -> list[float]:
    """Evenly spaced values over a range, on a log scale for CPM; a range narrower than the tolerance is widened."""
    left, right = sorted((left, right))
    log = is_log(objective)
    if log:
        left, right = max(left, 5e-324), max(right, 5e-324)
        narrow = math.log(right) - math.log(left) <= tolerance
        if narrow:
            by = max(tolerance, 1e-4)
            left, right = math.exp(math.log(left) - by), math.exp(math.log(right) + by)
    else:
        narrow = right - left <= tolerance
        if narrow:
            left, right = left - tolerance, right + tolerance
    return _even(left, right, steps, log)


def discovery_plan(parallelism: int, target: float, covered: float | None) -> tuple[int, float]:
    """Probes in the next discovery batch, and the ratio of neighbouring values: smaller steps near the target."""
    most = min(max(1, parallelism), 6)
    share = covered / target if covered is not None and math.isfinite(covered) and target > 0 else -1.0
    for least, size, ratio in ((0.9, 2, 1.5), (0.75, 2, 2.0), (0.5, 3, 2.0)):
        if share >= least:
            return min(most, size), ratio
    return most, 4.0


def discovery_batch(start: float, cap: float, size: int, ratio: float = 4.0) -> list[float]:
    values = [min(start * ratio**k, cap) for k in range(size)]
    return sorted(set(values))


def thinned(values: list[float], protected: list[float], objective: str, gap: float = LOG_GAP) -> list[float]:
    """Values, in order, that are at least ``gap`` apart on the log scale from each other and the protected; CPM only."""
    values = sorted({v for v in values if v is not None and math.isfinite(v)})
    if not is_log(objective):
        return values
    kept = [math.log(p) for p in protected if p > 0]
    out = []
    for v in values:
        if v > 0 and all(abs(math.log(v) - k) >= gap for k in kept):
            out.append(v)
            kept.append(math.log(v))
    return out


def evenly_selected(values: list[float], n: int) -> list[float]:
    """At most n values at evenly spaced places; places are rounded half to even."""
    values = sorted(set(values))
    if n <= 0:
        return []
    if len(values) <= n:
        return values
    places = [0] if n == 1 else [round(i * (len(values) - 1) / (n - 1)) for i in range(n)]
    return [values[k] for k in sorted(set(places))]


def interior(left: float, right: float, n: int, objective: str) -> list[float]:
    return _even(left, right, n + 2, is_log(objective))[1:-1] if left < right and n > 0 else []


def filled(values: list[float], budget: int, left: float, right: float, objective: str) -> list[float]:
    """Values and inner points of the range, up to the budget."""
    values = sorted(set(values))
    for n in range(1, 4 * budget + 1):
        if len(values) >= budget:
            break
        for v in thinned(interior(left, right, n, objective), values, objective):
            if len(values) < budget and v not in values:
                values.insert(bisect_left(values, v), v)
    return values


def secondary(values: list[float], left: float, right: float, objective: str, n: int) -> list[float]:
    """n values, each in the middle of the widest gap so far."""
    log = is_log(objective)
    scale, back = (math.log, math.exp) if log else (float, float)
    places = sorted({scale(v) for v in [*values, left, right] if not log or v > 0})
    out = []
    for _ in range(n):
        gaps = [(b - a, -k) for k, (a, b) in enumerate(zip(places, places[1:], strict=False))]
        if not gaps or max(gaps)[0] <= 0:
            break
        k = -max(gaps)[1]
        middle = (places[k] + places[k + 1]) / 2
        places.insert(k + 1, middle)
        out.append(back(middle))
    return out


def batches(left: float, right: float, seeds: list[tuple[float, str]], objective: str, primary: int = PRIMARY_BUDGET, more: int = SECONDARY_BUDGET) -> tuple[list[float], list[float]]:
    """Values tried first, within the budget: ends and the selected seed, exact seeds, near seeds, others, fillers; and values tried if those fail."""
    chosen = sorted({left, right, *(g for g, role in seeds if role == "selected")})[:primary]
    for role in ("exact", "near", "seed"):
        own = thinned([g for g, r in seeds if r == role and left <= g <= right], chosen, objective)
        chosen = sorted({*chosen, *evenly_selected(own, primary - len(chosen))})
    chosen = filled(chosen, primary, left, right, objective)
    return chosen, [v for v in secondary(chosen, left, right, objective, more) if v not in chosen]
