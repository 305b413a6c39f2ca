"""Scalar rules as column functions: guards, search states, intervals, seeds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Admission families, in order of preference.
ADMISSION_ORDER = (
    "raw_strict_soft", "strict_soft", "relaxed_soft", "strict_hard", "relaxed_hard", "relaxed_unguarded",
    "raw_relaxed_soft", "raw_relaxed_hard", "raw_relaxed_unguarded",
)
#: Priority of seed roles.
SEED_PRIORITY = {"selected": 1, "left": 2, "right": 2, "exact": 3, "near": 4, "seed": 5}
UNKNOWN_PRIORITY = 99


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def soft_limit(k: Column) -> Column:
    k = F.greatest(k, F.lit(1))
    return F.greatest(k + 3, F.ceil(k.cast("double") * F.lit(1.1)))


def hard_limit(k: Column) -> Column:
    k = F.greatest(k, F.lit(1))
    return F.greatest(k + 5, F.ceil(k.cast("double") * F.lit(1.5)))


def search_upper(k: Column) -> Column:
    return F.when(k <= 10, k + 1).otherwise(F.greatest(k + 2, F.ceil(k.cast("double") * F.lit(1.05))))


def passes_guard(raw: Column, k: Column, min_cluster_size: int, hard: bool = False) -> Column:
    limit = hard_limit(k) if hard else soft_limit(k)
    free = F.lit(min_cluster_size <= 1) | k.isNull() | (k <= 1)
    return F.coalesce(free, F.lit(False)) | F.coalesce(finite(raw.cast("double")) & (raw <= limit), F.lit(False))


def search_state(raw: Column, effective: Column, k: Column, min_cluster_size: int) -> Column:
    """Where a probe lies for a target of k clusters, and which way to move each end of the interval."""
    below = F.coalesce(raw < k, F.lit(False))
    fits = F.lit(min_cluster_size <= 1) | F.coalesce(k <= 1, F.lit(True)) | F.coalesce(raw <= search_upper(k), F.lit(False))
    above = ~below & ~fits
    met = F.coalesce(effective >= k, F.lit(False))
    up, down = F.lit("increase_gamma"), F.lit("decrease_gamma")
    return F.struct(
        F.when(below, "raw_below").when(above, "raw_above_soft").otherwise("raw_in_band").alias("raw_class"),
        (~below & ~met).alias("over_fragmented"),
        F.when(below, up).otherwise(down).alias("lower_action"),
        F.when(below | (~above & met), up).otherwise(down).alias("upper_action"),
    )


def degenerate(raw: Column, effective: Column, final: Column, n_vertices: int) -> Column:
    """Whether a probe at high resolution has fallen apart into single cells that merged into one cluster."""
    known = finite(raw.cast("double")) & finite(effective.cast("double")) & finite(final.cast("double"))
    return F.coalesce(known & (effective == 0) & (final == 1) & (raw >= F.lit(0.98 * n_vertices)), F.lit(False))


def interval_width(left: Column, right: Column, log_scale: bool) -> Column:
    ok = finite(left) & finite(right) & (left < right)
    return F.when(ok, F.log(right) - F.log(left) if log_scale else right - left)


def interval_small(left: Column, right: Column, log_scale: bool, tolerance: float) -> Column:
    return F.coalesce(interval_width(left, right, log_scale) <= F.lit(max(tolerance, 2.220446049250313e-14)), F.lit(True))


def interval_points(left: Column, right: Column, n: Column, log_scale: bool) -> Column:
    """n inner points of an interval, evenly spaced; empty for an invalid interval."""
    ok = finite(left) & finite(right) & (left < right) & (n > 0)

    def at(i: Column) -> Column:
        share = i / (n + 1)
        return F.exp(F.log(left) + share * (F.log(right) - F.log(left))) if log_scale else left + share * (right - left)

    return F.when(ok, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast("array<double>"))


def seed_priority(role: Column) -> Column:
    found = F.lit(UNKNOWN_PRIORITY)
    for name, priority in reversed(SEED_PRIORITY.items()):
        found = F.when(role == name, priority).otherwise(found)
    return F.coalesce(found, F.lit(UNKNOWN_PRIORITY))


def manual_seed(seed: int | None, gamma: float, offset: int = 0) -> int | None:
    """The seed of a manually given resolution."""
    if seed is None:
        return None
    out = (seed + math.floor(abs(gamma * 1e5) % 1e8) + offset) % 2147483647
    return out if out > 0 else 1


def derived_seed(seed: int, stage: str, **at: float) -> int:
    """Seeds of the stages; each depends on what is computed, not on how the work is laid out."""
    rules = {
        "filter": lambda: seed + 100 * at["k"] + math.floor(at["gamma"] * 1000 % 1e4),
        "target": lambda: seed + 1000 * at["k"],
        "gamma": lambda: seed + math.floor(at["gamma"] * 1e4 % 1e5),
        "refine": lambda: seed + 100 * at["round"] + at["i"],
        "bootstrap": lambda: seed + 10000 + at["i"],
        "trial": lambda: seed + at["trial"],
        "probe": lambda: seed + math.floor(at["gamma"] * 1e6 % 1e8),
    }
    return int(rules[stage]()) % 2147483647 or 1
