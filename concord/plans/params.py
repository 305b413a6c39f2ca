"""Checked parameters of an evaluation, and recommended ones."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

logger = logging.getLogger("concord")

#: Fixed values: (cells below, targets, parallelism, trials, bootstraps, objective).
SIZE_CLASSES = (
    (1_000, (2, 8), 2, 10, 50, "modularity"),
    (10_000, (2, 12), 4, 12, 75, "CPM"),
    (50_000, (3, 20), 6, 10, 50, "CPM"),
    (math.inf, (5, 25), 8, 8, 30, "CPM"),
)
#: Advice for each size class.
RUNTIMES = ("2-5 minutes", "5-15 minutes", "15-45 minutes", "30-120 minutes")
MULTIPLIERS = {"quick": 0.5, "standard": 1.0, "thorough": 1.5}


def _whole(name: str, value, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    if abs(value - round(value)) > 1.5e-8:
        raise ValueError(f"{name} must be an integer")
    if value < least:
        raise ValueError(f"{name} must be >= {least}")
    return int(round(value))


@dataclass(frozen=True)
class Params:
    cluster_range: tuple[int, ...] = tuple(range(1, 21))
    resolution: tuple[float, ...] | None = None
    n_trials: int = 15
    n_bootstrap: int = 100
    seed: int = 1
    beta: float = 0.1
    n_iterations: int = 10
    max_iterations: int = 150
    ic_threshold: float = math.inf
    objective: str = "CPM"
    remove_threshold: float = 1.15
    min_cluster_size: int = 2
    resolution_tolerance: float = 1e-8
    probe_parallelism: int = 4
    heartbeat_seconds: float = 60.0


def checked(**given) -> Params:
    """Params; raises ValueError with what is wrong."""
    if (ks := given.get("cluster_range")) is not None:
        given["cluster_range"] = tuple(sorted({_whole("cluster_range", k) for k in ks}))
        if not given["cluster_range"]:
            raise ValueError("cluster_range must not be empty")
    if (gs := given.get("resolution")) is not None:
        gs = [gs] if isinstance(gs, (int, float)) else list(gs)
        if not gs or any(isinstance(g, bool) or not isinstance(g, (int, float)) or not math.isfinite(g) for g in gs):
            raise ValueError("resolution must hold finite numbers")
        if len(set(gs)) < len(gs):
            logger.info("duplicate resolution values were removed")
        if given.get("cluster_range") is not None:
            logger.info("cluster_range is ignored when resolution is given")
        given["resolution"] = tuple(dict.fromkeys(float(g) for g in gs))
    for name in ("n_trials", "n_bootstrap", "n_iterations", "max_iterations", "min_cluster_size", "probe_parallelism"):
        if name in given:
            given[name] = _whole(name, given[name])
    if given.get("objective", "CPM") not in ("CPM", "modularity", "cpm_linear"):
        raise ValueError("objective must be CPM, modularity or cpm_linear")
    for name in ("ic_threshold", "remove_threshold"):
        if name in given and not (isinstance(given[name], (int, float)) and not isinstance(given[name], bool) and given[name] >= 1):
            raise ValueError(f"{name} must be a number of at least 1")
    if "seed" in given:
        given["seed"] = _whole("seed", given["seed"], 0)
    for name in ("beta", "resolution_tolerance"):
        if name in given and not (math.isfinite(given[name]) and given[name] > 0):
            raise ValueError(f"{name} must be positive and finite")
    return Params(**{k: v for k, v in given.items() if v is not None})


def recommended_table(sizes: DataFrame) -> DataFrame:
    """The recommendations for each row of ``sizes`` (n_cells), one for each kind of analysis."""
    n, m = F.col("n_cells"), F.col("m")
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("analysis"), F.lit(x).alias("m")) for a, x in MULTIPLIERS.items()]))

    def by_size(pick):
        out = F.lit(pick(SIZE_CLASSES[-1]))
        for c in reversed(SIZE_CLASSES[:-1]):
            out = F.when(n < c[0], pick(c)).otherwise(out)
        return out

    def scaled(least: int, place: int):
        return F.greatest(F.lit(least), F.bround(by_size(lambda c: c[place]) * m).cast("int"))

    return sizes.select("n_cells", kinds.alias("a")).select("n_cells", "a.*").select(
        "n_cells", "analysis", by_size(lambda c: c[1][0]).alias("k_min"), by_size(lambda c: c[1][1]).alias("k_max"), by_size(lambda c: c[2]).alias("parallelism"),
        scaled(5, 3).alias("n_trials"), scaled(20, 4).alias("n_bootstrap"), by_size(lambda c: c[5]).alias("objective"),
    )


def recommended(n_cells: int, analysis: str = "standard") -> dict:
    """Parameters for a graph of this size, and a rough runtime."""
    if analysis not in MULTIPLIERS:
        raise ValueError(f"analysis must be one of {', '.join(MULTIPLIERS)}")
    place = next(k for k, c in enumerate(SIZE_CLASSES) if n_cells < c[0])
    _, (low, high), parallelism, trials, bootstraps, objective = SIZE_CLASSES[place]
    by = MULTIPLIERS[analysis]
    return {
        "cluster_range": tuple(range(low, high + 1)), "probe_parallelism": parallelism, "objective": objective, "expected_runtime": RUNTIMES[place],
        "n_trials": max(5, round(trials * by)), "n_bootstrap": max(20, round(bootstraps * by)),
    }
