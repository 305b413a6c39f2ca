"""Choosing resolutions for a target: admission ladder, refinement by raw gap, best resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.rules import ADMISSION_ORDER, passes_guard, seed_priority


def evaluated(medians: DataFrame, min_cluster_size: int) -> DataFrame:
    """Adds gaps, flags and guards to (target, gamma, raw_median, final_median, hit_count, raw_hit_count)."""
    k, final, raw = F.col("target"), F.col("final_median"), F.col("raw_median")
    return medians.withColumns({
        "median_gap": F.abs(final - k),
        "raw_median_gap": F.abs(raw - k),
        "strict_valid": final.cast("int") == k,
        "relaxed_valid": (F.col("hit_count") > 0) & (F.abs(final - k) <= 1),
        "raw_strict_valid": raw.cast("int") == k,
        "raw_relaxed_valid": (F.col("raw_hit_count") > 0) & (F.abs(raw - k) <= 1),
        "raw_guard_soft": passes_guard(raw, k, min_cluster_size),
        "raw_guard_hard": passes_guard(raw, k, min_cluster_size, hard=True),
    })


def prefiltered(ics: DataFrame, remove_threshold: float) -> DataFrame:
    """(target, least_ic, excluded) of (target, ic): a target is excluded if no resolution's ic is below the threshold."""
    return ics.groupBy("target").agg(F.min("ic").alias("least_ic")).withColumn("excluded", F.col("least_ic") >= remove_threshold)


def admitted(evaluations: DataFrame) -> DataFrame:
    """The rows of each target's first non-empty admission family, with ``admission_mode``."""
    s, r, rs, rr = (F.col(c) for c in ("strict_valid", "relaxed_valid", "raw_strict_valid", "raw_relaxed_valid"))
    soft, hard = F.col("raw_guard_soft"), F.col("raw_guard_hard")
    flags = {
        "raw_strict_soft": rs & soft, "strict_soft": s & soft, "relaxed_soft": r & soft, "strict_hard": s & hard, "relaxed_hard": r & hard,
        "relaxed_unguarded": r, "raw_relaxed_soft": rr & soft, "raw_relaxed_hard": rr & hard, "raw_relaxed_unguarded": rr,
    }
    families = F.filter(F.array(*[F.when(F.coalesce(flags[m], F.lit(False)), F.lit(k)) for k, m in enumerate(ADMISSION_ORDER)]), lambda x: x.isNotNull())
    listed = evaluations.withColumn("_families", families)
    first = F.min(F.array_min("_families")).over(Window.partitionBy("target"))
    names = F.array(*[F.lit(m) for m in ADMISSION_ORDER])
    return listed.withColumn("_first", first).where(F.array_contains("_families", F.col("_first"))).withColumn("admission_mode", names[F.col("_first")]).drop("_families", "_first")


def nearest_raw(rows: DataFrame, min_cluster_size: int) -> DataFrame:
    """Of each target's rows, those with the least known raw gap; all of them where none is known, or for a minimal size of 1."""
    if min_cluster_size <= 1:
        return rows
    least = F.min("raw_median_gap").over(Window.partitionBy("target"))
    return rows.withColumn("_least", least).where(F.col("_least").isNull() | (F.col("raw_median_gap") == F.col("_least"))).drop("_least")


def exact_hits_first(rows: DataFrame) -> DataFrame:
    """Where a target's family is not a raw one and some row has a final hit, only rows with hits."""
    most = F.max("hit_count").over(Window.partitionBy("target"))
    prefer = ~F.col("admission_mode").startswith("raw_") & (F.col("_most") > 0)
    return rows.withColumn("_most", most).where(~prefer | (F.col("hit_count") > 0)).drop("_most")


def best_gamma(rows: DataFrame) -> DataFrame:
    """The row of least ic of each target, ties to the least gamma."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.round("ic", 12).asc_nulls_last(), "gamma"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def kept_candidates(rows: DataFrame) -> DataFrame:
    """The rows (target, gamma, ic, stable, limit) that a round of refinement goes on with.

    Those up to the median ic, stable ones and the best; if they are over ``limit``: the best, the best stable one, then by ic and gamma.
    """
    every = Window.partitionBy("target")
    ic = F.round("ic", 12)
    first = F.row_number().over(every.orderBy(ic, "gamma")) == 1
    steady = F.col("stable") & (F.row_number().over(every.orderBy(F.desc("stable"), ic, "gamma")) == 1)
    ranked = rows.withColumns({"_ic": ic, "_middle": F.percentile(ic, 0.5).over(every), "_first": first, "_steady": steady})
    pool = ranked.where((F.col("_ic") <= F.col("_middle")) | F.col("stable") | F.col("_first"))
    place = F.row_number().over(every.orderBy(F.desc("_first"), F.desc("_steady"), "_ic", "gamma"))
    return pool.withColumn("_place", place).where("_place <= limit").drop("_ic", "_middle", "_first", "_steady", "_place")


HISTORY = 10


@dataclass
class Refinement:
    """One target's candidates in refinement, in ascending gamma: dicts with task, gamma, ic, hit_count and the last ten ics.

    A history starts with ten copies of the first ic, so a candidate whose ic does not change is stable from its first round on.
    """

    rows: list[dict]
    mode: str
    iterations: int
    most_iterations: int
    rounds: int = 0
    best: dict | None = None

    def __post_init__(self):
        self.rows = sorted(({**r, "history": [r["ic"]] * HISTORY} for r in self.rows), key=lambda r: r["gamma"])
        self.prefer_hits = not self.mode.startswith("raw_") and any(r["hit_count"] > 0 for r in self.rows)

    def open(self) -> bool:
        """Whether another round begins: the limit of iterations holds before a round adds to them."""
        return self.best is None and self.iterations < self.most_iterations and self.rounds < refinement_cap(self.mode)

    def least(self, rows: list[dict]) -> dict:
        return min(rows, key=lambda r: (round(r["ic"], 12), r["gamma"]))

    def begin(self) -> None:
        self.rounds += 1
        self.iterations += 2

    def take(self, found: list[tuple[int, float, int]]) -> list[tuple[float, float, bool, int]]:
        """The round's (task, ic, hit_count) of each candidate. Ends the refinement, or gives the rows for ``kept_candidates``."""
        after = [{**r, "task": t, "ic": ic, "hit_count": hits, "history": [*r["history"][1:], ic]} for r, (t, ic, hits) in zip(self.rows, found, strict=True)]
        if self.prefer_hits:
            after = [r for r in after if r["hit_count"] > 0]
            if not after:  # back to the round before
                self.best = self.least(self.rows)
                return []
        stable = [len({round(x, 12) for x in r["history"]}) == 1 for r in after]
        perfect = [r for r in after if round(r["ic"], 12) == 1]
        self.rows = after
        if perfect or all(stable):
            self.best = perfect[0] if perfect else self.least(after)
            return []
        return [(r["gamma"], r["ic"], s, 4 if self.rounds == 1 else 2) for r, s in zip(after, stable, strict=True)]

    def keep(self, gammas: set[float]) -> None:
        self.rows = [r for r in self.rows if r["gamma"] in gammas]
        if len(self.rows) == 1:
            self.best = self.rows[0]

    def result(self) -> dict:
        return self.best or self.least(self.rows)


def seed_table(intervals: DataFrame, probes: DataFrame) -> DataFrame:
    """(target, gamma, seed_role, final_clusters, raw_clusters): seeds with the counts of the nearest probe within tolerance.

    ``intervals`` as of ``target_intervals``. The selected seed is the one nearest to the middle.
    """
    base = intervals.where("bracketed").select("target", "gamma_left", "gamma_right", "exact_gammas", "near_gammas", "seed_gammas")
    middle = (F.col("gamma_left") + F.col("gamma_right")) / 2
    chosen = F.array_min(F.transform("seed_gammas", lambda g: F.struct(F.abs(g - middle).alias("d"), g.alias("g"))))["g"]
    roles = None
    for role, values in (("left", F.array("gamma_left")), ("right", F.array("gamma_right")), ("selected", F.array(chosen)), ("exact", F.col("exact_gammas")), ("near", F.col("near_gammas")), ("seed", F.col("seed_gammas"))):
        part = base.select("target", (F.col("gamma_right") - F.col("gamma_left")).alias("width"), F.explode(values).alias("gamma"), F.lit(role).alias("seed_role"))
        roles = part if roles is None else roles.unionByName(part)
    return with_nearest(roles.distinct(), probes).select("target", "gamma", "seed_role", "final_clusters", "raw_clusters")


def with_nearest(seeds: DataFrame, probes: DataFrame) -> DataFrame:
    """Joins each seed (target, gamma, seed_role, width) with the nearest probe, if within max(1.5e-8, 1e-8 * width)."""
    within = F.greatest(F.lit(1.5e-8), F.lit(1e-8) * F.col("width"), F.lit(1e-12))
    p = probes.select(F.col("gamma").alias("probe"), "final_clusters", "raw_clusters")
    near = seeds.join(F.broadcast(p), F.abs(F.col("gamma") - F.col("probe")) <= within, "left")  # probes are a few hundred
    rank = F.row_number().over(Window.partitionBy("target", "gamma", "seed_role").orderBy(F.abs(F.col("gamma") - F.col("probe")).asc_nulls_last(), "probe"))
    return near.withColumn("_r", rank).where("_r = 1").drop("_r", "probe")


def normalised_seeds(seeds: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Seeds (target, gamma, seed_role, gamma_left, gamma_right) in range, one for each (gamma, role), with their order of use."""
    inside = seeds.where((F.col("gamma") >= F.col("gamma_left") - tolerance) & (F.col("gamma") <= F.col("gamma_right") + tolerance))
    distinct = inside.select("target", "gamma", "seed_role").distinct().withColumn("priority", seed_priority(F.col("seed_role")))
    order = Window.partitionBy("target").orderBy("gamma", "priority", "seed_role")
    return distinct.withColumn("place", F.row_number().over(order))


def expand_secondary(rows: int, mode: str, exact_hits: int) -> bool:
    if rows == 0:
        return True
    return exact_hits == 0 and mode in ("relaxed_unguarded", "raw_relaxed_unguarded")


def skip_refinement(candidates: int, best_ic: float | None, exact_hits: int) -> bool:
    return candidates <= 2 and best_ic is not None and best_ic <= 1.005 and exact_hits > 0


def refinement_cap(mode: str) -> int:
    return 2 if mode in ("relaxed_unguarded", "raw_relaxed_unguarded") else 3
