"""The shared resolution search: one set of probes answers all targets.

Probes are rows (gamma, raw_clusters, effective_clusters, final_clusters); targets are rows
(target). A driver loop decides when to stop; each round's probes are one Spark job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions import gamma as G
from concord.functions import rules as R

PROBE_SCHEMA = (
    "gamma double, raw_clusters int, effective_clusters int, final_clusters int, probe_stage string, sweep_round int, "
    "discovery_round int, degenerate_high_gamma boolean, probe_index int, probe_elapsed_sec double, plateau_round int, "
    "refinement_interval_width double, refinement_interval_id int, refinement_points_per_interval int"
)

#: Sweeps after the coarse one and iterations of a probe's run, for graphs of every size.
SWEEPS, PROBE_ITERATIONS = 50, 5


def monotone(probes: DataFrame, column: str = "final_clusters", keys: list[str] | None = None) -> DataFrame:
    """Adds ``stable``: the running maximum of known counts along gamma, null where the count is."""
    window = Window.partitionBy(*(keys or [])).orderBy("gamma").rowsBetween(Window.unboundedPreceding, 0)
    return probes.withColumn("stable", F.when(F.col(column).isNotNull(), F.max(column).over(window)))


def target_intervals(probes: DataFrame, targets: DataFrame, low: float, high: float) -> DataFrame:
    """One row for each target: its interval, flags, and the probes that seed its optimisation.

    An exact probe makes a target ready; a single exact probe is widened to its neighbours.
    Otherwise the nearest counts below and above bracket it, or leave it open towards a bound.
    """
    along = Window.orderBy("gamma")  # probes are a few hundred rows
    placed = monotone(probes).withColumns({"before": F.lag("gamma").over(along), "after": F.lead("gamma").over(along)})
    k, g, s = F.col("target"), F.col("gamma"), F.col("stable")
    met = targets.join(F.broadcast(placed), how="cross")
    exact = s == k
    found = met.groupBy("target").agg(
        F.min(F.when(exact, g)).alias("exact_low"),
        F.max(F.when(exact, g)).alias("exact_high"),
        F.min(F.when(exact, F.coalesce("before", "gamma"))).alias("wide_low"),
        F.max(F.when(exact, F.coalesce("after", "gamma"))).alias("wide_high"),
        F.max(F.when(s < k, g)).alias("below"),
        F.min(F.when(s > k, g)).alias("above"),
        F.array_sort(F.collect_set(F.when(exact, g))).alias("exact_gammas"),
        F.array_sort(F.collect_set(F.when(F.abs(s - k) <= 1, g))).alias("near_gammas"),
    )
    has_exact = F.col("exact_low").isNotNull()
    single = F.col("exact_low") == F.col("exact_high")
    between = F.col("below").isNotNull() & F.col("above").isNotNull() & (F.col("below") < F.col("above"))
    left = F.when(has_exact, F.when(single, F.col("wide_low")).otherwise(F.col("exact_low"))).when(between, F.col("below"))
    right = F.when(has_exact, F.when(single, F.col("wide_high")).otherwise(F.col("exact_high"))).when(between, F.col("above"))
    open_left = F.when(F.col("below").isNotNull() & (F.col("above").isNull() | between), F.col("below")).otherwise(F.lit(low))
    open_right = F.when(F.col("above").isNotNull() & (F.col("below").isNull() | between), F.col("above")).otherwise(F.lit(high))
    out = found.withColumns({"gamma_left": left, "gamma_right": right})
    bracketed = F.col("gamma_left").isNotNull()
    return out.select(
        "target",
        "gamma_left",
        "gamma_right",
        bracketed.alias("bracketed"),
        has_exact.alias("optimization_ready"),
        F.when(~has_exact, F.coalesce("gamma_left", open_left)).alias("open_left"),
        F.when(~has_exact, F.coalesce("gamma_right", open_right)).alias("open_right"),
        F.array_sort(F.array_distinct(F.concat(F.filter(F.array("gamma_left", "gamma_right"), lambda x: x.isNotNull()), "exact_gammas", "near_gammas"))).alias("seed_gammas"),
        "exact_gammas",
        "near_gammas",
    )


def refinement_plan(intervals: DataFrame, known: DataFrame, log_scale: bool, tolerance: float, parallelism: int = 4) -> DataFrame:
    """(target, width, points, gamma): new probes inside unresolved intervals, widest first.

    ``intervals`` (target, open_left, open_right). Spare probes are dealt in turn: up to 8 in each interval,
    and no more than the floor of parallelism over intervals.
    """
    a, b = F.least("open_left", "open_right"), F.greatest("open_left", "open_right")
    wide = intervals.select("target", a.alias("left"), b.alias("right")).where(~R.interval_small(F.col("left"), F.col("right"), log_scale, tolerance))
    wide = wide.withColumn("width", R.interval_width(F.col("left"), F.col("right"), log_scale))
    order = Window.orderBy(F.desc("width"), "target")  # one row for each target
    ranked = wide.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    most = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.lit(parallelism) / F.col("n"))))
    spare = F.least(F.greatest(F.lit(parallelism) - F.col("n"), F.lit(0)), F.col("n") * (most - 1))
    extra = F.floor(spare / F.col("n")) + F.when(F.col("place") <= spare % F.col("n"), 1).otherwise(0)
    planned = ranked.withColumn("points", (F.lit(1) + F.least(extra, most - 1)).cast("int"))
    probes = planned.select("target", "width", "points", F.explode(R.interval_points(F.col("left"), F.col("right"), F.col("points"), log_scale)).alias("gamma"))
    first = F.row_number().over(Window.partitionBy("gamma").orderBy(F.desc("width"), "target"))
    return probes.withColumn("_r", first).where("_r = 1").drop("_r").join(known.select("gamma").distinct(), "gamma", "left_anti").select("target", "width", "points", "gamma")


def plateau_clamp(curve: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, target, gamma_left, gamma_right, clamp_mode) of curves (keys, gamma, raw_median) for each (target).

    The plateau where the stable raw median is the target; else the narrowest neighbouring pair that brackets it; else the probes
    within 1; else the whole range. ``curve`` carries the column ``target``.
    """
    window = Window.partitionBy(*keys, "target").orderBy("gamma")
    s = F.col("stable")
    placed = monotone(curve, "raw_median", [*keys, "target"]).withColumns({"next_gamma": F.lead("gamma").over(window), "next": F.lead("stable").over(window)})
    k, g = F.col("target"), F.col("gamma")
    crosses = (s < k) & (F.col("next") > k)
    found = placed.groupBy(*keys, "target").agg(
        F.min(F.when(s == k, g)).alias("e0"), F.max(F.when(s == k, g)).alias("e1"),
        F.min(F.when(crosses, F.struct((F.col("next_gamma") - g).alias("w"), g.alias("a"), F.col("next_gamma").alias("b")))).alias("pair"),
        F.min(F.when(F.abs(s - k) <= 1, g)).alias("n0"), F.max(F.when(F.abs(s - k) <= 1, g)).alias("n1"),
        F.min("gamma").alias("all0"), F.max("gamma").alias("all1"),
    )
    mode = F.when(F.col("e0").isNotNull(), "raw_exact").when(F.col("pair").isNotNull(), "raw_bracket").when(F.col("n0").isNotNull(), "raw_near_target").otherwise("coarse")
    return found.select(*keys, "target", F.coalesce("e0", "pair.a", "n0", "all0").alias("gamma_left"), F.coalesce("e1", "pair.b", "n1", "all1").alias("gamma_right"), mode.alias("clamp_mode"))


@dataclass
class SearchResult:
    intervals: DataFrame
    probes: DataFrame
    uncovered: list[int]
    coverage_complete: bool
    plateau_stop: bool
    upper_gamma: float | None
    stop_reason: str | None
    coarse_probes: int | None
    top_target: int | None = None
    min_cluster_size: int = 1
    parallelism: int = 1


Prober = Callable[[list[float]], DataFrame]


class Search:
    """``probe(gammas)`` gives (gamma, raw_clusters, effective_clusters, final_clusters) of one clustering for each gamma."""

    def __init__(self, spark: SparkSession, probe: Prober, n_vertices: int, objective: str, low: float, high: float, tolerance: float = 1e-8, parallelism: int = 4, min_cluster_size: int = 1):
        self.min_cluster_size = min_cluster_size
        self.spark, self.probe, self.n, self.objective = spark, probe, n_vertices, objective
        self.low, self.high, self.tolerance, self.parallelism = low, high, tolerance, parallelism
        self.rows: list[dict] = []

    def _run(self, gammas: list[float], stage: str, sweep: int, discovery: int | None = None, plan: dict[float, dict] | None = None) -> list[dict]:
        """Probes what is new of the resolutions, in one job: a probe's seconds are its share of the job's."""
        gammas = sorted(set(gammas) - {r["gamma"] for r in self.rows})
        if not gammas:
            return []
        began = time.monotonic()
        found = self.probe(gammas).withColumn("degenerate_high_gamma", R.degenerate(F.col("raw_clusters"), F.col("effective_clusters"), F.col("final_clusters"), self.n))
        rows = sorted((r.asDict() | {"probe_stage": stage, "sweep_round": sweep, "discovery_round": discovery, "plateau_round": 0} for r in found.collect()), key=lambda r: r["gamma"])
        for k, r in enumerate(rows):
            r |= {"probe_index": k + 1, "probe_elapsed_sec": (time.monotonic() - began) / len(rows)} | (plan or {}).get(r["gamma"], {})
        self.rows = sorted([*self.rows, *rows], key=lambda r: r["gamma"])
        return rows

    def table(self) -> DataFrame:
        names = [c.split()[0] for c in PROBE_SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows], PROBE_SCHEMA)

    def placed(self, targets: DataFrame, upper: float) -> DataFrame:
        """The targets' intervals as rows: what follows does not plan the steps to them again."""
        found = target_intervals(self.table(), targets, self.low, upper)
        return self.spark.createDataFrame([tuple(r) for r in found.collect()], found.schema)

    def discover(self, target: int) -> tuple[float, str]:
        """The largest resolution worth probing, and why the search for it ended."""
        low, cap = max(self.low, 5e-324), max(self.high, self.low)
        start, last, covered, apart, rounds = low, None, None, 0, 0
        while True:
            rounds += 1
            size, ratio = G.discovery_plan(self.parallelism, target, covered)
            batch = G.discovery_batch(start, cap, size, ratio)
            for row in self._run(batch, "upper_cap_discovery", 0, rounds):
                if not row["degenerate_high_gamma"]:
                    apart, last, covered = 0, row["gamma"], row["final_clusters"]
                    if covered is not None and covered >= target:
                        return last, "target_covered"
                elif last is not None:
                    apart += 1
                    if apart >= 2:
                        return last, "high_gamma_degenerate"
            top = batch[-1]
            if top >= cap:
                by_top = next((r for r in self.rows if r["gamma"] == top), None)
                return (last if last is not None and by_top and by_top["degenerate_high_gamma"] else top), "hard_cap"
            _, ratio = G.discovery_plan(self.parallelism, target, covered)
            start = min((last if last is not None else top) * ratio, cap)
            if start <= top:
                start = min(top * ratio, cap)
            if start <= top:
                return (last if last is not None else top), "hard_cap"

    def run(self, targets: list[int]) -> SearchResult:
        spark = self.spark
        targets = sorted(set(targets))
        wanted = spark.createDataFrame([(t,) for t in targets], "target int")
        if not targets:
            return SearchResult(target_intervals(self.table(), wanted, self.low, self.high), self.table(), [], True, False, None, None, None, None, self.min_cluster_size, self.parallelism)
        upper, reason = self.high, None
        if self.objective == "CPM":
            upper, reason = self.discover(targets[-1])
        coarse = min(max(3 * self.parallelism, 12), 30)
        self._run(G.grid(self.low, upper, self.objective, self.tolerance, steps=coarse), "coarse", 1)
        plateau, before, ready_before = 0, None, -1
        log = G.is_log(self.objective)
        for sweep in range(2, SWEEPS + 2):
            intervals = self.placed(wanted, upper)
            rows = intervals.collect()
            ready = sum(r.optimization_ready for r in rows)
            top = max((r["final_clusters"] for r in self.rows if r["final_clusters"] is not None), default=None)
            if sweep > 2:
                plateau = plateau + 1 if (top, ready) == (before, ready_before) else 0
                for r in self.rows:
                    if r["sweep_round"] == sweep - 1:
                        r["plateau_round"] = plateau
            before, ready_before = top, ready
            if ready == len(rows) or plateau >= 2:
                break
            plan = refinement_plan(intervals.where(~F.col("optimization_ready")), self.table(), log, self.tolerance, self.parallelism)
            planned = {r.gamma: {"refinement_interval_width": r.width, "refinement_interval_id": r.target, "refinement_points_per_interval": r.points} for r in plan.collect()}
            if not self._run(list(planned), "refinement", sweep, plan=planned):
                break
        intervals = self.placed(wanted, upper)
        uncovered = sorted(r.target for r in intervals.where("not bracketed").collect())
        return SearchResult(intervals, self.table(), uncovered, not uncovered, plateau >= 2, upper, reason, coarse, targets[-1], self.min_cluster_size, self.parallelism)
