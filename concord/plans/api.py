"""Entry points: consistency of cluster counts, and of given resolutions."""

from __future__ import annotations

import logging
import math
import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import gamma as G
from concord.functions.rules import derived_seed, manual_seed
from concord.operators import counts as C
from concord.operators import similarity as S
from concord.operators.graph import GraphData
from concord.operators.leiden import LABELS, TASKS, adjacency, run_probes, run_tasks
from concord.operators.merge import merged
from concord.plans import admission as A
from concord.plans import results as R
from concord.plans.memo import Heartbeat, Memo
from concord.plans.params import Params, checked
from concord.plans.search import PROBE_ITERATIONS, Search
from concord.sources.scratch import stored

logger = logging.getLogger("concord")

#: (gamma, trial) -> labels of all cells, in place of Leiden.
ClusterFn = Callable[[float, int], list[int]]


class Study:
    """One graph and its parameters; every step is one Spark job over (task, trial) rows."""

    def __init__(self, graph: GraphData, params: Params, cluster_fn: ClusterFn | None = None):
        self.graph, self.p, self.cluster_fn = graph, params, cluster_fn
        self.n = graph.check()
        self.spark: SparkSession = graph.cells.sparkSession
        self.arrays = None if cluster_fn else adjacency(graph.edges, self.n)
        self.memo, self.beat = Memo(), Heartbeat("consistency", params.heartbeat_seconds)

    def keep(self, df: DataFrame) -> DataFrame:
        """Written for several readers; what follows starts from the table and not from all steps before."""
        return stored(df, "study")

    def tasks(self, rows: list[tuple[int, float, int, int]]) -> DataFrame:
        return self.spark.createDataFrame(rows, TASKS)

    def cluster(self, tasks: DataFrame, iterations: int, beta: float, initial: DataFrame | None = None) -> DataFrame:
        if self.cluster_fn is None:
            objective = "modularity" if self.p.objective == "modularity" else "CPM"
            run = lambda rows: self.keep(run_tasks(self.arrays, rows, objective, iterations, beta, initial))
            return run(tasks) if initial is not None else self.memo.cluster(tasks, (objective, iterations, beta), run)
        rows = [(r.task, r.trial, c, int(x)) for r in tasks.collect() for c, x in enumerate(self.cluster_fn(r.gamma, r.trial))]
        return self.keep(self.spark.createDataFrame(rows, LABELS))

    def final(self, labels: DataFrame) -> DataFrame:
        return merged(self.graph.edges, labels, self.p.min_cluster_size, ["task", "trial"])

    def counted(self, labels: DataFrame) -> DataFrame:
        """(task, trial, raw_clusters, effective_clusters, final_clusters): merging leaves the large clusters, or one if there is none."""
        return C.cluster_counts(labels, ["task", "trial"], self.p.min_cluster_size).withColumn("final_clusters", F.greatest("effective_clusters", F.lit(1)))

    def consistency(self, labels: DataFrame, trials: int) -> DataFrame:
        """(task, ic)"""
        if trials == 1:
            return labels.select("task").distinct().withColumn("ic", F.lit(1.0))
        return S.raw_consistency(S.similarity_matrix(S.patterns(labels, ["task"]), ["task"]), trials, ["task"]).select("task", "ic")

    def probe(self, gammas: list[float]) -> DataFrame:
        rows = [(k, g, 1, derived_seed(self.p.seed, "probe", gamma=g)) for k, g in enumerate(gammas)]
        if self.arrays is not None:
            objective = "modularity" if self.p.objective == "modularity" else "CPM"
            self.beat(lambda: f"probing {len(gammas)} resolutions")
            return run_probes(self.arrays, self.tasks(rows), objective, PROBE_ITERATIONS, 0.01, self.p.min_cluster_size).drop("task")
        labels = self.cluster(self.tasks(rows), PROBE_ITERATIONS, 0.01)
        named = self.spark.createDataFrame(list(enumerate(gammas)), "task int, gamma double")
        return self.counted(labels).join(F.broadcast(named), "task").select("gamma", "raw_clusters", "effective_clusters", "final_clusters")

    def medians(self, labels: DataFrame, targets: dict[int, tuple[int, float]], trials: int) -> DataFrame:
        """(task, target, gamma, medians, hits) of each task; ``targets``: task -> (target, gamma)."""
        named = self.spark.createDataFrame([(t, k, g) for t, (k, g) in targets.items()], "task int, target int, gamma double")
        rows = self.counted(labels).join(F.broadcast(named), "task")
        return rows.groupBy("task", "target", "gamma").agg(
            F.median("raw_clusters").alias("raw_median"), F.median("effective_clusters").alias("effective_median"), F.median("final_clusters").alias("final_median"),
            F.sum((F.col("final_clusters") == F.col("target")).cast("int")).alias("hit_count"), F.sum((F.col("raw_clusters") == F.col("target")).cast("int")).alias("raw_hit_count"),
        )

    def finished(self, labels: DataFrame, chosen: dict[int, tuple[int, float]], trials: int, by_hits: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Bootstrap (task, b, ic), mei (task, cell_idx, mei), and of the representative trial the merged labels (task, cell_idx, label)
        and the number of raw clusters (task, best_raw), of all tasks at once."""
        keys = ["task"]
        own = self.keep(labels.where(F.col("task").isin(list(chosen))))
        found = self.keep(S.patterns(own, keys))
        pairs = self.keep(S.similarity_matrix(found, keys))
        seeds = self.spark.createDataFrame([(t, derived_seed(self.p.seed + 1000 * k, "bootstrap", i=0)) for t, (k, _) in chosen.items()], "task int, seed long")
        drawn = S.bootstrap_weights(self.spark, self.p.n_bootstrap, trials, seeds=seeds)  # each target has its own draws
        if trials > 1:
            boots = S.bootstrap(pairs, drawn, trials, keys)
        else:
            boots = found.select("task").distinct().select("task", F.explode(F.sequence(F.lit(1), F.lit(self.p.n_bootstrap)).cast("array<bigint>")).alias("b"), F.lit(1.0).alias("ic"))
        table = self.keep(S.outcomes(found, keys))
        if by_hits:  # trials with the target's count, where a task has any
            named = self.spark.createDataFrame([(t, k) for t, (k, _) in chosen.items()], "task int, target int")
            # a plan with all the steps to a table that is read several times takes much of the driver's memory
            hits = self.keep(self.counted(own).join(F.broadcast(named), "task").where(F.col("final_clusters") == F.col("target")).select("task", F.col("trial").alias("rep_trial"), F.lit(1).alias("hit")))
            some = hits.select("task").distinct().withColumn("some", F.lit(1))
            table = table.join(hits, ["task", "rep_trial"], "left").join(some, "task", "left").where("some is null or hit = 1").drop("hit", "some")
        best = self.keep(S.best_outcome(table, pairs, keys).select("task", F.col("rep_trial").alias("trial")))
        chosen_runs = self.keep(own.join(F.broadcast(best), ["task", "trial"]))  # one row for each task
        raws = C.cluster_counts(chosen_runs, ["task", "trial"], 1).select("task", F.col("raw_clusters").alias("best_raw"))
        return boots, S.element_consistency(own, found, keys), self.final(chosen_runs).select("task", "cell_idx", "label"), raws


def _bounds(p: Params) -> tuple[float, float]:
    if p.objective == "CPM":
        return math.exp(max(math.log(p.resolution_tolerance), -20.0)), math.exp(20.0)
    return -13.0, 20.0


def _prefiltered(study: Study, intervals: list, trials: int = 10) -> set[int]:
    """Targets whose least ic over a few resolutions reaches ``remove_threshold``."""
    p = study.p
    if math.isinf(p.remove_threshold):
        return set()
    rows, of = [], {}
    for row in intervals:
        n = min(5, max(1, math.ceil((row.gamma_right - row.gamma_left) * 100) + 1))
        for g in G.grid(row.gamma_left, row.gamma_right, "linear", 0.0, steps=n) if row.gamma_left < row.gamma_right else [row.gamma_left]:
            of[len(of)] = row.target
            rows += [(len(of) - 1, g, t, derived_seed(p.seed, "filter", k=row.target, gamma=g) + t) for t in range(1, trials + 1)]
    if not rows:
        return set()
    found = study.consistency(study.cluster(study.tasks(rows), 5, 0.01), trials)
    named = study.spark.createDataFrame(list(of.items()), "task int, target int")
    judged = A.prefiltered(found.join(F.broadcast(named), "task"), p.remove_threshold)  # five tasks for each target
    return {r.target for r in judged.where("excluded").collect()}


def _optimised(study: Study, intervals: list, probes: DataFrame) -> tuple[list[dict], DataFrame | None, dict[int, tuple[int, float]]]:
    """A chosen task for each target that has one: all targets advance together, a job for each phase."""
    p, spark = study.p, study.spark
    ends = {r.target: r for r in intervals}
    trials, next_task = p.n_trials, 0
    roles: dict[int, list[tuple[float, str]]] = {}
    table = spark.createDataFrame([(r.target, r.gamma_left, r.gamma_right, True, r.exact_gammas, r.near_gammas, r.seed_gammas) for r in intervals], "target int, gamma_left double, gamma_right double, bracketed boolean, exact_gammas array<double>, near_gammas array<double>, seed_gammas array<double>")
    for r in A.seed_table(table, probes).collect():
        roles.setdefault(r.target, []).append((r.gamma, r.seed_role))
    plans = {k: G.batches(r.gamma_left, r.gamma_right, roles.get(k, []), p.objective) for k, r in ends.items()}
    evaluations, all_labels, named = None, None, {}
    pending, modes = set(ends), {}
    seconds, runs = [0.0, 0.0], {k: 0 for k in ends}
    counts = {k: [0, 0] for k in ends}
    for phase in (0, 1):
        tasks, began = {}, time.monotonic()
        for k in sorted(pending):
            for g in plans[k][phase]:
                tasks[next_task] = (k, g)
                next_task += 1
            counts[k][phase] = len(plans[k][phase])
            runs[k] += trials * counts[k][phase]
        if not tasks:
            break
        study.beat(f"{len(tasks)} resolutions for {len(pending)} targets")
        rows = [(t, g, trial, derived_seed(p.seed + 1000 * k, "gamma", gamma=g) + trial) for t, (k, g) in tasks.items() for trial in range(1, trials + 1)]
        labels = study.cluster(study.tasks(rows), p.n_iterations, p.beta)
        scored = study.keep(A.evaluated(study.medians(labels, tasks, trials), p.min_cluster_size))
        evaluations = scored if evaluations is None else evaluations.unionByName(scored)
        all_labels = labels if all_labels is None else all_labels.unionByName(labels)
        named |= tasks
        chosen = A.nearest_raw(A.admitted(evaluations), p.min_cluster_size).select("target", "task", "admission_mode", "hit_count").collect()
        hits = {r.target for r in evaluations.where("hit_count > 0").select("target").distinct().collect()}
        modes = {k: [r for r in chosen if r.target == k] for k in ends}
        pending = {k for k in ends if A.expand_secondary(len(modes[k]), modes[k][0].admission_mode if modes[k] else "none", int(k in hits))}
        seconds[phase] = time.monotonic() - began
        if not pending:
            break
    exact = {r.target: r.n for r in evaluations.where("hit_count > 0").groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()} if evaluations is not None else {}
    notes = {
        k: {
            "phase1_primary_gamma_count": counts[k][0], "phase1_secondary_gamma_count": counts[k][1], "phase1_total_gamma_count": sum(counts[k]),
            "phase1_elapsed_sec": sum(s for s, n in zip(seconds, counts[k], strict=True) if n), "phase1_leiden_runs": runs[k],
            "secondary_phase1_used": counts[k][1] > 0, "exact_hit_gamma_count": exact.get(k, 0), "phase4_iterations": 0, "phase4_elapsed_sec": 0.0,
        }
        for k in ends
    }
    kept = study.keep(A.exact_hits_first(A.nearest_raw(A.admitted(evaluations), p.min_cluster_size)))
    good = [r.task for r in kept.select("task").collect()]
    ics = {r.task: r.ic for r in study.consistency(all_labels.where(F.col("task").isin(good)), trials).collect()} if good else {}
    rows = [r.asDict() | {"ic": ics[r.task]} for r in kept.collect()]
    out, state = [], {}
    for k in ends:
        own = [r for r in rows if r["target"] == k]
        if not own:
            failed = evaluations.where(F.col("target") == k).orderBy(F.col("median_gap").asc_nulls_last(), F.col("raw_median_gap").asc_nulls_last(), "gamma").first()
            out.append({"target": k, "gamma": failed.gamma if failed else None, "ic": None, "task": None, "mode": "none", "iterations": p.n_iterations} | notes[k])
            continue
        state[k] = A.Refinement(own, own[0]["admission_mode"], p.n_iterations, p.max_iterations)
        best = state[k].least(state[k].rows)
        if round(best["ic"], 12) == 1 or len(own) == 1 or A.skip_refinement(len(own), best["ic"], sum(r["hit_count"] > 0 for r in own)):
            state[k].best = best
    while active := sorted(k for k, s in state.items() if s.open()):
        began, tasks, source = time.monotonic(), {}, {}
        for k in active:
            state[k].begin()
            for r in state[k].rows:
                tasks[next_task], source[next_task] = (k, r["gamma"]), r["task"]
                next_task += 1
        spare = {k: state[k].rounds for k in active}
        study.beat(f"refining {len(tasks)} resolutions of {len(active)} targets")
        rows = [(t, g, trial, derived_seed(p.seed + 1000 * k, "refine", round=spare[k], i=trial) + t) for t, (k, g) in tasks.items() for trial in range(1, trials + 1)]
        links = spark.createDataFrame([(t, trial, source[t], 1 + derived_seed(p.seed, "refine", round=spare[tasks[t][0]], i=trial * 31 + t) % trials) for t in tasks for trial in range(1, trials + 1)], "new_task int, new_trial int, task int, trial int")
        initial = all_labels.join(F.broadcast(links), ["task", "trial"]).select(F.col("new_task").alias("task"), F.col("new_trial").alias("trial"), "cell_idx", "label")
        labels = study.cluster(study.tasks(rows), 2, p.beta, initial)
        hits = {r.task: r.hit_count for r in study.medians(labels, tasks, trials).collect()}
        ics = {r.task: r.ic for r in study.consistency(labels, trials).collect()}
        all_labels, named = all_labels.unionByName(labels), named | tasks
        taken = [(k, *row) for k in active for row in state[k].take([(t, ics[t], hits[t]) for t, (of, _) in tasks.items() if of == k])]
        if taken:
            going = spark.createDataFrame(taken, "target int, gamma double, ic double, stable boolean, limit int")
            stay: dict[int, set[float]] = {}
            for r in A.kept_candidates(going).collect():
                stay.setdefault(r.target, set()).add(r.gamma)
            for k, gammas in stay.items():
                state[k].keep(gammas)
        for k in active:
            notes[k]["phase4_iterations"] += 1
            notes[k]["phase4_elapsed_sec"] += time.monotonic() - began
    for k, s in state.items():
        best = s.result()
        out.append({"target": k, "gamma": best["gamma"], "ic": best["ic"], "task": best["task"], "mode": s.mode, "iterations": s.iterations} | notes[k])
    return sorted(out, key=lambda r: r["target"]), all_labels, named


NOTES = {
    "effective_cluster_median": "double", "raw_cluster_median": "double", "final_cluster_median": "double", "phase1_primary_gamma_count": "int", "phase1_secondary_gamma_count": "int",
    "phase1_total_gamma_count": "int", "phase1_elapsed_sec": "double", "phase1_leiden_runs": "int", "secondary_phase1_used": "boolean", "exact_hit_gamma_count": "int",
    "phase4_iterations": "int", "phase4_elapsed_sec": "double", "phase5_elapsed_sec": "double", "optimization_elapsed_sec": "double",
}
RESULTS = "source_target int, gamma double, final_clusters int, raw_clusters int, ic double, admission_mode string, n_iterations int, excluded boolean, exclusion_reason string, task int, " + ", ".join(f"{k} {v}" for k, v in NOTES.items())


def _assembled(study: Study, labels: DataFrame | None, rows: list[dict], excluded: set[int], by_hits: bool, manual: bool):
    """Result rows with bootstrap medians, and the tables by task."""
    spark, p = study.spark, study.p
    chosen = {r["task"]: (r["target"], r["gamma"]) for r in rows if r["task"] is not None}
    boots = meis = best = None
    by_task: dict[int, tuple] = {}
    began, medians = time.monotonic(), {}
    if chosen:
        boots, meis, best, raw = study.finished(labels, chosen, p.n_trials, by_hits)
        boots, best = study.keep(boots), study.keep(best)
        middles = {r.task: r.ic_median for r in S.interval(boots, keys=["task"]).collect()}
        finals = {r.task: r.n for r in best.groupBy("task").agg(F.countDistinct("label").alias("n")).collect()}
        raws = {r.task: r.best_raw for r in raw.collect()}
        by_task = {t: (middles[t], finals[t], raws[t]) for t in chosen}
        names = [f"{c}_clusters" for c in ("effective", "raw", "final")]
        counted = study.counted(labels.where(F.col("task").isin(list(chosen)))).groupBy("task").agg(*[F.median(c).alias(c) for c in names])
        medians = {r.task: {c.replace("_clusters", "_cluster_median"): float(r[c]) for c in names} for r in counted.collect()}
    last = time.monotonic() - began
    table = []
    for r in rows:
        ic, final, raw = by_task.get(r["task"], (None, None, None))
        failed = r["task"] is None
        said = r | medians.get(r["task"], {}) | ({"phase5_elapsed_sec": last} if "phase4_elapsed_sec" in r and not failed else {})
        if "phase1_elapsed_sec" in r:
            said["optimization_elapsed_sec"] = sum(said.get(f"phase{k}_elapsed_sec") or 0.0 for k in (1, 4, 5))
        table.append((r["target"], r["gamma"], final, raw, ic, r["mode"], r["iterations"], failed, "optimization_admission_failed" if failed else "none", r["task"], *[said.get(c) for c in NOTES]))
    table += [(k, None, None, None, None, "none", None, True, "high_inconsistency", None, *[None] * len(NOTES)) for k in sorted(excluded)]
    return spark.createDataFrame(table, RESULTS), boots, meis, best


def _result(study: Study, rows: DataFrame, boots, meis, best, diagnostics, by_gamma, probes, meta: dict) -> R.ConsistencyResult:
    spark = study.spark
    chosen = study.keep(R.rekeyed(rows))
    main = chosen.where("selected_main_result").select(F.col("final_clusters").alias("n_cluster"), "gamma", "ic", "n_iterations", "admission_mode", "source_target", "task").withColumn("consistent", F.col("ic") < study.p.ic_threshold)
    key = F.broadcast(main.select("task", "n_cluster"))  # one row for each count
    empty = spark.createDataFrame
    pick = lambda df, schema, *cols: df.join(key, "task").select("n_cluster", *cols) if df is not None else empty([], schema)
    return R.ConsistencyResult(
        main=main.drop("task"),
        best_labels=pick(best, "n_cluster int, cell_idx long, label int", "cell_idx", "label"),
        ic_bootstrap=pick(boots, "n_cluster int, b long, ic double", "b", "ic"),
        mei=pick(meis, "n_cluster int, cell_idx long, mei double", "cell_idx", "mei"),
        target_diagnostics=diagnostics(chosen) if diagnostics else None,
        resolution_diagnostics=by_gamma(rows) if by_gamma else None,
        probes=probes,
        meta=meta,
    )


def evaluate_consistency(graph: GraphData, cluster_fn: ClusterFn | None = None, **given) -> R.ConsistencyResult:
    """Which cluster counts of ``cluster_range`` are reproducible; with ``resolution``, how consistent those resolutions are."""
    p = checked(**given)
    study = Study(graph, p, cluster_fn)
    if p.resolution is not None:
        return _by_resolution(study)
    spark = study.spark
    low, high = _bounds(p)
    found = Search(spark, study.probe, study.n, p.objective, low, high, p.resolution_tolerance, p.probe_parallelism, p.min_cluster_size).run(list(p.cluster_range))
    intervals = study.keep(found.intervals)
    ready = [r for r in intervals.where("bracketed").collect()]
    excluded = _prefiltered(study, ready)
    rows, labels, _ = _optimised(study, [r for r in ready if r.target not in excluded], found.probes) if len(ready) > len(excluded) else ([], None, {})
    table, boots, meis, best = _assembled(study, labels, rows, excluded, True, False)
    if found.uncovered:
        warnings.warn(f"no resolution was found for cluster counts {R.compact_ranges(found.uncovered)}", stacklevel=2)
    targets = spark.createDataFrame([(k,) for k in p.cluster_range], "target int")
    meta = {"analysis_mode": "cluster_range", "coverage_complete": found.coverage_complete, "plateau_stop": found.plateau_stop, "uncovered_targets": found.uncovered, "upper_gamma": found.upper_gamma, "upper_cap_stop_reason": found.stop_reason, "coarse_probe_count": found.coarse_probes, "n_cells": study.n}
    return _result(study, table, boots, meis, best, lambda chosen: R.full_target_diagnostics(chosen, targets, intervals), None, R.probe_diagnostics(found), meta)


def _by_resolution(study: Study) -> R.ConsistencyResult:
    p = study.p
    named = dict(enumerate(p.resolution))
    rows = [(t, g, trial, derived_seed(manual_seed(p.seed, g), "trial", trial=trial)) for t, g in named.items() for trial in range(1, p.n_trials + 1)]
    labels = study.cluster(study.tasks(rows), p.n_iterations, p.beta)
    chosen = [{"target": t, "gamma": g, "ic": None, "task": t, "mode": "manual_resolution", "iterations": p.n_iterations} for t, g in named.items()]
    table, boots, meis, best = _assembled(study, labels, chosen, set(), False, True)
    meta = {"analysis_mode": "resolution", "coverage_complete": True, "plateau_stop": False, "uncovered_targets": [], "n_cells": study.n}
    return _result(study, table, boots, meis, best, None, R.full_resolution_diagnostics, None, meta)
