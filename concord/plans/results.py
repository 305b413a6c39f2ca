"""Result tables: choosing a row for each final count, diagnostics, and what users read from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.rules import search_state
from concord.operators.similarity import interval


@dataclass(frozen=True)
class ConsistencyResult:
    """Tables of one evaluation; all are keyed by ``source_target`` or by ``n_cluster``."""

    main: DataFrame
    best_labels: DataFrame
    ic_bootstrap: DataFrame
    mei: DataFrame
    target_diagnostics: DataFrame | None
    resolution_diagnostics: DataFrame | None
    probes: DataFrame | None
    meta: dict = field(default_factory=dict)


def rekeyed(results: DataFrame) -> DataFrame:
    """``results`` (source_target, gamma, final_clusters, ic, excluded, exclusion_reason) with the chosen row of each final count.

    Of the rows that are not excluded and have one final count, that with the least ic is chosen; unknown ic comes last.
    """
    order = Window.partitionBy("excluded", "final_clusters").orderBy(F.col("ic").asc_nulls_last(), "source_target", "gamma")
    rank = F.row_number().over(order)
    chosen = ~F.col("excluded") & F.col("final_clusters").isNotNull() & (rank == 1)
    out = results.withColumn("selected_main_result", chosen)
    reason = F.when(F.col("excluded"), F.col("exclusion_reason")).when(F.col("selected_main_result"), "none").otherwise("deduplicated")
    return out.withColumn("exclusion_reason", reason)


def target_diagnostics(results: DataFrame, targets: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row for each requested target: its best result row, or why there is none.

    ``results`` as of ``rekeyed``; ``intervals`` (target, bracketed, gamma_left, gamma_right).
    """
    priority = F.when(F.col("selected_main_result"), 1).when(~F.col("excluded"), 2).otherwise(3)
    order = Window.partitionBy("source_target").orderBy(priority, F.col("ic").asc_nulls_last(), F.col("gamma").asc_nulls_last())
    best = results.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    joined = targets.join(best, targets["target"] == best["source_target"], "left").join(intervals.select("target", "bracketed", "gamma_left", "gamma_right"), "target", "left")
    missing = F.col("source_target").isNull()
    found = F.coalesce("bracketed", F.lit(False))
    status = (
        F.when(missing, F.when(found, "optimization_admission_failed").otherwise("resolution_search_failed"))
        .when(F.col("selected_main_result"), "selected_main_result")
        .when(F.col("excluded"), F.col("exclusion_reason"))
        .otherwise("candidate")
    )
    return joined.select(
        "target", "gamma_left", "gamma_right", "gamma", "final_clusters", "ic",
        F.coalesce("selected_main_result", F.lit(False)).alias("selected_main_result"),
        F.coalesce("excluded", F.lit(True)).alias("excluded"),
        status.alias("result_status"),
    )


def resolution_diagnostics(results: DataFrame) -> DataFrame:
    """Rows (gamma, final_clusters, ic, ...) with ``selected``: the least ic of each final count, ties to the least gamma."""
    order = Window.partitionBy("final_clusters").orderBy(F.col("ic").asc_nulls_last(), "gamma")
    return results.withColumn("selected", F.row_number().over(order) == 1)


def full_target_diagnostics(results: DataFrame, targets: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row for each requested target with all that is known of its evaluation: medians, phases, seconds, and its fate.

    All targets advance together, so seconds of a phase are those of the job that served all of them.
    """
    status = target_diagnostics(results, targets, intervals).select("target", "gamma_left", "gamma_right", "selected_main_result", "excluded", "result_status")
    order = Window.partitionBy("source_target").orderBy(F.desc("selected_main_result"), "excluded", F.col("ic").asc_nulls_last(), F.col("gamma").asc_nulls_last())
    best = results.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "selected_main_result", "excluded")
    counts = [f"{a}_cluster_median" for a in ("effective", "raw", "final")]
    phases = ["phase1_primary_gamma_count", "phase1_secondary_gamma_count", "phase1_total_gamma_count", "phase1_elapsed_sec", "phase1_leiden_runs", "secondary_phase1_used"]
    ends = ["exact_hit_gamma_count", "phase4_iterations", "phase4_elapsed_sec", "phase5_elapsed_sec", "optimization_elapsed_sec"]
    return status.join(best, status["target"] == best["source_target"], "left").select(
        F.col("target").alias("requested_target_cluster"), F.col("target").alias("searched_target_cluster"), F.lit(True).alias("requested_by_user"),
        "gamma_left", "gamma_right", "gamma", "ic", *counts,
        F.col("raw_clusters").alias("best_labels_raw_cluster_count"), F.col("final_clusters").alias("best_labels_final_cluster_count"),
        *phases, *ends, "excluded", F.coalesce("exclusion_reason", "result_status").alias("exclusion_reason"), "selected_main_result", "result_status",
    )


def full_resolution_diagnostics(results: DataFrame) -> DataFrame:
    """One row for each given resolution: its counts, medians and ic, and whether it stands for its cluster count."""
    return resolution_diagnostics(results).select(
        F.col("gamma").alias("resolution"), F.col("final_clusters").alias("cluster_number"), "ic", "effective_cluster_median", "raw_cluster_median", "final_cluster_median",
        F.col("raw_clusters").alias("best_labels_raw_cluster_count"), F.col("final_clusters").alias("best_labels_final_cluster_count"), F.col("n_iterations").alias("n_iter"), "selected",
    )


def probe_diagnostics(found) -> DataFrame:
    """One row for each probe of a search (as of ``search.Search.run``): where it lies, what it found, and what it was used for.

    ``raw_class`` and ``over_fragmented`` are of the largest target, which steers the search for the upper end.
    """
    used = found.intervals.select(F.explode("seed_gammas").alias("gamma")).distinct().withColumn("_used", F.lit(True))
    state = search_state(F.col("raw_clusters"), F.col("effective_clusters"), F.lit(found.top_target), found.min_cluster_size)
    discovered = F.col("probe_stage") == "upper_cap_discovery"
    rows = found.probes.join(F.broadcast(used), "gamma", "left").withColumn("_s", state)  # seeds: a few for each target
    return rows.select(
        "sweep_round", "discovery_round", "probe_stage", "probe_index", F.lit(None).cast("int").alias("probe_pid"), "probe_elapsed_sec", "gamma",
        F.when(discovered, F.col("gamma")).alias("upper_cap_discovery_gamma"), "degenerate_high_gamma", F.lit(found.parallelism).alias("scheduled_probe_workers"),
        F.lit(found.coarse_probes).cast("int").alias("coarse_probe_count"), F.lit(found.upper_gamma).cast("double").alias("discovered_upper_gamma"),
        F.lit(found.stop_reason).cast("string").alias("upper_cap_stop_reason"), "refinement_interval_width", "refinement_interval_id", "refinement_points_per_interval",
        F.col("effective_clusters").cast("double").alias("effective_cluster_count"), F.col("raw_clusters").cast("double").alias("raw_cluster_count"),
        F.col("final_clusters").cast("double").alias("final_cluster_count"), F.col("_s.raw_class").alias("raw_class"), F.col("_s.over_fragmented").alias("over_fragmented"),
        (F.col("probe_stage") == "refinement").alias("selected_for_refinement"), F.coalesce("_used", F.lit(False)).alias("selected_for_target_interval"), "plateau_round",
    )


def robust_labels(main: DataFrame, best_labels: DataFrame, cells: DataFrame, counts: list[int], threshold: float = 1.005) -> DataFrame:
    """cell_id and a column clusters_<k>, from 1, for each consistent count; ``counts``: the counts to pivot, known beforehand."""
    good = main.where(F.col("ic") < threshold).select("n_cluster")
    rows = best_labels.join(F.broadcast(good), "n_cluster").join(cells, "cell_idx")  # a few counts
    wide = rows.groupBy("cell_id").pivot("n_cluster", counts).agg(F.max(F.col("label") + 1))
    return wide.select("cell_id", *[F.col(str(k)).alias(f"clusters_{k}") for k in counts])


def labels_to_metadata(metadata: DataFrame, labels: DataFrame, key: str = "cell_id") -> DataFrame:
    """Metadata with label columns; raises unless both have the same keys, each once, and no label is null."""
    names = [c for c in labels.columns if c != key]
    some_null = F.lit(False)
    for name in names:
        some_null = some_null | F.col(name).isNull()
    both = metadata.select(key, F.lit(1).alias("_m")).join(labels.withColumn("_l", F.lit(1)), key, "full_outer")
    said = both.agg(
        F.count(F.when(F.col("_m").isNull() | F.col("_l").isNull(), 1)).alias("apart"),
        F.count(F.when(F.col("_l").isNotNull() & some_null, 1)).alias("nulls"),
        F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"),
    ).first()
    if said.apart or said.n != said.d:
        raise ValueError("labels and metadata must have the same cells, each once")
    if said.nulls:
        raise ValueError("labels must not be missing")
    return metadata.join(labels, key, "left")


def consistent_clusters(main: DataFrame, ic_bootstrap: DataFrame, threshold: float = 1.005) -> DataFrame:
    """n_cluster, ic_median, gamma, n_iterations, ic_ci_lower, ic_ci_upper of counts with ic below the threshold."""
    ranges = interval(ic_bootstrap, keys=["n_cluster"]).drop("ic_median")
    kept = main.where(F.col("ic") < threshold).select("n_cluster", F.col("ic").alias("ic_median"), "gamma", "n_iterations")
    return kept.join(ranges, "n_cluster", "left")


def consistency_points(main: DataFrame, ic_bootstrap: DataFrame, threshold: float = 1.005) -> DataFrame:
    """One row for each bootstrap value: n_cluster, ic, is_consistent, tick_label (count, line break, gamma in scientific form)."""
    tick = F.format_string("%d\n%.2e", F.col("n_cluster").cast("int"), F.col("gamma"))
    head = main.select("n_cluster", (F.col("ic") < threshold).alias("is_consistent"), tick.alias("tick_label"))
    return ic_bootstrap.join(head, "n_cluster").select("n_cluster", F.col("ic"), "is_consistent", "tick_label")


@dataclass(frozen=True)
class ConsistencyPlot:
    """What a plot of consistency shows: points, the excluded targets, the axis, and a message in place of points."""

    points: DataFrame
    excluded: list[int]
    low: float
    high: float
    message: str | None


def consistency_plot(main: DataFrame, ic_bootstrap: DataFrame, diagnostics: DataFrame | None = None, threshold: float = 1.005) -> ConsistencyPlot:
    """Points of the counts with a known ic; the axis goes from 0.99 to 1.05 times the largest value."""
    points = consistency_points(main.where(F.col("ic").isNotNull()), ic_bootstrap, threshold)
    top = points.agg(F.max("ic")).first()[0]
    out = excluded_targets(diagnostics).select("searched_target_cluster").distinct().collect() if diagnostics is not None else []
    return ConsistencyPlot(points, sorted(r[0] for r in out), 0.99, 1.05 * (top if top is not None else 1.0), None if top is not None else "no consistent cluster numbers were found")


def stability_points(main: DataFrame) -> DataFrame:
    """One row for each count: n_cluster, ic, gamma."""
    return main.select("n_cluster", "ic", "gamma").dropDuplicates(["n_cluster"])


def stability_histogram(main: DataFrame, ic_bootstrap: DataFrame, n_cluster: int, bins: int = 30) -> tuple[DataFrame, float]:
    """The bins of one count's bootstrap values, and their median; raises if the count is not among the results."""
    if main.where(F.col("n_cluster") == n_cluster).isEmpty():
        raise ValueError(f"cluster number {n_cluster} is not among the results")
    own = ic_bootstrap.where(F.col("n_cluster") == n_cluster)
    return histogram(own, "ic", bins), own.agg(F.median("ic")).first()[0]


def histogram(values: DataFrame, column: str = "ic", bins: int = 30) -> DataFrame:
    """bin (from 0), low, high, count: equal bins over the range; the last includes the maximum."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    x, lo, hi = F.col(column), F.col("lo"), F.col("hi")
    place = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = values.join(F.broadcast(ends)).groupBy("lo", "hi", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))  # one row of ends
    width = (hi - lo) / bins
    return counts.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "count")


def compact_ranges(values: list[int]) -> str:
    """1-4, 7 (5 values)"""
    values, out, k = sorted(set(values)), [], 0
    while k < len(values):
        e = k
        while e + 1 < len(values) and values[e + 1] == values[e] + 1:
            e += 1
        out.append(str(values[k]) if k == e else f"{values[k]}-{values[e]}")
        k = e + 1
    return f"{', '.join(out)} ({len(values)} values)" if values else "none"


def overview(main: DataFrame, threshold: float = 1.005) -> DataFrame:
    """One row: counts found and consistent, and the range of ic."""
    return main.agg(
        F.count(F.lit(1)).alias("n_counts"),
        F.count(F.when(F.col("ic") < threshold, 1)).alias("n_consistent"),
        F.min("ic").alias("min_ic"), F.max("ic").alias("max_ic"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"),
    )


def summary(result: ConsistencyResult, threshold: float = 1.005) -> str:
    """A report in lines of text, from the small result tables."""
    rows = sorted(result.main.collect(), key=lambda r: r.n_cluster)
    good = [r for r in rows if r.ic is not None and r.ic < threshold]
    lines = ["Consistency of cluster counts", f"mode: {result.meta.get('analysis_mode')}", f"counts found: {compact_ranges([r.n_cluster for r in rows])}", f"consistent (ic < {threshold}): {compact_ranges([r.n_cluster for r in good])}"]
    if (missing := result.meta.get("uncovered_targets")) :
        lines.append(f"not covered: {compact_ranges(missing)}")
    lines += [f"  {r.n_cluster}: ic {r.ic:.6g}, gamma {r.gamma:.6g}" + (" *" if r in good else "") for r in rows]
    best = min((r for r in rows if r.ic is not None), key=lambda r: (r.ic, r.n_cluster), default=None)
    if best is not None:
        lines.append(f"best: {best.n_cluster} clusters at gamma {best.gamma:.6g}")
    if not good:
        lines.append("No count is consistent: raise the threshold, or widen the range of counts.")
    return "\n".join(lines)


def excluded_targets(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where("excluded")


def tested_targets(diagnostics: DataFrame) -> int:
    return diagnostics.select("requested_target_cluster").distinct().count()
