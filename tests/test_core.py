"""Golden values, invariants, the search with injected clusterings, and Leiden on a planted graph."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import gamma as G
from concord.functions import rules as R
from concord.operators import counts as C
from concord.operators import merge as M
from concord.operators import similarity as S
from concord.operators.graph import GraphData
from concord.operators.leiden import Adjacency, leiden, merged_labels
from concord.plans import admission as A
from concord.plans import results as V
from concord.plans import search as P
from concord.plans.api import evaluate_consistency
from concord.plans.params import checked, recommended
from concord.sources.tables import GraphCatalog


def labels(spark, *columns):
    return spark.createDataFrame([(t + 1, i, x) for t, c in enumerate(columns) for i, x in enumerate(c)], "trial int, cell_idx long, label int")


def test_similarity_of_small_partitions(spark):
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip((1, 1, 2, 2, 3, 3), (1, 2, 1, 2, 1, 2)))], "cell_idx long, a int, b int")
    assert S.scalar_similarity(t, "a", "b").first().ecs == pytest.approx(1 / 3)
    assert S.scalar_similarity(t, "a", "a").first().ecs == 1
    per = [r.ecs for r in S.element_similarity(t, "a", "b").collect()]
    assert np.mean(per) == pytest.approx(1 / 3)


def test_alignment_errors(spark):
    a = spark.createDataFrame([(0, 1), (1, 1)], "cell_idx long, label int")
    with pytest.raises(ValueError, match="empty"):
        S.aligned(a.limit(0), a.limit(0))
    with pytest.raises(ValueError, match="same elements"):
        S.aligned(a, a.where("cell_idx = 0"))
    with pytest.raises(ValueError, match="missing"):
        S.aligned(a, a.withColumn("label", F.lit(None).cast("int")))


def test_consistency_identities(spark):
    rng = np.random.default_rng(1)
    t = labels(spark, *rng.integers(0, 3, (5, 40)).tolist())
    found = S.patterns(t)
    pairs = S.similarity_matrix(found)
    raw = S.raw_consistency(pairs, 5).first()
    assert raw.ic_raw == pytest.approx(np.mean([r.mei for r in S.element_consistency(t, found).collect()]))
    weights = spark.createDataFrame([(1, k, 1) for k in range(1, 6)], "b long, trial int, w long")
    assert S.bootstrap(pairs, weights, 5).first().ic == pytest.approx(raw.ic)


def test_outcomes_and_best(spark):
    t = labels(spark, [0, 0, 1, 1], [0, 0, 1, 1], [0, 1, 1, 1], [1, 1, 0, 0])
    found = S.patterns(t)
    table = S.outcomes(found)
    out = {r.rep_trial: (r.outcome_id, r.n, r.prob) for r in table.collect()}
    assert out == {1: (1, 2, 0.5), 3: (2, 1, 0.25), 4: (3, 1, 0.25)}
    pairs = S.similarity_matrix(found)
    assert S.best_outcome(table, pairs).first().rep_trial == 1
    weighted = S.weighted_consistency(table.select("outcome_id", "prob"), pairs.join(table.select(F.col("rep_trial").alias("i"), F.col("outcome_id").alias("x")), "i").join(table.select(F.col("rep_trial").alias("j"), F.col("outcome_id").alias("y")), "j").select(F.col("x").alias("i"), F.col("y").alias("j"), "ecs"))
    assert weighted.first().ic_raw == pytest.approx(S.raw_consistency(pairs, 4).first().ic_raw)
    with pytest.raises(ValueError):
        S.normalised_outcomes(table.withColumn("prob", F.lit(-1.0)))
    assert S.normalised_outcomes(table.withColumn("prob", F.lit(2.0))).agg(F.sum("prob")).first()[0] == pytest.approx(1)


def test_identical_trials_are_consistent(spark):
    t = labels(spark, *[[0, 1, 1, 2]] * 3)
    assert S.raw_consistency(S.similarity_matrix(S.patterns(t)), 3).first().ic == 1


def test_effective_counts(spark):
    t = labels(spark, [0, 0, 1, 1, 1, 2])
    assert [C.cluster_counts(t, ["trial"], m).first().effective_clusters for m in (1, 2, 4)] == [3, 2, 0]


@pytest.mark.parametrize(
    "own, edges, least, expected",
    [
        ([0] * 5 + [1, 2, 2], [(5, k, 1.0) for k in range(5)] + [(5, 6, 10.0), (5, 7, 10.0)], 3, None),
        ([0, 0, 0, 1, 1, 1, 2], [(6, k, 2.0) for k in range(6)], 2, [0, 0, 0, 1, 1, 1, 0]),
        ([0, 0, 1, 1], [], 3, [0, 0, 0, 0]),
    ],
)
def test_merging(spark, own, edges, least, expected):
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    out = [r.label for r in M.merged(e, labels(spark, own), least, ["trial"]).orderBy("cell_idx").collect()]
    assert out == (expected or [0] * 8)


def _values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_guards(spark):
    k = F.lit(14)
    assert _values(spark, R.soft_limit(k), R.hard_limit(k)) == [17, 21]
    assert _values(spark, *[R.passes_guard(F.lit(r), k, 2, hard=h) for r, h in ((17, False), (18, False), (21, True), (22, True))]) == [True, False, True, False]
    assert _values(spark, R.passes_guard(F.lit(99), k, 1)) == [True]
    assert _values(spark, *[R.search_upper(F.lit(n)) for n in (8, 14, 20)]) == [9, 16, 22]
    assert _values(spark, R.soft_limit(F.lit(50))) == [56]


def test_search_states(spark):
    states = _values(spark, *[R.search_state(F.lit(r), F.lit(e), F.lit(8), 2) for r, e in ((7, 7), (8, 7), (12, 8))])
    assert [s.raw_class for s in states] == ["raw_below", "raw_in_band", "raw_above_soft"]
    assert [s.over_fragmented for s in states] == [False, True, False]
    assert [s.upper_action for s in states] == ["increase_gamma", "decrease_gamma", "decrease_gamma"]


def test_discovery_lists():
    assert G.discovery_batch(1e-8, 1.0, 8)[-1] == pytest.approx(1.6384e-4)
    assert [G.discovery_plan(6, 20, c) for c in (4, 10, 15, 19)] == [(6, 4.0), (3, 2.0), (2, 2.0), (2, 1.5)]


def test_gamma_budgets():
    first, more = G.batches(0.01, 1.0, [(0.1, "selected"), (0.2, "exact"), (0.3, "near"), (0.5, "seed")], "CPM")
    assert len(first) <= 8 and len(first) + len(more) <= 12 and {0.01, 0.1, 1.0} <= set(first)
    assert G.evenly_selected([1, 2, 3, 4, 5, 6], 3) == [1, 3, 6]
    assert G.thinned([0.1, 0.101, 0.2], [], "CPM") == [0.1, 0.2]


def test_admission_rules():
    assert A.expand_secondary(0, "none", 0) and not A.expand_secondary(2, "strict_soft", 0) and A.expand_secondary(2, "relaxed_unguarded", 0) and not A.expand_secondary(2, "relaxed_unguarded", 1)
    assert A.skip_refinement(2, 1.004, 1) and not A.skip_refinement(3, 1.0, 1) and not A.skip_refinement(2, 1.01, 1)
    assert [A.refinement_cap(m) for m in ("relaxed_unguarded", "strict_soft")] == [2, 3]


def step_search(spark, steps, targets, n=40, parallelism=4, low=1e-8, high=1.0, apart_from=math.inf):
    def probe(gammas):
        rows = []
        for g in gammas:
            k = n if g >= apart_from else max((c for least, c in steps if g >= least), default=1)
            rows.append((g, k, 0 if g >= apart_from else k, 1 if g >= apart_from else k))
        return spark.createDataFrame(rows, "gamma double, raw_clusters int, effective_clusters int, final_clusters int")

    return P.Search(spark, probe, n, "CPM", low, high, 1e-8, parallelism).run(targets)


def test_discovery_stops_where_probes_fall_apart(spark):
    found = step_search(spark, [(0, 2)], [8], parallelism=2, apart_from=1e-5)
    assert found.stop_reason == "high_gamma_degenerate" and found.upper_gamma == pytest.approx(2.56e-6)


def test_discovery_stops_when_covered(spark):
    found = step_search(spark, [(0, 2), (1e-5, 8)], [8], parallelism=6)
    assert found.stop_reason == "target_covered" and found.upper_gamma == pytest.approx(1.024e-5)
    assert found.probes.where("probe_stage = 'upper_cap_discovery'").count() == 6


def test_search_finds_a_plateau_between_probes(spark):
    found = step_search(spark, [(0, 1), (0.049, 3), (0.051, 5)], [3])
    row = found.intervals.first()
    assert found.coverage_complete and row.optimization_ready and row.gamma_left <= 0.051 and row.gamma_right >= 0.049
    assert step_search(spark, [], []).coverage_complete


def test_rekeying(spark):
    rows = spark.createDataFrame([(1, 0.1, 2, 1.05, False, "none"), (2, 0.2, 2, 1.01, False, "none"), (3, 0.3, 3, 1.02, False, "none"), (4, 0.4, 3, 1.0, True, "high_inconsistency")], "source_target int, gamma double, final_clusters int, ic double, excluded boolean, exclusion_reason string")
    out = {r.source_target: (r.selected_main_result, r.exclusion_reason) for r in V.rekeyed(rows).collect()}
    assert out == {1: (False, "deduplicated"), 2: (True, "none"), 3: (True, "none"), 4: (False, "high_inconsistency")}


def test_parameters():
    with pytest.raises(ValueError, match="must be >= 1"):
        checked(min_cluster_size=0)
    with pytest.raises(ValueError, match="must be an integer"):
        checked(min_cluster_size=1.5)
    assert checked(resolution=[0.1, 0.1, 0.2]).resolution == (0.1, 0.2)
    assert recommended(500, "thorough")["n_trials"] == 15 and recommended(500, "quick")["n_trials"] == 5
    assert V.compact_ranges([1, 2, 3, 7]) == "1-3, 7 (4 values)"
    assert R.manual_seed(None, 0.1) is None and R.manual_seed(1, 0.5) == 50001


def planted(spark, n=60, blocks=3):
    edges = [(a, b, 1.0) for a in range(n) for b in range(n) if a != b and (a % blocks == b % blocks or (min(a, b) * 7919 + max(a, b) * 104729) % 100 < 3)]
    cells = spark.range(n).select(F.col("id").alias("cell_idx"), F.format_string("c%d", "id").alias("cell_id"))
    return GraphData(cells, spark.createDataFrame(edges, "src long, dst long, weight double"))


def arrays(n=60, blocks=3):
    src, dst = zip(*[(a, b) for a in range(n) for b in range(n) if a != b and (a % blocks == b % blocks or (min(a, b) * 7919 + max(a, b) * 104729) % 100 < 3)])
    return Adjacency.of(n, np.array(src), np.array(dst), np.ones(len(src)))


def test_leiden_recovers_blocks_and_repeats():
    graph = arrays()
    one = leiden(graph, 0.3, seed=4)
    assert np.array_equal(one, leiden(graph, 0.3, seed=4))
    assert len(set(zip(one.tolist(), [k % 3 for k in range(60)]))) == 3 == len(set(one.tolist()))
    assert len(set(leiden(graph, 1.0, "modularity", seed=2).tolist())) == 3
    assert leiden(Adjacency.of(0, np.zeros(0, int), np.zeros(0, int), np.zeros(0)), 1.0).size == 0
    assert len(set(leiden(Adjacency.of(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0)), 1.0).tolist())) == 3


def test_merging_in_a_task_equals_the_tables(spark):
    graph, own = arrays(), np.array([k % 3 if k % 11 else 3 + k % 4 for k in range(60)])
    src = np.repeat(np.arange(60), np.diff(graph.start)).tolist()
    edges = spark.createDataFrame(list(zip(src, graph.other.tolist(), graph.weight.tolist())), "src long, dst long, weight double")
    table = {r.cell_idx: r.label for r in M.merged(edges, labels(spark, own.tolist()), 3, ["trial"]).collect()}
    ours = merged_labels(graph, own, 3)
    assert len({(table[k], int(ours[k])) for k in range(60)}) == len(set(table.values())) == len(set(ours.tolist()))


def test_evaluation_by_resolution(spark):
    found = evaluate_consistency(planted(spark), resolution=[0.3], n_trials=3, n_bootstrap=20)
    main = found.main.first()
    assert (main.n_cluster, main.ic) == (3, 1.0)
    assert found.best_labels.count() == 60 and found.mei.agg(F.min("mei")).first()[0] == pytest.approx(1)
    assert "3 clusters" in V.summary(found)
    cells = planted(spark).cells
    wide = V.robust_labels(found.main, found.best_labels, cells, [3])
    assert sorted({r.clusters_3 for r in wide.collect()}) == [1, 2, 3]
    assert V.labels_to_metadata(cells.select("cell_id"), wide).count() == 60


def test_evaluation_with_injected_clusterings(spark):
    def cluster(gamma, trial):
        k = 1 if gamma < 0.01 else 2 if gamma < 0.1 else 4
        return [i % k for i in range(60)]

    found = evaluate_consistency(planted(spark), cluster, cluster_range=[2, 4], n_trials=2, n_bootstrap=20, min_cluster_size=1)
    assert sorted((r.n_cluster, round(r.ic, 9)) for r in found.main.collect()) == [(2, 1.0), (4, 1.0)]
    assert {r.result_status for r in found.target_diagnostics.collect()} == {"selected_main_result"}
    assert V.tested_targets(found.target_diagnostics) == 2


def test_graph_checks(spark):
    graph = planted(spark)
    with pytest.raises(ValueError, match="available graphs: RNA_snn"):
        GraphCatalog({"RNA_snn": graph}).get("other")
    assert GraphCatalog({"RNA_snn": graph}).get() is graph
    with pytest.raises(ValueError, match="square"):
        GraphData(graph.cells, spark.createDataFrame([(0, 99, 1.0)], "src long, dst long, weight double")).check()


def test_a_large_graph_is_searched_as_a_small_one(spark, monkeypatch):
    """From 200,000 cells on the search had ended after 30 sweeps, and its probes had made three iterations."""
    from concord.plans import api, search
    from concord.plans.params import checked

    plan = spark.createDataFrame([(9, 1.0, 1, 0.5)], "target int, width double, points int, gamma double")
    monkeypatch.setattr(search, "refinement_plan", lambda *_: plan)
    intervals = spark.createDataFrame([(9, False, False)], "target int, optimization_ready boolean, bracketed boolean")

    class Climbing(search.Search):
        """Each sweep finds one more cluster, and never enough."""

        def placed(self, targets, upper):
            return intervals

        def _run(self, gammas, stage, sweep, discovery=None, plan=None):
            self.rows.append({"gamma": float(sweep), "final_clusters": sweep, "sweep_round": sweep, "plateau_round": 0})
            return self.rows[-1:]

    sweeps = []
    for n in (100, 199_999, 200_000, 5_000_000):
        one = Climbing(spark, None, n, "modularity", -13.0, 20.0)
        one.run([9])
        sweeps.append(len(one.rows))
    assert set(sweeps) == {51}, sweeps

    iterations = []
    monkeypatch.setattr(api, "run_probes", lambda graph, tasks, objective, made, *_: (iterations.append(made), tasks)[1])
    study = api.Study(planted(spark), checked(cluster_range=[2]))
    for study.n in (60, 199_999, 200_000, 5_000_000):
        study.probe([0.1])
    assert set(iterations) == {5}, iterations
