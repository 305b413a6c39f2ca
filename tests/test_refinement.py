"""Phase 4 with injected ics and clusterings: history, order of cutting, limits; and the diagnostics tables."""

import pytest

from concord.operators.leiden import leiden
from concord.plans import admission as A
from concord.plans import results as V
from concord.plans.api import evaluate_consistency
from concord.plans.params import checked
from tests.test_core import arrays, planted


def candidates(*ics, hits=1):
    return [{"task": k, "gamma": 0.1 * (k + 1), "ic": ic, "hit_count": hits} for k, ic in enumerate(ics)]


def test_an_unchanged_ic_is_stable_from_the_first_round():
    r = A.Refinement(candidates(1.2, 1.1), "strict_soft", 10, 150)
    r.begin()
    assert r.take([(10, 1.2, 1), (11, 1.1, 1)]) == [] and r.best["task"] == 11 and not r.open()


def test_a_changed_ic_is_not_stable():
    r = A.Refinement(candidates(1.2, 1.1, 1.3), "strict_soft", 10, 150)
    r.begin()
    rows = r.take([(10, 1.15, 1), (11, 1.1, 1), (12, 1.3, 1)])
    assert [(round(g, 9), ic, s, n) for g, ic, s, n in rows] == [(0.1, 1.15, False, 4), (0.2, 1.1, True, 4), (0.3, 1.3, True, 4)]
    r.keep({rows[1][0], rows[2][0]})
    r.begin()
    assert r.take([(21, 1.1, 1), (22, 1.29, 1)])[0][2:] == (True, 2)


def test_perfect_ics_end_it_at_the_least_gamma():
    r = A.Refinement(candidates(1.2, 1.1, 1.3), "strict_soft", 10, 150)
    r.begin()
    assert r.take([(10, 1.2, 1), (11, 1.0, 1), (12, 1.0, 1)]) == [] and r.best["task"] == 11


def test_lost_hits_fall_back_to_the_round_before():
    r = A.Refinement(candidates(1.2, 1.1), "strict_soft", 10, 150)
    r.begin()
    assert r.take([(10, 1.01, 0), (11, 1.02, 0)]) == [] and r.best["task"] == 1
    raw = A.Refinement(candidates(1.2, 1.1), "raw_strict_soft", 10, 150)
    raw.begin()
    assert len(raw.take([(10, 1.01, 0), (11, 1.02, 0)])) == 2


@pytest.mark.parametrize("most, mode, rounds", [(10, "strict_soft", 0), (11, "strict_soft", 1), (12, "strict_soft", 1), (13, "strict_soft", 2), (150, "strict_soft", 3), (150, "relaxed_unguarded", 2)])
def test_the_limit_holds_before_a_round_adds_to_it(most, mode, rounds):
    r = A.Refinement(candidates(1.2, 1.1), mode, 10, most)
    n = 0
    while r.open():
        r.begin()
        n += 1
        r.take([(k, 1.3 + n + k, 1) for k in range(2)])
    assert (n, r.iterations) == (rounds, 10 + 2 * rounds) and r.result()["ic"] == min(x["ic"] for x in r.rows)


def test_the_cut_keeps_the_best_and_the_best_stable(spark):
    schema = "target int, gamma double, ic double, stable boolean, limit int"
    ics = [(0.1, 1.01, False), (0.2, 1.02, False), (0.3, 1.03, False), (0.4, 1.5, True), (0.5, 1.4, True), (0.6, 1.04, False)]
    rows = spark.createDataFrame([(t, g, ic, s, n) for t, n in ((1, 2), (2, 4), (3, 9)) for g, ic, s in ics], schema)
    kept = {}
    for r in A.kept_candidates(rows).collect():
        kept.setdefault(r.target, set()).add(r.gamma)
    assert kept == {1: {0.1, 0.5}, 2: {0.1, 0.5, 0.2, 0.3}, 3: {0.1, 0.2, 0.3, 0.4, 0.5}}


def test_diagnostics_have_all_columns(spark):
    def cluster(gamma, trial):
        k = 1 if gamma < 0.01 else 2 if gamma < 0.1 else 4
        return [(i + (trial % 2 and i == 7)) % k for i in range(60)]

    found = evaluate_consistency(planted(spark), cluster, cluster_range=[2, 3, 4], n_trials=3, n_bootstrap=20, min_cluster_size=1, remove_threshold=5.0)
    targets = found.target_diagnostics
    assert len(targets.columns) == 27 and len(found.probes.columns) == 24
    by = {r.requested_target_cluster: r for r in targets.collect()}
    assert by[2].final_cluster_median == 2 and by[2].phase1_leiden_runs == 3 * by[2].phase1_total_gamma_count and by[2].optimization_elapsed_sec > 0
    assert by[3].result_status != "selected_main_result"
    assert found.probes.where("selected_for_target_interval").count() > 0
    gammas = evaluate_consistency(planted(spark), cluster, resolution=[0.05, 0.5], n_trials=3, n_bootstrap=20, min_cluster_size=1)
    assert len(gammas.resolution_diagnostics.columns) == 10
    assert {(r.resolution, r.cluster_number, r.raw_cluster_median) for r in gammas.resolution_diagnostics.collect()} == {(0.05, 2, 2.0), (0.5, 4, 4.0)}
    plot = V.consistency_plot(found.main, found.ic_bootstrap, targets)
    assert plot.excluded == [3] and plot.low == 0.99 and plot.message is None
    assert V.consistency_plot(found.main.limit(0), found.ic_bootstrap).message
    assert V.stability_histogram(found.main, found.ic_bootstrap, 2)[1] >= 1
    with pytest.raises(ValueError, match="not among the results"):
        V.stability_histogram(found.main, found.ic_bootstrap, 9)


def test_inconsistent_targets_are_excluded(spark):
    def cluster(gamma, trial):
        k = 1 if gamma < 0.01 else 2 if gamma < 0.1 else 4
        return [(i * (trial if k == 4 else 1) + i // (trial + 1) * (k == 4)) % k for i in range(60)]

    found = evaluate_consistency(planted(spark), cluster, cluster_range=[2, 4], n_trials=3, n_bootstrap=20, min_cluster_size=1)
    assert {r.searched_target_cluster: (r.result_status, r.excluded) for r in found.target_diagnostics.collect()} == {2: ("selected_main_result", False), 4: ("high_inconsistency", True)}


def test_warm_starts_do_not_lose_quality(spark):
    graph = arrays()

    def quality(labels):
        own = {k: int(x) for k, x in enumerate(labels)}
        src = [v for v in range(graph.n) for _ in range(graph.start[v], graph.start[v + 1])]
        inside = sum(w for a, b, w in zip(src, graph.other.tolist(), graph.weight.tolist()) if own[a] == own[b])
        return inside - 0.2 * sum(list(own.values()).count(c) ** 2 for c in set(own.values()))

    for seed in range(1, 5):
        first = leiden(graph, 0.2, iterations=1, seed=seed)
        assert quality(leiden(graph, 0.2, iterations=2, seed=seed + 9, initial=first)) >= quality(first) - 1e-9


@pytest.mark.parametrize("given", [{"ic_threshold": 0.5}, {"remove_threshold": "x"}, {"seed": 1.5}, {"seed": -1}])
def test_parameters_are_checked(given):
    with pytest.raises(ValueError):
        checked(**given)
