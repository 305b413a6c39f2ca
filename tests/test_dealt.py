"""Graphs that never come to the driver: dealt to pieces by connected components."""

import re

import numpy as np
import pytest

from concord.operators import leiden as L
from concord.operators.graph import GraphData
from concord.plans.api import evaluate_consistency
from concord.plans.catalog import ORACLES, QUERIES

from .test_oracle import FOLDER, duck, rows  # noqa: F401


@pytest.fixture
def small(monkeypatch):
    """Every graph is too large for the driver; pieces are small, and a component may be larger than one."""
    monkeypatch.setattr(L, "COLLECTED", 0)
    monkeypatch.setattr(L, "PIECE", 150)


def graph(spark):
    """Five groups of twelve cells with odd numbers of neighbours, two of them linked; and three cells without edges."""
    rng, half = np.random.default_rng(3), [(0, 12, 1.0)]
    for g in range(5):
        half += [(12 * g + a, 12 * g + b, 1.0) for a in range(12) for b in range(a) if rng.random() < 0.8 or b == a - 1]
    edges = spark.createDataFrame([e for a, b, w in half for e in ((a, b, w), (b, a, w))], "src long, dst long, weight double")
    return GraphData(spark.range(63).withColumnRenamed("id", "cell_idx"), edges)


def groups(labels):
    found = {}
    for r in labels.collect():
        found.setdefault((r.task, r.trial, r.label), []).append(r.cell_idx)
    return {(task, trial, tuple(sorted(c))) for (task, trial, _), c in found.items()}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 700)]
    up = {v: v for p in pairs for v in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(4)
    assert {(r.cell_idx, r.part) for r in L.components(edges).collect()} == {(v, least) for v, least in up.items() if v != least}


def test_runs_on_pieces(spark, small):
    dealt = L.adjacency(graph(spark).edges, 63)
    assert isinstance(dealt, L.Dealt) and dealt.count > 1
    tasks = spark.createDataFrame([(0, 0.3, 1, 5), (0, 0.3, 2, 6), (1, 0.3, 1, 5)], L.TASKS)
    found = L.run_tasks(dealt, tasks, "CPM", 10, 0.01)
    planted = [tuple(range(12 * g, 12 * g + 12)) for g in range(5)] + [(60,), (61,), (62,)]
    assert groups(found) == {(k, t, g) for k, t in ((0, 1), (0, 2), (1, 1)) for g in planted}
    assert {r.label for r in found.collect()} == set(range(8)) and found.count() == 3 * 63
    warm = L.run_tasks(dealt, tasks, "CPM", 2, 0.01, found)
    assert groups(warm) == groups(found)
    probes = L.run_probes(dealt, tasks, "CPM", 10, 0.01, 2).collect()
    assert {(r.raw_clusters, r.effective_clusters, r.final_clusters) for r in probes} == {(8, 5, 5)}
    none = L.run_probes(dealt, tasks, "CPM", 10, 0.01, 40).first()
    assert (none.effective_clusters, none.final_clusters) == (0, 1)


def test_modularity_of_a_piece_is_over_the_whole_graph(spark, small):
    whole = graph(spark)
    tasks = spark.createDataFrame([(0, 1.0, 1, 5)], L.TASKS)
    found = groups(L.run_tasks(L.adjacency(whole.edges, 63), tasks, "modularity", 10, 0.01))
    assert found == {(0, 1, tuple(range(12 * g, 12 * g + 12))) for g in range(5)} | {(0, 1, (c,)) for c in (60, 61, 62)}


def test_a_component_is_bounded(spark, small):
    with pytest.raises(ValueError, match="entries"):
        L.adjacency(graph(spark).edges, 63, 200)


@pytest.mark.parametrize("name", ["leiden_planted", "consistency_of_planted"])
def test_queries_on_pieces(spark, duck, small, name):  # noqa: F811
    found, said = QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(said.columns, said.fetchall())


def test_a_range_of_counts_on_pieces(spark, small):
    out = evaluate_consistency(graph(spark), cluster_range=[5], n_trials=3, n_bootstrap=5, seed=1, min_cluster_size=2)
    assert out.target_diagnostics.count() == 1 and [r.n_cluster for r in out.main.collect()] in ([5], [])


def block(spark):
    from concord.sources.tables import planted_blocks

    return planted_blocks(spark.range(200).withColumnRenamed("id", "p_partkey")).edges


def test_all_iterations_are_run(spark):
    """Runs that ended in another optimum, when the first iteration without a change was the last."""
    whole = L.adjacency(block(spark), 200)
    for seed in (357, 678, 1623, 1665, 1673):
        assert (L.leiden(whole, 0.2, "CPM", 10, 0.1, seed) == np.arange(200) % 10).all()


@pytest.mark.parametrize("step", [0, 10**9])
def test_refinement_together_and_singly(spark, monkeypatch, step):
    """Parts stay within clusters and are connected, however nodes are taken; one part for a dense cluster."""
    monkeypatch.setattr(L, "STEP", step)
    monkeypatch.setattr(L, "AT_ONCE", 50)
    whole, of = L.adjacency(block(spark), 200), np.arange(200) % 10 // 2
    part = L._refined(whole, np.ones(200), of, 0.2, 0.01, L.random.Random(1))
    assert (of[part] == of).all() and len(set(part.tolist())) < 100
    assert (part[part] == part).all()
    names, place = np.unique(part, return_inverse=True)
    small = L._aggregated(whole, place, len(names))
    src = np.repeat(place, np.diff(whole.start))
    table = np.zeros((len(names), len(names)))
    np.add.at(table, (src, place[whole.other]), whole.weight)
    np.fill_diagonal(table, 0)
    found = np.zeros_like(table)
    found[np.repeat(np.arange(len(names)), np.diff(small.start)), small.other] = small.weight
    assert (found == table).all()


def test_pieces_keep_their_tasks(spark, small):
    dealt = L.adjacency(graph(spark).edges, 63)
    tasks = spark.createDataFrame([(0, 0.3, t, t) for t in range(3)], L.TASKS)
    found = L._in_pieces(dealt, tasks, lambda cells, piece, number, runs: L.pd.DataFrame({"piece": [number], "runs": [len(runs)]}), "piece int, runs int")
    assert found.rdd.getNumPartitions() >= dealt.count and found.agg({"runs": "sum"}).first()[0] == 3 * dealt.count


def test_tables_of_the_graphs_size_are_not_broadcast(spark):
    """They look small to Spark, by the size of files and of what is not exploded yet; only a row for each run may go to the driver."""
    from concord.operators import similarity as S
    from concord.operators.counts import reindexed
    from concord.operators.merge import merged

    keys = ["task", "trial"]
    rows = [(0, t, c, (c + (c * t) % 7 % 2) % 5) for t in range(1, 4) for c in range(30)]
    labels = spark.createDataFrame([(task, t, c, label) for task, t, c, label in rows], L.LABELS)
    mei = S.element_consistency(labels, S.patterns(labels, ["task"]), ["task"])
    plans = {name: df._jdf.queryExecution().executedPlan().toString() for name, df in (("mei", mei), ("reindexed", reindexed(labels, keys)), ("merged", merged(block(spark), labels, 6, keys)))}
    joins = {name: [line.split("BroadcastHashJoin")[1] for line in plan.split("\n") if "BroadcastHashJoin" in line] for name, plan in plans.items()}
    assert joins["mei"] == joins["reindexed"] == [] and all(re.match(r" \[task#\d+, trial#\d+\], ", line) for line in joins["merged"]), joins
    assert mei.count() == 30 and merged(block(spark), labels, 6, keys).count() == 90


@pytest.mark.parametrize("least", [1, 2, 7, 40])
def test_counts_need_no_merging(spark, least):
    """The counts of the merged clusters, without the graph: a plan of merging for each reader grows the driver's memory."""
    from concord.operators.counts import cluster_counts
    from concord.operators.merge import merged
    from concord.plans.api import Study
    from concord.plans.params import checked

    rows = [(0, t, c, (c * c + t * c) % 17 // (t + 1)) for t in range(1, 4) for c in range(63)]
    labels, keys = spark.createDataFrame(rows, L.LABELS), ["task", "trial"]
    study = Study(graph(spark), checked(min_cluster_size=least), lambda gamma, trial: [])
    found = study.counted(labels)
    said = cluster_counts(merged(study.graph.edges, labels, least, keys), keys, 1)
    assert {(r.trial, r.final_clusters) for r in found.collect()} == {(r.trial, r.raw_clusters) for r in said.collect()}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_plans_of_an_evaluation_stay_small(spark, monkeypatch):
    """One plan had 151 stages: its readers each planned all the steps to the same small table again."""
    from concord.plans.api import Study

    keep, sizes = Study.keep, []

    def kept(self, df):
        sizes.append(len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString())))
        return keep(self, df)

    monkeypatch.setattr(Study, "keep", kept)
    out = evaluate_consistency(graph(spark), cluster_range=[5], n_trials=3, n_bootstrap=5, seed=1, min_cluster_size=2)
    assert [r.n_cluster for r in out.main.collect()] == [5] and max(sizes) <= 40, sizes


@pytest.mark.parametrize("objective, gammas", [("CPM", (0.05, 0.2, 0.5)), ("modularity", (1.0, 4.0, 12.0))])
def test_runs_are_the_same_in_pieces_and_whole(spark, monkeypatch, objective, gammas):
    """What was drawn had depended on the piece, and a component's levels on the others: results changed with the size of the graph."""
    rng, half = np.random.default_rng(6), []
    for g, size in enumerate((40, 25, 25, 12, 7, 2, 2)):
        half += [(100 * g + a, 100 * g + b, float(rng.integers(1, 9)) / 8) for a in range(size) for b in range(a) if rng.random() < 0.3 or b == a - 1]
    edges = spark.createDataFrame([e for a, b, w in half for e in ((a, b, w), (b, a, w))], "src long, dst long, weight double").repartition(3)
    tasks = spark.createDataFrame([(k, gamma, t, 7 * t) for k, gamma in enumerate(gammas) for t in range(1, 4)], L.TASKS)

    def results():
        arrays = L.adjacency(edges, 700)
        cold = L.run_tasks(arrays, tasks, objective, 3, 0.1)
        warm = L.run_tasks(arrays, tasks, objective, 2, 0.1, cold)
        probes = L.run_probes(arrays, tasks, objective, 3, 0.01, 4)
        return type(arrays), *(sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) for df in (cold, warm, probes))

    whole, *said = results()
    monkeypatch.setattr(L, "COLLECTED", 0)
    monkeypatch.setattr(L, "PIECE", 150)
    dealt, *found = results()
    assert (whole, dealt) == (L.Adjacency, L.Dealt) and found == said
    assert len({r[0::2] for r in said[2]}) > 3  # runs differ


def test_refinement_singly_is_the_same(spark, monkeypatch):
    whole, of = L.adjacency(block(spark), 200), np.arange(200) % 10 // 2
    found = []
    for step in (0, 10**9):
        monkeypatch.setattr(L, "STEP", step)
        found.append(L._refined(whole, np.ones(200), of, 0.2, 0.05, L.random.Random(3)).tolist())
    assert found[0] == found[1] and len(set(found[0])) > 5
