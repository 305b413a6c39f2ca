"""The command line, clusterings made once, signs of life, and the bound on a worker's graph."""

import logging

import numpy as np
import pytest

from concord.__main__ import integers, main, numbers, parser
from concord.operators.leiden import Adjacency, Rows, adjacency, leiden, most_entries, run_tasks
from concord.plans.memo import Heartbeat, Memo

from .test_core import planted


def test_options(monkeypatch):
    assert integers("2:4") == [2, 3, 4] and integers("3, 7") == [3, 7] and integers(" ") is None and integers("4:2") == [4, 3, 2]
    assert numbers("0.1, 1e-2") == [0.1, 0.01] and numbers("") is None
    monkeypatch.setenv("CONCORD_N_TRIALS", "7")
    monkeypatch.setenv("CONCORD_SEED", "")
    given = parser().parse_args(["--cluster_range=2:3", "--skip_plot"])
    assert (given.n_trials, given.seed, given.cluster_range, given.skip_plot, given.resolution) == (7, 123, [2, 3], True, None)
    assert parser().parse_args(["--n_trials", "5"]).n_trials == 5 and parser().parse_args(["--skip_plot", "off"]).skip_plot is False
    for wrong in (["somewhere"], ["--unknown", "1"], ["--n_trials", "0"], ["--n_trials", "2.5"], ["--skip_plot", "maybe"], ["--seed"], ["--resolution", "inf"], ["--cluster_range", "a:b"]):
        with pytest.raises(SystemExit):
            parser().parse_args(wrong)


def test_a_run_from_the_command_line(spark, tmp_path, capsys):
    graph = planted(spark)
    graph.cells.write.parquet(f"{tmp_path}/cells.parquet")
    graph.edges.write.parquet(f"{tmp_path}/RNA_snn.parquet")
    main(["--input", str(tmp_path), "--resolution", "0.3", "--n_trials", "3", "--n_bootstrap", "4"], spark)
    assert [r.n_cluster for r in spark.read.parquet(f"{tmp_path}/results/main").collect()] == [3]
    labels = spark.read.parquet(f"{tmp_path}/results/labels")
    assert labels.columns == ["cell_id", "clusters_3"] and labels.count() == 60
    assert spark.read.parquet(f"{tmp_path}/results/plot_points").count() == 4
    assert capsys.readouterr().out.strip()


def test_runs_are_made_once(spark):
    graph = planted(spark)
    arrays, memo, made = adjacency(graph.edges, 60), Memo(), []

    def run(rows):
        made.append(rows.count())
        return run_tasks(arrays, rows, "CPM", 2, 0.01)

    def labels(rows, settings=("CPM", 2, 0.01)):
        tasks = spark.createDataFrame(rows, "task int, gamma double, trial int, seed long")
        return {(r.task, r.trial, r.cell_idx): r.label for r in memo.cluster(tasks, settings, run).collect()}

    one = labels([(0, 0.3, 1, 5), (0, 0.3, 2, 6)])
    two = labels([(4, 0.3, 9, 6), (5, 0.2, 1, 5)])  # the first is known under another number
    assert made == [2, 1] and memo.entries == 3
    assert [two[4, 9, c] for c in range(60)] == [one[0, 2, c] for c in range(60)] and len(two) == 120
    assert len(labels([(1, 0.3, 1, 5)], ("CPM", 9, 0.01))) == 60 and made == [2, 1, 1]
    memo.clear()
    assert memo.entries == 0 and len(labels([(0, 0.3, 1, 5)])) == 60 and made[-1] == 1


def test_heartbeat(caplog):
    caplog.set_level(logging.INFO, "concord")
    asked = []
    beat = Heartbeat("study", 1e-9)
    assert beat("first") and beat(lambda: "second")
    assert [r.getMessage().split(": ")[1] for r in caplog.records] == ["first", "second"]
    assert not Heartbeat("study", 60)(lambda: asked.append(1)) and not asked
    assert not Heartbeat("study", 1e-9, enabled=False)("x") and Heartbeat(seconds=float("nan")).seconds == 60 == Heartbeat(seconds=-1).seconds


def test_the_graph_of_a_worker_is_bounded(spark):
    graph = planted(spark)
    with pytest.raises(ValueError, match="entries"):
        adjacency(graph.edges, 60, 10)
    assert most_entries(spark) > 1_000_000


def test_self_loops_count_for_degrees_only():
    src, dst = np.array([0, 0, 1, 2, 2]), np.array([0, 1, 0, 2, 2])
    graph = Adjacency.of(3, src, dst, np.array([5.0, 1.0, 1.0, 2.0, 2.0]))
    assert graph.degree.tolist() == [6, 1, 4] and [Rows(graph)[v] for v in range(3)] == [[(1, 1.0)], [(0, 1.0)], []]
    assert leiden(graph, 0.5).tolist() == [0, 0, 1]


def test_runs_do_not_depend_on_kept_rows(monkeypatch):
    from concord.operators import leiden as module

    from .test_core import arrays

    kept = leiden(arrays(), 0.3, seed=4)
    monkeypatch.setattr(module, "KEPT", 100)
    assert leiden(arrays(), 0.3, seed=4).tolist() == kept.tolist()
