"""Command line: ``python -m concord --input FOLDER --output FOLDER``; ``--help`` lists the options.

An option is taken from the command line, else from the environment (``CONCORD_`` and its name in capitals), else its default.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from concord.operators.graph import GraphData
from concord.plans import results as R
from concord.plans.api import evaluate_consistency
from concord.sources.tables import GraphCatalog, read, write_result

#: What stands for true and false.
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def whole(text: str) -> int:
    value = float(text)
    if not math.isfinite(value) or value != round(value):
        raise argparse.ArgumentTypeError(f"{text} is not an integer")
    return int(value)


def positive(text: str) -> int:
    if (value := whole(text)) < 1:
        raise argparse.ArgumentTypeError(f"{text} is below 1")
    return value


def integers(text: str) -> list[int] | None:
    """``a:b`` is the range with both ends, ``a,b`` the values; nothing is None."""
    text = "".join(text.split())
    ends = text.split(":")
    if len(ends) == 2:
        a, b = whole(ends[0]), whole(ends[1])
        return list(range(a, b + 1)) if a <= b else list(range(a, b - 1, -1))
    return [whole(part) for part in text.split(",")] if text else None


def numbers(text: str) -> list[float] | None:
    text = "".join(text.split())
    values = [float(part) for part in text.split(",")] if text else None
    if values and not all(math.isfinite(v) for v in values):
        raise argparse.ArgumentTypeError(f"{text} holds what is not finite")
    return values


def boolean(text: str) -> bool:
    if text.lower() not in TRUE + FALSE:
        raise argparse.ArgumentTypeError(f"{text} is neither of {', '.join(TRUE)} nor of {', '.join(FALSE)}")
    return text.lower() in TRUE


OPTIONS: tuple[tuple[str, Callable, str, str], ...] = (
    ("input", str, "", "folder with cells.parquet and a Parquet table for each graph"),
    ("output", str, "", "folder for the results; the input folder's subfolder results if not given"),
    ("graph_name", str, "RNA_snn", "name of the graph"),
    ("n_trials", positive, "4", "runs for each resolution"),
    ("n_bootstrap", positive, "20", "bootstrap samples"),
    ("seed", whole, "123", "seed of all draws"),
    ("plot_threshold", float, "1.005", "inconsistency below which a plot shows a count as consistent"),
    ("label_threshold", float, "1.01", "inconsistency below which labels are written"),
    ("cluster_range", integers, "4:5", "cluster counts: a:b or a,b"),
    ("resolution", numbers, "", "resolutions a,b in place of cluster counts"),
    ("remove_threshold", float, "inf", "inconsistency from which a count is excluded early"),
    ("skip_plot", boolean, "false", "write no table of plot points"),
)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("concord", description="Consistency of cluster counts of a graph.", allow_abbrev=False)
    for name, kind, default, about in OPTIONS:
        extra = {"nargs": "?", "const": True} if kind is boolean else {}
        out.add_argument(f"--{name}", type=kind, default=os.environ.get(f"CONCORD_{name.upper()}") or default, help=f"{about} (default: {default or 'none'})", **extra)
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> R.ConsistencyResult:
    options = parser().parse_args(args)
    if not options.input:
        raise SystemExit("give --input or CONCORD_INPUT")
    folder = options.output or f"{options.input}/results"
    spark = spark or SparkSession.builder.getOrCreate()
    cells = read(spark, options.input, "cells")
    graph = GraphCatalog({options.graph_name: GraphData(cells, read(spark, options.input, options.graph_name))}).get(options.graph_name)
    wanted = {"resolution": options.resolution} if options.resolution else {"cluster_range": options.cluster_range, "remove_threshold": options.remove_threshold}
    result = evaluate_consistency(graph, n_trials=options.n_trials, n_bootstrap=options.n_bootstrap, seed=options.seed, **wanted)
    write_result(result, folder)
    counts = sorted(r.n_cluster for r in result.main.where(result.main.ic < options.label_threshold).select("n_cluster").collect())
    if counts:
        R.robust_labels(result.main, result.best_labels, cells, counts, options.label_threshold).write.mode("overwrite").parquet(f"{folder}/labels")
    if not options.skip_plot:
        R.consistency_plot(result.main, result.ic_bootstrap, result.target_diagnostics, options.plot_threshold).points.write.mode("overwrite").parquet(f"{folder}/plot_points")
    print(R.summary(result, options.plot_threshold))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
