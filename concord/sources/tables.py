"""Tables that the queries run on: files, graphs by name, and deterministic study tables made from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.graph import GraphData


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_result(result, folder: str) -> None:
    """Every table of a ConsistencyResult as Parquet, and the main one as CSV with a header."""
    for name in ("main", "best_labels", "ic_bootstrap", "mei", "target_diagnostics", "resolution_diagnostics", "probes"):
        if (table := getattr(result, name)) is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    result.main.write.mode("overwrite").option("header", True).csv(f"{folder}/main_csv")


@dataclass(frozen=True)
class GraphCatalog:
    """Graphs by name; the default is ``<assay>_snn``."""

    graphs: dict[str, GraphData]
    assay: str = "RNA"

    def get(self, name: str | None = None) -> GraphData:
        name = f"{self.assay}_snn" if name in (None, "snn") and "snn" not in self.graphs else name or "snn"
        if name not in self.graphs:
            raise ValueError(f"graph {name!r} not found; available graphs: {', '.join(sorted(self.graphs)) or 'none'}")
        return self.graphs[name]


#: Preparation steps, in order, and what to do if one is missing.
STEPS = (
    ("normalized", "normalise the counts"), ("features", "choose variable features"), ("scaled", "scale the features"),
    ("pca", "reduce to principal components"), ("graph", "build a neighbour graph"),
)


def readiness(spark: SparkSession, rows_by_step: dict[str, DataFrame | None]) -> DataFrame:
    """(step, n_rows, ready, suggestion) for each step; a missing or empty table is not ready and raises nothing."""
    out = None
    for step, advice in STEPS:
        table = rows_by_step.get(step)
        counted = spark.range(1).select(F.lit(0).cast("long").alias("n")) if table is None else table.agg(F.count(F.lit(1)).alias("n"))
        row = counted.select(F.lit(step).alias("step"), F.col("n").alias("n_rows"), (F.col("n") > 0).alias("ready"), F.when(F.col("n") > 0, "").otherwise(advice).alias("suggestion"))
        out = row if out is None else out.unionByName(row)
    return out


def trial_label(t: Column, modulus: Column) -> Column:
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    noise = F.when((key * 7919 + t * 104729) % 97 < 5, (key * 31 + t * 17) % 5).otherwise(0)
    return ((size + noise) % modulus).cast("int")


def trials(parts: DataFrame, n: int = 8) -> DataFrame:
    """(trial, cell_idx, label): near-equal partitions of parts into 5."""
    return parts.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("trial"), "p_partkey", "p_size").select("trial", F.col("p_partkey").alias("cell_idx"), trial_label(F.col("trial").cast("long"), F.lit(5)).alias("label"))


def gamma_trials(parts: DataFrame, steps: int = 12, n: int = 8) -> DataFrame:
    """(g, trial, cell_idx, label): partitions into about g clusters, g = 1 .. steps."""
    rows = parts.select(F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("g"), "p_partkey", "p_size").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select("g", "trial", F.col("p_partkey").alias("cell_idx"), trial_label(F.col("trial").cast("long"), F.col("g")).alias("label"))


def planted_blocks(parts: DataFrame, size: int = 200) -> GraphData:
    """A graph with ten groups in each block of ``size`` neighbouring ids, by an integer rule; edges lie within blocks."""
    block = F.floor(F.col("p_partkey") / size).alias("block")
    a, b = parts.select(block, F.col("p_partkey").alias("a")), parts.select(block, F.col("p_partkey").alias("b"))
    limit = F.when(F.col("a") % 10 == F.col("b") % 10, 50).otherwise(2)
    half = a.join(b.hint("merge"), "block").where((F.col("a") < F.col("b")) & ((F.col("a") * 7919 + F.col("b") * 104729) % 100 < limit))
    one = half.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"))
    cells = parts.select(F.col("p_partkey").alias("cell_idx"), F.format_string("cell_%d", "p_partkey").alias("cell_id"))
    return GraphData(cells, one.unionByName(half.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1.0).alias("weight"))))


def co_parts(lineitem: DataFrame) -> DataFrame:
    """Edges between parts of one order, weighted by the number of orders: a sparse graph of the table's size."""
    rows = lineitem.select("l_orderkey", "l_partkey").distinct()
    other = rows.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return rows.join(other, "l_orderkey").where("l_partkey <> dst").groupBy(F.col("l_partkey").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
