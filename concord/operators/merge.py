"""Merging of clusters below a minimal size into their best-connected large cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.counts import cluster_sizes


def _split(labels: DataFrame, min_cluster_size: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, small, n_small) and (keys, large, n_large)"""
    sizes = cluster_sizes(labels, keys)
    small = sizes.where(F.col("size") < min_cluster_size).select(*keys, F.col("label").alias("small"), F.col("size").alias("n_small"))
    large = sizes.where(F.col("size") >= min_cluster_size).select(*keys, F.col("label").alias("large"), F.col("size").alias("n_large"))
    return small, large


def links(edges: DataFrame, labels: DataFrame, small: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, small, large, mean_weight) of the pairs of a small and a large cluster that an edge joins.

    Cells and clusters grow with the graph, and their tables are small on disk for their rows: no join here or in ``merged`` broadcasts one.
    """
    # only small clusters' cells need their edges
    few = labels.join(small.select(*keys, F.col("small").alias("label")).hint("merge"), [*keys, "label"], "left_semi")
    a = few.select(*keys, F.col("cell_idx").alias("src"), F.col("label").alias("small"))
    b = labels.select(*keys, F.col("cell_idx").alias("dst"), F.col("label").alias("large"))
    weights = edges.join(a.hint("merge"), "src").join(b.hint("merge"), [*keys, "dst"]).groupBy(*keys, "small", "large").agg(F.sum("weight").alias("w"))
    return weights.join(small.hint("merge"), [*keys, "small"]).join(large.hint("merge"), [*keys, "large"]).select(*keys, "small", "large", (F.col("w") / (F.col("n_small") * F.col("n_large"))).alias("mean_weight"))


def connectivity(edges: DataFrame, labels: DataFrame, min_cluster_size: int, keys: list[str]) -> DataFrame:
    """(keys, small, large, mean_weight): the matrix of all pairs of a small and a large cluster, zero where no edge joins them."""
    small, large = _split(labels, min_cluster_size, keys)
    found = links(edges, labels, small, large, keys)
    pairs = small.select(*keys, "small").join(large.select(*keys, "large"), keys)
    return pairs.join(found, [*keys, "small", "large"], "left").select(*keys, "small", "large", F.coalesce("mean_weight", F.lit(0.0)).alias("mean_weight"))


def merged(edges: DataFrame, labels: DataFrame, min_cluster_size: int, keys: list[str]) -> DataFrame:
    """Labels after one merging pass, numbered anew; without a large cluster all cells become one cluster.

    A small cluster without an edge to a large one goes to the large one of the least id, so only joined pairs are formed.
    """
    if min_cluster_size <= 1:
        return labels
    small, large = _split(labels, min_cluster_size, keys)
    found = links(edges, labels, small, large, keys).where("mean_weight > 0")
    target = found.groupBy(*keys, F.col("small").alias("label")).agg(F.max_by("large", F.struct("mean_weight", -F.col("large"))).alias("to"))
    sizes = cluster_sizes(labels, keys)
    least = sizes.groupBy(*keys).agg(F.min(F.when(F.col("size") >= min_cluster_size, F.col("label"))).alias("first"))
    plan = sizes.join(target.hint("merge"), [*keys, "label"], "left").join(F.broadcast(least), keys)  # one row of least for each run
    label = F.when(F.col("first").isNull(), F.lit(0)).when(F.col("size") >= min_cluster_size, F.col("label")).otherwise(F.coalesce("to", "first"))
    # numbered among the clusters: numbering the cells would plan the merging twice
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("to")) - 1
    numbered = plan.select(*keys, "label", label.cast("int").alias("to")).select(*keys, "label", number.alias("new"))
    return labels.join(numbered.hint("merge"), [*keys, "label"]).select(*keys, "cell_idx", F.col("new").alias("label"))
