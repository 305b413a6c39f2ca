"""Label numbering and cluster counts of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reindexed(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels numbered 0, 1, ... by ascending id within ``keys``; ranks are over distinct labels, not cells.

    There may be as many labels as cells, so they are not broadcast.
    """
    distinct = labels.select(*keys, "label").distinct()
    ranked = distinct.withColumn("new_label", F.row_number().over(Window.partitionBy(*keys).orderBy("label")) - 1)
    return labels.join(ranked.hint("merge"), [*keys, "label"]).drop("label").withColumnRenamed("new_label", "label")


def compacted(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels numbered 1, 2, ... by first appearance along ``cell_idx`` within ``keys``."""
    first = labels.groupBy(*keys, "label").agg(F.min("cell_idx").alias("first_cell"))
    ranked = first.withColumn("new_label", F.row_number().over(Window.partitionBy(*keys).orderBy("first_cell"))).drop("first_cell")
    return labels.join(ranked, [*keys, "label"]).drop("label").withColumnRenamed("new_label", "label")


def cluster_sizes(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))


def cluster_counts(labels: DataFrame, keys: list[str], min_cluster_size: int) -> DataFrame:
    """(keys, raw_clusters, effective_clusters); a trial whose clusters are all small has 0 effective ones."""
    return cluster_sizes(labels, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("raw_clusters"),
        F.count(F.when(F.col("size") >= min_cluster_size, 1)).cast("int").alias("effective_clusters"),
    )


def count_medians(counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, <c>_median, <c>_median_int): medians over trials; integers are truncated."""
    found = counts.groupBy(*keys).agg(*[F.median(c).alias(f"{c}_median") for c in columns])
    return found.select(*keys, *[x for c in columns for x in (F.col(f"{c}_median"), F.col(f"{c}_median").cast("int").alias(f"{c}_median_int"))])


def hit_counts(counts: DataFrame, targets: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(target, keys, hit_count, hit_rate): trials whose count is the target; ``targets`` has one column, target.

    Counts are grouped before targets meet them: the join is on equal counts.
    """
    by_count = counts.groupBy(*keys, F.col(column).alias("target")).agg(F.count(F.lit(1)).alias("hits"))
    totals = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"))
    grid = totals.join(F.broadcast(targets))  # a few targets for each key
    found = grid.join(by_count, [*keys, "target"], "left")
    return found.select("target", *keys, F.coalesce("hits", F.lit(0)).cast("int").alias("hit_count"), (F.coalesce("hits", F.lit(0)) / F.col("trials")).alias("hit_rate"))
