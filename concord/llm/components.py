"""Connected components of an edge table, by alternating star contractions.

Each round is two grouped minima and two equi-joins; no neighbour list is ever gathered, and
rounds are cut by tables in the shared folder. Stars of any size are fine: minima combine
before the shuffle, and adaptive execution splits a hub's rows in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.unionByName(back) if large else edges.where("a > b").unionByName(back.where("a > b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        found = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return found.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b): each vertex of an edge but the least of its component, and that least vertex."""
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = stored(_star(_star(now, True), False), "edges")
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if said == seen or not said[0]:
            return now
        seen = said
    raise RuntimeError(f"components: no end after {most_rounds} rounds")
