"""Graph tables: (src, dst, weight), one row for each stored entry, both directions and self-loops kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GraphData:
    cells: DataFrame
    edges: DataFrame

    def check(self) -> int:
        """Number of cells; raises if ids are not 0 .. n-1, or an edge has no cell."""
        said = self.cells.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_idx").alias("d"), F.min("cell_idx").alias("low"), F.max("cell_idx").alias("high")).first()
        if not said.n:
            raise ValueError("the graph has no cells")
        if said.d != said.n or said.low != 0 or said.high != said.n - 1:
            raise ValueError("cell_idx must number the cells 0 .. n-1")
        outside = (F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= said.n) | (F.col("dst") >= said.n)
        if not self.edges.where(outside | F.col("src").isNull() | F.col("dst").isNull()).isEmpty():
            raise ValueError("the similarity graph must be square: an edge has no cell")
        return said.n


def column_ranges(columns: DataFrame) -> DataFrame:
    """(col, start, stop): half-open ranges of positions, by the running sum of the sizes of (col, n).

    Sums run within ranges of 4,096 numbers, then over the ranges, level by level.
    """
    from pyspark.sql import Window

    def starts(sizes: DataFrame, levels: int) -> DataFrame:
        if not levels:
            window = Window.orderBy("at")
            return sizes.select("at", (F.sum("n").over(window) - F.col("n")).alias("start"))
        placed = sizes.withColumn("up", F.floor(F.col("at") / 4096).cast("long"))
        above = starts(placed.groupBy(F.col("up").alias("at")).agg(F.sum("n").alias("n")), levels - 1)
        window = Window.partitionBy("up").orderBy("at")
        inner = placed.select("at", "up", (F.sum("n").over(window) - F.col("n")).alias("inner"))
        return inner.join(above.select(F.col("at").alias("up"), "start"), "up").select("at", (F.col("start") + F.col("inner")).alias("start"))

    sizes = columns.select(F.col("col").alias("at"), "n")
    return starts(sizes, 2).join(sizes, "at").select(F.col("at").alias("col"), "start", (F.col("start") + F.col("n")).alias("stop"))


def from_columns(indices: DataFrame, pointers: DataFrame) -> DataFrame:
    """Edges of a compressed-sparse-column matrix.

    ``indices`` (pos from 0, row, value); ``pointers`` (col, start, stop): half-open ranges of positions.
    Ranges are expanded to positions and joined by equality.
    """
    positions = pointers.where("stop > start").select("col", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
    return positions.join(indices, "pos").select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("value").cast("double").alias("weight"))


def profile(edges: DataFrame, n_cells: int) -> DataFrame:
    """One row: size, entries, sparsity in percent, and weight statistics."""
    cells = float(n_cells) * n_cells
    return edges.agg(
        F.lit(n_cells).cast("long").alias("n_cells"),
        F.count(F.lit(1)).alias("n_entries"),
        ((1 - F.count(F.lit(1)) / F.lit(cells)) * 100).alias("sparsity_percent"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
        F.avg("weight").alias("mean_weight"),
        F.median("weight").alias("median_weight"),
    )


#: Different vectors of one block; a task compares two blocks.
BLOCK = 8192


def nearest_exact(vectors: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank): the k most similar rows of each (id, vector), itself first, ties to smaller ids.

    Every row is compared with all rows: identical vectors are grouped, tasks compare two blocks of
    different vectors, and each found vector stands for its k smallest ids.
    """
    from pyspark.sql import Window

    rows = vectors.select("id", "vector", F.coalesce(F.sha2(F.col("vector").cast("string"), 256), F.lit("")).alias("key"))
    groups = rows.groupBy("key").agg(F.min("id").alias("first"), F.any_value("vector").alias("vector"))
    blocks = max(1, -(-groups.count() // BLOCK))
    block = F.pmod(F.xxhash64("first"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = groups.select(block.alias("i"), every.alias("j"), F.lit(True).alias("asks"), "first", "vector")
    right = groups.select(every.alias("i"), block.alias("j"), F.lit(False).alias("asks"), "first", "vector")
    best = left.unionByName(right).groupBy("i", "j").applyInArrow(lambda table: _best_of_blocks(table, k), "src long, dst long, s double")

    def top(by, *order):
        return F.row_number().over(Window.partitionBy(by).orderBy(*order))

    near = best.withColumn("r", top("src", F.desc("s"), "dst")).where(F.col("r") <= k).select("src", F.col("dst").alias("first"), "s")
    firsts = groups.select("key", "first")
    members = rows.select("key", "id").withColumn("r", top("key", "id")).where(F.col("r") <= k).join(firsts, "key").select("first", "id")
    lists = near.join(members, "first").withColumn("r", top("src", F.desc("s"), "id")).where(F.col("r") <= k)
    lists = lists.groupBy(F.col("src").alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("ids"))
    others = F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k - 1)
    found = rows.select("key", "id").join(firsts, "key").join(lists, "first")
    return found.select(F.col("id").alias("src"), F.posexplode(F.concat(F.array("id"), others)).alias("rank", "dst")).select("src", "dst", (F.col("rank") + 1).alias("rank"))


def _best_of_blocks(table, k: int):
    """(src, dst, s): for each asking row of a pair of blocks the k best of the other block.

    Matrix products only choose: what comes within rounding of the k-th best is summed in order of the
    dimensions, so that equal sums are equal numbers.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    def matrix(rows):
        vectors = rows.column("vector").combine_chunks()
        said = vectors.is_valid().to_numpy(zero_copy_only=False)
        values = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.full((len(said), len(values) // max(1, said.sum())), np.nan)
        out[said] = values.reshape(said.sum(), out.shape[1])
        return rows.column("first").to_numpy(), out

    (own, a), (other, b) = (matrix(table.filter(side)) for side in (table.column("asks"), pa.compute.invert(table.column("asks"))))
    out = []
    if len(own) and len(other) and a.shape[1] == b.shape[1]:
        slack = 1e-12 * (1 + a.shape[1]) * np.sqrt(np.nansum(a * a, axis=1)) * np.sqrt(np.nansum(b * b, axis=1).max())
        for at in range(0, len(own), 256):
            rough = a[at : at + 256] @ b.T
            rough[np.isnan(rough)] = -np.inf
            last = np.partition(rough, len(other) - k, axis=1)[:, len(other) - k] if len(other) > k else np.full(len(rough), -np.inf)
            i, j = np.nonzero(rough >= (last - slack[at : at + 256])[:, None])
            s = np.zeros(len(i))
            for d in range(a.shape[1]):
                s += a[at + i, d] * b[j, d]
            s[np.isnan(s)] = -np.inf
            order = np.lexsort((other[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((own[at + i[keep]], other[j[keep]], s[keep]))
    src, dst, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "s": pa.array(s, pa.float64())})


def shared_neighbours(nearest: DataFrame, k: int, prune: float = 1 / 15) -> DataFrame:
    """Edges weighted by the Jaccard index of neighbour sets of size k; weights below ``prune`` are left out."""
    left = nearest.select("src", F.col("dst").alias("via"))
    right = nearest.select(F.col("src").alias("dst"), F.col("dst").alias("via"))
    shared = left.join(right, "via").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("s"))
    weight = F.col("s") / (2 * k - F.col("s"))
    return shared.select("src", "dst", weight.alias("weight")).where(F.col("weight") >= prune)


def cpm_quality(edges: DataFrame, labels: DataFrame, gamma: float, keys: list[str]) -> DataFrame:
    """(keys, quality): weight inside clusters less gamma times the sum of squared cluster sizes."""
    inside = _inside(*_pairs(edges, labels, keys), keys)
    sizes = labels.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    return sizes.join(inside, keys, "left").select(*keys, (F.coalesce("inside", F.lit(0.0)) - F.lit(float(gamma)) * F.col("pairs")).alias("quality"))


def modularity_quality(edges: DataFrame, labels: DataFrame, gamma: float, keys: list[str]) -> DataFrame:
    """(keys, quality): share of weight inside clusters less gamma times the sum of squared degree shares."""
    pairs, vectors = _pairs(edges, labels, keys)
    total = pairs.agg(F.sum("weight").alias("total"))
    degrees = pairs.groupBy(F.col("va").alias("vector")).agg(F.sum("weight").alias("k")).join(vectors.hint("shuffle_hash"), "vector").select("k", F.explode("l").alias("m"))
    degrees = degrees.groupBy(*[F.col(f"m.{k}").alias(k) for k in keys], F.col("m.label").alias("label")).agg(F.sum("k").alias("k"))
    # one row
    squares = degrees.join(F.broadcast(total)).groupBy(*keys).agg(F.sum(F.col("k") / F.col("total") * F.col("k") / F.col("total")).alias("squares"), F.max("total").alias("total"))
    return squares.join(_inside(pairs, vectors, keys), keys, "left").select(*keys, (F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.lit(float(gamma)) * F.col("squares")).alias("quality"))


def _pairs(edges: DataFrame, labels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(va, vb, weight), the edges summed by the vectors of their ends, and (vector, l), the labels of each.

    Cells with the same labels have one vector, named by the least of them; it is null for cells without labels. Labels grow with
    the graph, and Spark takes exploded ones for smaller than they are: none is broadcast.
    """
    own = labels.groupBy("cell_idx").agg(F.array_sort(F.collect_list(F.struct(*keys, "label"))).alias("l"))  # one item for each trial
    vectors = own.groupBy("l").agg(F.min("cell_idx").alias("vector"))
    cells = own.join(vectors.hint("shuffle_hash"), "l").select("cell_idx", "vector")
    a, b = (cells.select(F.col("cell_idx").alias(end), F.col("vector").alias(name)).hint("shuffle_hash") for end, name in (("src", "va"), ("dst", "vb")))
    return edges.join(a, "src", "left").join(b, "dst", "left").groupBy("va", "vb").agg(F.sum("weight").alias("weight")), vectors.select("vector", "l")


def _inside(pairs: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inside): each pair of vectors meets its labels."""
    la, lb = (vectors.select(F.col("vector").alias(name), F.col("l").alias(own)).hint("shuffle_hash") for name, own in (("va", "la"), ("vb", "lb")))
    both = pairs.join(la, "va").join(lb, "vb").select("weight", F.explode(F.array_intersect("la", "lb")).alias("m"))
    return both.groupBy(*[F.col(f"m.{k}").alias(k) for k in keys]).agg(F.sum("weight").alias("inside"))
