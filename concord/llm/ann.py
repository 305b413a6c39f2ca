"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Building. First lists come from the leaves of a few random-projection trees, which are cut from a
bounded sample of vectors. A leaf with many vectors is cut further by random planes through its
sample's mean, as many as its size asks for; what is still large is dealt to blocks. Then, in each
NN-descent round, every node joins its neighbours and a bounded sample of those whose neighbour it
is: the round is an equi-join of (node, neighbour) with the vectors, regrouped by node. All pairs of
one node's neighbourhood (a bounded number) are scored with numpy, and each keeps what betters its
list. Rounds end when less than ``settled`` of all list entries are new, at every size.

Search. A query starts from its own node. In each round, a query's best nodes that are not yet
opened are joined with the graph's rows, which are partitioned by node once and for all rounds; the
neighbours' vectors lie in the row. The best candidates stay in the beam, which is wider for larger
tables, and rounds end when all of every beam is opened. The best ``rerank`` of the
last beam are scored again in double precision on the original vectors.

The graph holds every vector. Vectors travel as 8-bit integers and their size, as a share of the largest
one's, in double precision; a node's list is ordered by its own direction's products, so no product overflows.
Lists, beams and reverse samples are bounded for each node or query, and nothing of the corpus is on the driver
but ``SAMPLE`` vectors for the trees.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers take no part. Shorter
vectors than the longest are filled up with zeros. Null ids take no part; of rows with one id the
least vector counts. Equal scores go by smaller id: the graph is over different vectors, and each
found one is expanded to its smallest ids. With fewer candidates than asked for, all are
returned. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.shared import bounded, forget, release, stored

SAMPLE = 4096
ROWS = 4096


def _lists(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The items of a list column, one list after another."""
    return np.asarray(batch.column(column).flatten())


def _list_batch(owner: np.ndarray, values: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """(u, vs, sims) lists of arrays sorted by owner."""
    heads = np.flatnonzero(np.diff(owner, prepend=owner[:1] - 1)) if len(owner) else np.zeros(0, np.int64)
    ends = pa.array(np.append(heads, len(owner)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[heads], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(values, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(sims, pa.float64()))],
        ["u", "vs", "sims"],
    )


LISTS = "u long, vs array<long>, sims array<double>"


def best(owner: np.ndarray, values: np.ndarray, sims: np.ndarray, k: int):
    """The k best different values of each owner, best first, ties to smaller values."""
    order = np.lexsort((-sims, values, owner))
    owner, values, sims = owner[order], values[order], sims[order]
    first = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1]))[: len(owner)]
    owner, values, sims = owner[first], values[first], sims[first]
    order = np.lexsort((values, -sims, owner))
    owner, values, sims = owner[order], values[order], sims[order]
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    rank = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
    keep = rank < k
    return owner[keep], values[keep], sims[keep]


def _best_lists(lists: DataFrame, k: int, partitions: int) -> DataFrame:
    """(u, vs, sims) with the k best of all lists of each u.

    What makes lists keeps the best of each batch itself; one Python stage follows the shuffle.
    """

    def combine(batches):
        parts, size, most = [], 0, 1 << 19
        for batch in bounded(batches, ROWS):
            counts = np.diff(np.asarray(batch.column(1).offsets))
            parts.append((np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts), _lists(batch, 1), _lists(batch, 2)))
            size += len(parts[-1][0])
            if size > most:
                parts = [best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)]
                size = len(parts[0][0])
                most = max(most, 2 * size)
        if parts:
            yield _list_batch(*best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k))

    return lists.repartition(partitions, "u").mapInArrow(combine, LISTS)


@dataclass
class Tree:
    """A random-projection tree; ``children`` below zero are leaves."""

    planes: np.ndarray
    limits: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.limits) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            side = (np.einsum("ij,ij->i", x[open_], self.planes[at]) >= self.limits[at]).astype(np.int64)
            node[open_] = self.children[at, side]
        return -node - 1


def grow(sample: np.ndarray, least: int, rng: np.random.Generator) -> Tree:
    """Halves the sample by the difference of two of its vectors until parts have at most ``least``."""
    planes, limits, children, leaves = [], [], [], 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > least:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                plane = sample[a] - sample[b]
                by = sample[rows] @ plane
                limit = np.median(by)
                above = by >= limit
                if 0 < above.sum() < len(rows):
                    k = len(limits)
                    planes.append(plane)
                    limits.append(limit)
                    children.append([0, 0])
                    children[k] = [split(rows[~above]), split(rows[above])]
                    return k
        leaves += 1
        return -leaves

    root = split(np.arange(len(sample)))
    if root < 0:
        return Tree(np.zeros((0, sample.shape[1] if sample.ndim == 2 else 1)), np.zeros(0), np.zeros((0, 2), np.int64))
    return Tree(np.array(planes), np.array(limits), np.array(children))


@dataclass(frozen=True)
class NeighbourGraph:
    """Parameters; ``build`` gives the graph, ``search`` neighbours of rows in it."""

    degree: int = 32
    trees: int = 4
    leaf: int = 600
    rounds: int = 16
    settled: float = 0.1
    reverse: int = 32
    reverse_kept: int = 16
    beam: int = 240
    opened: int = 96
    search_rounds: int = 64
    rerank: int = 100
    seed: int = 5

    def beam_for(self, n: int) -> int:
        """A quarter more for each doubling of the table beyond 16,384 vectors."""
        return int(self.beam * max(1.0, 1 + 0.25 * (math.log2(max(1, n)) - 14)))

    def vectors(self, table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(id, vector, small, scale, key) of the rows that take part; equal vectors have equal keys."""
        x = F.col("vector")
        usable = F.col("id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable)
        said = rows.agg(F.max(F.size(x)).alias("n"), F.min(F.size(x)).alias("least"), F.max(F.array_max(F.transform(x, F.abs))).alias("top")).first()
        top = said.top or 1.0
        if said.n != said.least:
            rows = rows.withColumn("vector", F.concat(x, F.array_repeat(F.lit(0.0), F.lit(said.n) - F.size(x))))
        rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))

        def shrink(batches):
            for batch in bounded(batches, ROWS):
                x = _lists(batch, 1).reshape(batch.num_rows, -1)
                size = np.abs(x).max(axis=1)
                small = np.rint(x / size[:, None] * 127).astype(np.int8)
                keys = [hashlib.blake2b(r.tobytes(), digest_size=24).digest() for r in x + 0.0]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(size / top, pa.float64()), pa.array(keys, pa.binary())], ["id", "vector", "small", "scale", "key"])

        return stored(rows.mapInArrow(shrink, "id long, vector array<double>, small binary, scale double, key binary"), "vectors")

    def _first_lists(self, vectors: DataFrame, n: int, partitions: int) -> DataFrame:
        every = max(1, n // SAMPLE)
        sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(1))).limit(SAMPLE).select("small", "scale").collect()
        if not sample:
            sample = vectors.limit(SAMPLE).select("small", "scale").collect()
        sample = np.array([np.frombuffer(r.small, np.int8) * r.scale for r in sample])
        rng = np.random.default_rng(self.seed)
        least = max(4, len(sample) * self.leaf // max(1, n))
        trees = [grow(sample, least, rng) for _ in range(self.trees)]
        centers = [_means(sample, tree.leaves(sample)) if len(sample) else sample for tree in trees]
        planes = rng.normal(size=(sample.shape[1] if sample.ndim == 2 else 1, 30))
        degree, leaf = self.degree, self.leaf

        def plant(batches):
            for batch in bounded(batches, ROWS):
                small, scale = _dense(batch, 1, 2)
                x = small * scale[:, None]
                for k, tree in enumerate(trees):
                    own = tree.leaves(x)
                    code = ((x - centers[k][own]) @ planes >= 0) @ (1 << np.arange(30))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k), pa.int32()), pa.array(own, pa.int32()), pa.array(code, pa.int32()), *batch.columns], ["tree", "leaf", "code", "id", "small", "scale"])

        planted = stored(vectors.select("id", "small", "scale").mapInArrow(plant, "tree int, leaf int, code int, id long, small binary, scale double"), "leaves")
        # at most SAMPLE / 4 leaves for each tree
        cuts = planted.groupBy("tree", "leaf").agg(F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / (2 * leaf))), F.lit(0)).cast("int").alias("cuts"))
        parted = planted.join(F.broadcast(cuts), ["tree", "leaf"]).withColumn("part", F.expr("code & (shiftleft(1, cuts) - 1)"))
        blocks = parted.groupBy("tree", "leaf", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf)).alias("blocks"))
        dealt = parted.join(blocks, ["tree", "leaf", "part"]).withColumn("block", F.pmod(F.xxhash64("id", "tree"), "blocks").cast("int"))
        keys = ["tree", "leaf", "part", "block"]
        dealt = dealt.select(*keys, "id", "small", "scale").repartition(partitions, *keys).sortWithinPartitions(*keys)

        def near(batches):
            def out(held):
                ids, x, scale = (np.concatenate(part) for part in zip(*held, strict=True))
                sims = (x @ x.T).astype(np.float64) * scale
                np.fill_diagonal(sims, -np.inf)
                k = min(degree, len(ids) - 1)
                if k < 1:
                    return None
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                own = np.repeat(np.arange(len(ids)), k)
                return _list_batch(ids[own], ids[top.ravel()], sims[own, top.ravel()])

            now, held = None, []
            for batch in bounded(batches, ROWS):
                keys = np.stack([np.asarray(batch.column(k)) for k in range(4)], 1)
                ids, (x, scale) = np.asarray(batch.column(4)), _dense(batch, 5, 6)
                heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
                for a, b in zip(heads, np.append(heads[1:], len(keys)), strict=True):
                    if now is not None and tuple(keys[a]) != now:
                        if (done := out(held)) is not None:
                            yield done
                        held = []
                    now = tuple(keys[a])
                    held.append((ids[a:b], x[a:b], scale[a:b]))
            if held and (done := out(held)) is not None:
                yield done

        return _best_lists(dealt.mapInArrow(near, LISTS), degree, partitions)

    def _neighbourhoods(self, lists: DataFrame, vectors: DataFrame, reverse: int, partitions: int) -> DataFrame:
        """(center, member, small, scale, floor) sorted by center: neighbours, and a sample of those whose neighbour it is."""

        def turn(batches):
            """The ``reverse`` luckiest members of each center, from all rows of a partition: no batch's part of them is sent on."""
            owner, values, luck, most = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 1 << 19
            held = [(owner, values, luck)]
            size = 0
            for batch in bounded(batches, 1 << 16, 64 << 20):
                center, member = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                held.append((center, member, ((member * 2654435761 + center * 40503) % 1000003).astype(np.float64)))
                size += len(center)
                if size > most:
                    held = [best(*(np.concatenate(x) for x in zip(*held, strict=True)), reverse)]
                    size = len(held[0][0])
                    most = max(most, 2 * size)
            owner, values, _ = best(*(np.concatenate(x) for x in zip(*held, strict=True)), reverse)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(values, pa.int64())], ["center", "member"])

        # pairs move as rows of two numbers, as many as there are list entries at every size
        turned = lists.select(F.explode("vs").alias("center"), F.col("u").alias("member")).repartition(partitions, "center")
        back = turned.mapInArrow(turn, "center long, member long")
        pairs = lists.select(F.col("u").alias("center"), F.explode(F.array_append("vs", F.col("u"))).alias("member")).unionByName(back)
        floor = F.when(F.size("vs") >= self.degree, F.array_min("sims")).otherwise(F.lit(float("-inf")))
        known = vectors.select("id", "small", "scale").join(lists.select(F.col("u").alias("id"), floor.alias("floor")), "id", "left")
        joined = pairs.distinct().join(known.hint("merge"), pairs["member"] == known["id"]).select("center", "member", "small", "scale", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        return joined.repartition(partitions, "center").sortWithinPartitions("center", "member")

    def _descend(self, lists: DataFrame, vectors: DataFrame, partitions: int) -> DataFrame:
        degree = self.degree

        def join(batches):
            for group in _whole_groups(batches, 256):
                center, member, x, scale, floor = group
                heads = np.flatnonzero(np.append(True, center[1:] != center[:-1]))
                sizes = np.diff(np.append(heads, len(center)))
                row = np.repeat(np.arange(len(heads)), sizes)
                place = np.arange(len(center)) - np.repeat(heads, sizes)
                shape = (len(heads), int(sizes.max()))
                dense = np.zeros((*shape, x.shape[1]), np.float32)
                dense[row, place] = x
                ids, least, size = np.full(shape, -1), np.full(shape, np.inf), np.zeros(shape)
                real = np.zeros(shape, bool)
                ids[row, place], least[row, place], size[row, place], real[row, place] = member, floor, scale, True
                sims = (dense @ dense.transpose(0, 2, 1)).astype(np.float64) * size[:, None, :]
                better = (sims > least[:, :, None]) & real[:, None, :]
                better &= ~np.eye(shape[1], dtype=bool)[None]
                g, i, j = np.nonzero(better)
                yield _list_batch(*best(ids[g, i], ids[g, j], sims[g, i, j], degree))

        near = self._neighbourhoods(lists, vectors, self.reverse, partitions)
        found = near.mapInArrow(join, LISTS)
        return _best_lists(lists.unionByName(found), degree, partitions)

    def build(self, vectors: DataFrame) -> DataFrame:
        """(u, vs, sims): each vector's neighbours, best first; ``vectors`` as of ``vectors()``."""
        spark = vectors.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = vectors.count()
        lists = stored(self._first_lists(vectors, n, partitions), "lists")
        for _ in range(self.rounds):
            after = stored(self._descend(lists, vectors, partitions), "lists")
            both = after.join(lists.select("u", F.col("vs").alias("before")), "u", "left")
            new = both.agg(F.sum(F.size(F.array_except("vs", F.coalesce("before", F.array().cast("array<long>")))))).first()[0] or 0
            forget(lists)
            lists = after
            release(spark)
            if new <= self.settled * n * self.degree:
                break
        return lists

    def _graph_rows(self, lists: DataFrame, vectors: DataFrame, partitions: int) -> DataFrame:
        """(node, ids, smalls, scales): neighbours with their vectors in one row."""

        def pack(batches):
            for center, member, small, scale, _ in _whole_groups(batches, 256, dense=False):
                heads = np.flatnonzero(np.append(True, center[1:] != center[:-1]))
                ends = np.append(heads[1:], len(center))
                parts = [(member[a:b].tobytes(), b"".join(small[a:b]), scale[a:b].tobytes()) for a, b in zip(heads, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(center[heads], pa.int64()), *(pa.array([p[k] for p in parts], pa.binary()) for k in range(3))], ["node", "ids", "smalls", "scales"])

        near = self._neighbourhoods(lists, vectors, self.reverse_kept, partitions)
        return near.mapInArrow(pack, "node long, ids binary, smalls binary, scales binary")

    def search(self, lists: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found of each row of ``queries`` (id), itself excluded."""
        spark = vectors.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        graph = stored(self._graph_rows(lists, vectors, partitions), "graph").repartition(partitions, "node").persist(StorageLevel.MEMORY_AND_DISK)
        asked = stored(queries.select("id").distinct().join(vectors, "id").select(F.col("id").alias("q"), "vector", "small", "scale"), "queries")
        beam, opened = self.beam_for(vectors.count()), self.opened
        schema = "q long, vs array<long>, sims array<double>, opened array<boolean>, next array<long>, floor double"
        state = stored(asked.select("q", F.array().cast("array<long>").alias("vs"), F.array().cast("array<double>").alias("sims"), F.array().cast("array<boolean>").alias("opened"), F.array("q").alias("next"), F.lit(float("-inf")).alias("floor")), "beams")

        def look(batches):
            for batch in bounded(batches, 1024):
                out = []
                for q, small, floor, ids, smalls, scales in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    query = np.frombuffer(small, np.int8).astype(np.float32)
                    ids = np.frombuffer(ids, np.int64)
                    sims = (np.frombuffer(smalls, np.int8).reshape(len(ids), -1).astype(np.float32) @ query).astype(np.float64) * np.frombuffer(scales, np.float64)
                    keep = (sims > floor) & (ids != q)
                    if keep.any():
                        out.append((q, ids[keep], sims[keep]))
                if out:
                    owner = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
                    yield _list_batch(*best(owner, np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out]), beam))

        def keep(batches):
            """Merges new candidates into each query's beam and chooses the nodes to open next."""
            parts = []
            for batch in bounded(batches, ROWS):
                counts = np.diff(np.asarray(batch.column(1).offsets))
                done = np.asarray(batch.column(3).flatten()) if batch.column(3).null_count == 0 else np.zeros(counts.sum(), bool)
                parts.append((np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts), _lists(batch, 1), _lists(batch, 2), done.astype(bool)))
            if not parts:
                return
            owner, values, sims, done = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((~done, values, owner))
            owner, values, sims, done = owner[order], values[order], sims[order], done[order]
            first = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1]))[: len(owner)]
            owner, values, sims, done = owner[first], values[first], sims[first], done[first]
            order = np.lexsort((values, -sims, owner))
            owner, values, sims, done = owner[order], values[order], sims[order], done[order]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(heads.tolist(), np.append(heads[1:], len(owner)).tolist(), strict=True):
                b = min(b, a + beam)
                flags = done[a:b].copy()
                next_ = np.flatnonzero(~flags)[:opened]
                flags[next_] = True
                floor = float(sims[b - 1]) if b - a == beam else float("-inf")
                for column, value in zip(out, (int(owner[a]), values[a:b], sims[a:b], flags, values[a:b][next_], floor), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["q", "vs", "sims", "opened", "next", "floor"])

        for _ in range(self.search_rounds):
            frontier = state.select("q", "floor", F.explode("next").alias("node")).join(asked.select("q", "small"), "q")
            seen = frontier.join(graph.hint("shuffle_hash"), "node").select("q", "small", "floor", "ids", "smalls", "scales")
            found = seen.mapInArrow(look, LISTS)
            rows = state.select("q", "vs", "sims", "opened").unionByName(found.select(F.col("u").alias("q"), "vs", "sims", F.lit(None).cast("array<boolean>").alias("opened")))
            rows = rows.withColumn("opened", F.coalesce("opened", F.transform("vs", lambda _: F.lit(False))))
            after = stored(rows.repartition(partitions, "q").mapInArrow(keep, schema), "beams")
            forget(state)
            state = after
            if state.where(F.size("next") > 0).isEmpty():
                break
        graph.unpersist()
        top = state.select("q", F.explode(F.slice("vs", 1, max(self.rerank, k))).alias("vec_id"))
        ours, theirs = asked.select("q", F.col("vector").alias("a")), vectors.select(F.col("id").alias("vec_id"), F.col("vector").alias("b"))
        scored = top.join(theirs, "vec_id").join(ours, "q").select("q", "vec_id", _product("a", "b").alias("score"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _product(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _dense(batch: pa.RecordBatch, small: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(batch.column(small).to_pylist()), np.int8).reshape(batch.num_rows, -1)
    return raw.astype(np.float32), np.asarray(batch.column(scale))


def _means(rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The mean of each leaf's rows."""
    sums = np.zeros((leaves.max() + 1, rows.shape[1]))
    np.add.at(sums, leaves, rows)
    return sums / np.maximum(np.bincount(leaves, minlength=len(sums)), 1)[:, None]


def _whole_groups(batches, groups: int, dense: bool = True):
    """(center, member, vectors, scale, floor) arrays with all rows of at least ``groups`` centers, from rows sorted by center."""
    held = []

    def joined(parts):
        center, member, small, scale, floor = zip(*parts, strict=True)
        center, member, scale, floor = (np.concatenate(x) for x in (center, member, scale, floor))
        small = [s for part in small for s in part]
        if not dense:
            return center, member, small, scale, floor
        return center, member, np.frombuffer(b"".join(small), np.int8).reshape(len(small), -1).astype(np.float32), scale, floor

    seen = 0
    for batch in bounded(batches, ROWS):
        center = np.asarray(batch.column(0))
        part = (center, np.asarray(batch.column(1)), batch.column(2).to_pylist(), np.asarray(batch.column(3)), np.asarray(batch.column(4)))
        heads = np.flatnonzero(np.append(not held or center[0] != held[-1][0][-1], center[1:] != center[:-1]))
        seen += len(heads)
        if seen > groups and len(heads):
            cut = heads[-1]
            if cut:
                held.append(tuple(p[:cut] for p in part))
            if held:
                yield joined(held)
            held, seen = [tuple(p[cut:] for p in part)], 1
        else:
            held.append(part)
    if held:
        yield joined(held)


def nearest(table: DataFrame, k: int = 20, every: int = 20, graph: NeighbourGraph = NeighbourGraph()) -> DataFrame:
    """The k nearest found of each row whose id is divisible by ``every``.

    The graph is built and searched over different vectors; each found one stands for its k smallest ids.
    """
    rows = graph.vectors(table)
    # every row's key, and the row of the least id for each key
    groups = rows.groupBy("key").agg(F.min("id").alias("first"))
    vectors = stored(rows.join(groups.select(F.col("first").alias("id")), "id", "left_semi"), "different")
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "key")
    queries = asked.select("key").distinct().join(groups, "key").select(F.col("first").alias("id"))
    found = graph.search(graph.build(vectors), vectors, queries, k).select("query_id", "vec_id", "score")
    own = queries.join(vectors, "id").select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), _product("vector", "vector").alias("score"))

    def top(by, *order):
        return F.row_number().over(Window.partitionBy(by).orderBy(*order))

    members = rows.select("key", "id").withColumn("r", top("key", "id")).where(F.col("r") <= k + 1).join(groups, "key").select(F.col("first").alias("vec_id"), "id")
    lists = found.unionByName(own).join(members, "vec_id").withColumn("r", top("query_id", F.desc("score"), "id")).where(F.col("r") <= k + 1)
    lists = lists.groupBy(F.col("query_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    placed = asked.join(groups, "key").join(lists, "first").select("query_id", F.posexplode(others).alias("place", "x"))
    return placed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
