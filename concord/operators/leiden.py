"""Community detection by the Leiden algorithm (Traag, Waltman and van Eck 2019), as Spark tasks.

The graph of one study is broadcast as column arrays, and runs read them in place; its size is checked
against the executors' memory first. Each (gamma, trial) is one task row; ``mapInPandas`` runs them and
returns long labels. A graph of more than ``COLLECTED`` entries never comes to the driver: it stays a table, dealt to
pieces by connected components. No move, merge or gain of the algorithm goes across components, so a piece is run by itself.
Seeds come with the rows, all that is random is drawn by them and by the cells' numbers, and each component ends by itself: results
depend neither on partitioning nor on whether the graph is dealt.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.counts import reindexed
from concord.sources.scratch import forget, stored

#: Bytes of an entry in the arrays, with the room to receive them.
ENTRY = 28
#: Entries of rows that a run keeps as lists (about 130 bytes each); the rest are made anew whenever asked for.
KEPT = 2_000_000
#: Entries that are sorted or compared at once.
AT_ONCE = 2_000_000
#: Nodes that are refined one by one in the time of a step for all clusters.
STEP = 10
#: Entries of a graph that the driver collects and broadcasts; and those of a piece of a larger graph, unless one component has more.
COLLECTED, PIECE = 500_000, 250_000


@dataclass(frozen=True)
class Adjacency:
    """Neighbours of each node in a row of arrays, without self-loops; ``degree`` counts those too."""

    n: int
    start: np.ndarray
    other: np.ndarray
    weight: np.ndarray
    degree: np.ndarray

    @classmethod
    def of(cls, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> Adjacency:
        degree = np.bincount(src, weight, n).astype(np.float64) if len(src) else np.zeros(n)
        apart = src != dst
        src, dst, weight = src[apart], dst[apart], weight[apart]
        order = np.argsort(src, kind="stable")
        return cls(n, np.searchsorted(src[order], np.arange(n + 1)), dst[order].astype(np.int32), weight[order].astype(np.float64), degree)


@dataclass(frozen=True)
class Dealt:
    """A graph as a table (piece, src, dst, weight), with dst -1 in a row for each cell; no component is in two pieces."""

    n: int
    total: float
    pieces: DataFrame
    count: int


class Rows:
    """The neighbours of each node as lists, made from the arrays when asked for; the first ``KEPT`` entries are kept."""

    def __init__(self, graph: Adjacency):
        self.start, self.other, self.weight = graph.start.tolist(), memoryview(graph.other), memoryview(graph.weight)
        self.made: list[list[tuple[int, float]] | None] = [None] * graph.n
        self.room = KEPT

    def __len__(self) -> int:
        return len(self.start) - 1

    def __getitem__(self, v: int) -> list[tuple[int, float]]:
        row = self.made[v]
        if row is None:
            low, high = self.start[v], self.start[v + 1]
            row = list(zip(self.other[low:high].tolist(), self.weight[low:high].tolist(), strict=True))
            if self.room >= high - low:
                self.made[v] = row
                self.room -= high - low
        return row


def most_entries(spark: SparkSession) -> int:
    """How many entries each Python worker may hold: an executor's memory, shared by its cores."""
    context = spark.sparkContext
    local = context.master.startswith("local")
    memory = context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(context.getConf().get("spark.driver.memory" if local else "spark.executor.memory", "1g"))
    cores = context.defaultParallelism if local else int(context.getConf().get("spark.executor.cores", "1"))
    return memory // (ENTRY * max(1, cores))


def adjacency(edges: DataFrame, n: int, most: int | None = None) -> Adjacency | Dealt:
    """The graph as arrays, or dealt to pieces; both directions as stored, so every undirected edge counts twice."""
    most = most_entries(edges.sparkSession) if most is None else most
    entries = edges.limit(COLLECTED + 1).count()
    if entries > COLLECTED:
        return _dealt(edges, n, most)
    if entries > most:
        raise ValueError(f"the graph has {entries} entries; at most {most} fit each worker's share of an executor's memory")
    table = edges.orderBy("src", "dst", "weight").select(F.col("src").cast("int"), F.col("dst").cast("int"), "weight").toPandas()
    return Adjacency.of(n, table.src.to_numpy(), table.dst.to_numpy(), table.weight.to_numpy())


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the edges but the least of its component, and that."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(names))
    while (apart := least[x] != least[y]).any():
        u, v = least[x[apart]], least[y[apart]]
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while (up := least[least] != least).any():
            least[up] = least[least[up]]
    linked = least != np.arange(len(names))
    return names[linked], names[least[linked]]


def components(edges: DataFrame) -> DataFrame:
    """(cell_idx, part): each cell of an edge (src, dst) but the least of its component, and that least cell.

    Tasks contract the edges they hold; then cells and the least ones that they know meet by the cell, and by the least, until
    nothing changes.
    """

    def contracted(frames):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for frame in frames:
            a, b = _least(np.concatenate([a, frame.src.to_numpy()]), np.concatenate([b, frame.dst.to_numpy()]))
        yield pd.DataFrame({"src": a, "dst": b})

    schema = "src long, dst long"
    now = stored(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").repartitionByRange("src").mapInPandas(contracted, schema), "components")
    def starred(rows: DataFrame) -> bool:
        """Whether every cell has one least cell, which has none."""
        return rows.groupBy("src").count().where("count > 1").isEmpty() and rows.join(rows.select(F.col("src").alias("dst")).distinct().hint("shuffle_hash"), "dst", "left_semi").isEmpty()

    while not starred(now):
        # every cell keeps its least neighbour; the others it knows are linked with that one
        least = now.groupBy("src").agg(F.min("dst").alias("least"))
        more = now.join(least.hint("shuffle_hash"), "src").where("dst <> least").select(F.greatest("dst", "least").alias("src"), F.least("dst", "least").alias("dst"))
        known = least.select("src", F.col("least").alias("dst"))
        above = known.select(F.col("src").alias("dst"), F.col("dst").alias("top"))
        climbed = known.join(above.hint("shuffle_hash"), "dst", "left").select("src", F.coalesce("top", "dst").alias("dst"))
        after = stored(climbed.unionByName(more).distinct(), "components")
        forget(now)
        now = after
    return now.select(F.col("src").alias("cell_idx"), F.col("dst").alias("part"))


def _dealt(edges: DataFrame, n: int, most: int) -> Dealt:
    spark = edges.sparkSession
    table = stored(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double")), "graph")
    said = table.agg(F.count(F.lit(1)).alias("entries"), F.sum("weight").alias("total")).first()
    cells = spark.range(n).select(F.col("id").alias("src")).join(components(table).withColumnRenamed("cell_idx", "src").hint("shuffle_hash"), "src", "left")
    cells = cells.select("src", F.coalesce("part", "src").alias("part"))
    placed = table.join(cells.hint("shuffle_hash"), "src")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    bins = max(1, -(-said.entries // PIECE))
    # a large component is a piece of its own
    piece = F.when(F.col("size") > PIECE, F.col("part") + bins).otherwise(F.pmod(F.xxhash64("part"), F.lit(bins)))
    where = cells.join(sizes.hint("shuffle_hash"), "part", "left").select("src", piece.alias("piece"))
    where = stored(where, "pieces")
    rows = table.join(where.hint("shuffle_hash"), "src").select("piece", "src", "dst", "weight")
    pieces = stored(rows.unionByName(where.select("piece", "src", F.lit(-1).cast("long").alias("dst"), F.lit(0.0).alias("weight"))), "graph")
    forget(table)
    forget(where)
    held = pieces.groupBy("piece").agg(F.count(F.when(F.col("dst") >= 0, 1)).alias("size")).agg(F.max("size").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if held.most is not None and held.most > most:
        raise ValueError(f"a connected part of the graph has {held.most} entries; at most {most} fit each worker's share of an executor's memory")
    return Dealt(n, float(said.total or 0.0), pieces, held.n)


def _piece(frame: pd.DataFrame) -> tuple[np.ndarray, Adjacency]:
    """The cells of a piece, in order, and its graph over their places."""
    src, dst, weight = (frame[c].to_numpy() for c in ("src", "dst", "weight"))
    cells = np.sort(src[dst < 0])
    edge = dst >= 0
    src, dst, weight = src[edge], dst[edge], weight[edge]
    order = np.lexsort((weight, dst, src))
    return cells, Adjacency.of(len(cells), np.searchsorted(cells, src[order]), np.searchsorted(cells, dst[order]), weight[order])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(key: int, names: np.ndarray) -> np.ndarray:
    """A random word for each name."""
    return _mixed(_mixed(names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(key))


def _gumbel(words: np.ndarray) -> np.ndarray:
    """Gumbel noise in single precision, so that it takes four bytes an entry."""
    return -np.log(-np.log(((words >> np.uint64(11)) + 0.5) * 2.0**-53)).astype(np.float32)


def _components(graph: Adjacency) -> np.ndarray:
    """The least node of each one's component."""
    least = np.arange(graph.n)
    while True:
        before = least.copy()
        for low, high in _spans(graph.start):
            x = least[np.repeat(np.arange(low, high), np.diff(graph.start[low : high + 1]))]
            y = least[graph.other[graph.start[low] : graph.start[high]]]
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (up := least[least] != least).any():
            least[up] = least[least[up]]
        if (least == before).all():
            return least


def _kept(graph: Adjacency, keep: np.ndarray) -> Adjacency:
    """The graph of some components."""
    nodes, place = np.flatnonzero(keep), np.cumsum(keep) - 1
    at, _ = _ranges(graph.start[nodes], graph.start[nodes + 1])
    start = np.append(0, np.cumsum(np.diff(graph.start)[nodes]))
    return Adjacency(len(nodes), start, place[graph.other[at]].astype(np.int32), graph.weight[at], graph.degree[nodes])


def _moved(near, size, of: list[int], factor: float, queue: list[int]) -> bool:
    """Local moves until no node gains: the gain is twice the weight to a cluster less factor * size * cluster size * 2."""
    n = len(near)
    mass = [0.0] * n
    for v in range(n):
        mass[of[v]] += size[v]
    empty = [c for c in range(n) if mass[c] == 0]
    waiting, changed, at = [True] * n, False, 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting[v] = False
        own = of[v]
        links: dict[int, float] = {own: 0.0}
        beside = near[v]
        for u, w in beside:
            links[of[u]] = links.get(of[u], 0.0) + w
        mass[own] -= size[v]
        best, most = own, links[own] - factor * size[v] * mass[own]
        for c, w in links.items():
            gain = w - factor * size[v] * mass[c]
            if gain > most + 1e-12:
                best, most = c, gain
        if most < -1e-12:
            while empty and mass[empty[-1]] > 0:
                empty.pop()
            if mass[own] == 0:
                best = own
            elif empty:
                best = empty.pop()
        mass[best] += size[v]
        if best != own:
            if mass[own] <= 1e-9:
                mass[own] = 0.0
                empty.append(own)
            of[v], changed = best, True
            for u, _ in beside:
                if of[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
        if at > 4096 and at * 2 > len(queue):
            queue, at = queue[at:], 0
    return changed


def _inside(graph: Adjacency, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, other, weight) of the entries within clusters, and the weight of each node's; made from ``AT_ONCE`` entries at a time."""
    labels, other, weight = of.astype(np.int32), [], []
    cut, many = np.zeros(graph.n), np.zeros(graph.n + 1, np.int64)
    for low, high in _spans(graph.start):
        src = np.repeat(np.arange(low, high), np.diff(graph.start[low : high + 1]))
        at = slice(graph.start[low], graph.start[high])
        same = labels[src] == labels[graph.other[at]]
        src = src[same] - low
        other.append(graph.other[at][same])
        weight.append(graph.weight[at][same])
        cut[low:high] = np.bincount(src, weight[-1], high - low)
        many[low + 1 : high + 1] = np.bincount(src, minlength=high - low)
    return np.cumsum(many), np.concatenate(other), np.concatenate(weight), cut


def _spans(start: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of nodes with ``AT_ONCE`` entries, or one node with more."""
    out, low, n = [], 0, len(start) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(start, start[low] + AT_ONCE, "right")) - 1)
        out.append((low, min(high, n)))
        low = out[-1][1]
    return out


def _refined(graph: Adjacency, size: np.ndarray, of: np.ndarray, factor: float, beta: float, rng: random.Random, names: np.ndarray | None = None) -> np.ndarray:
    """Within each cluster, single nodes join well-connected parts, chosen with probability ~ exp(gain / beta).

    Clusters are refined apart, each in a random order of its nodes: a step takes the next node of every cluster at once, and
    where clusters are few, nodes come one by one, with the same result. A part has the name of its first node, which no longer
    leaves it. The largest of gain / beta plus Gumbel noise is chosen with probability ~ exp(gain / beta); to stay gains nothing.
    The noise of a part is that of a node's first entry in it.
    """
    n, key, names = graph.n, rng.getrandbits(64), np.arange(graph.n) if names is None else names
    start, other, weight, cut = _inside(graph, of)
    total = np.bincount(of, size)[of]
    own = np.bincount(of)
    words = _drawn(key, names)
    order = np.lexsort((words, of))
    words, noise = _mixed(words), np.empty(len(other), np.float32)
    for low, high in _spans(start):
        at = slice(start[low], start[high])
        noise[at] = _gumbel(_mixed(np.repeat(words[low:high], np.diff(start[low : high + 1])) ^ _drawn(key, names[other[at]])))
    stay = _gumbel(_mixed(~words))
    if STEP * own.max() > n:
        return _refined_singly(start, other, weight, noise, stay, cut, size, total, order, factor, beta)
    place = np.arange(n) - np.repeat(np.cumsum(own) - own, own)
    order, ends = order[np.argsort(place, kind="stable")], np.cumsum(np.bincount(place))
    part, mass, alone = np.arange(n), size.copy(), np.ones(n, bool)
    fit = cut >= factor * size * (total - size) - 1e-12  # of a single node this does not change
    for v in np.split(order, ends[:-1]):
        v = v[alone[v] & fit[v]]
        at, k = _ranges(start[v], start[v + 1])
        keys, first, same = np.unique(k * n + part[other[at]], return_index=True, return_inverse=True)
        k, c, w = keys // n, keys % n, np.bincount(same, weight[at], len(keys))
        gain = w - factor * size[v[k]] * mass[c]
        good = (gain >= 0) & (cut[c] >= factor * mass[c] * (total[v[k]] - mass[c]) - 1e-12)
        k, c, w = k[good], c[good], w[good]
        score = gain[good] / beta + noise[at[first[good]]]
        best = np.lexsort((score, k))
        best = best[np.append(k[best][1:] != k[best][:-1], True)] if len(best) else best
        best = best[score[best] > stay[v[k[best]]]]
        v, c, w = v[k[best]], c[best], w[best]
        cut[c] += cut[v] - 2 * w
        mass[c] += size[v]
        part[v], alone[c], alone[v] = c, False, False
    return part


def _refined_singly(start, other, weight, noise, stay, cut, size, total, order, factor: float, beta: float) -> np.ndarray:
    other, weight, noise = (x.tolist() if len(x) <= KEPT else memoryview(x) for x in (other, weight, noise))
    start, stay, cut, size, total = start.tolist(), stay.tolist(), cut.tolist(), size.tolist(), total.tolist()
    part, mass, alone = list(range(len(size))), list(size), [True] * len(size)
    for v in order.tolist():
        if not alone[v] or cut[v] < factor * size[v] * (total[v] - size[v]) - 1e-12:
            continue
        links: dict[int, list[float]] = {}
        low, high = start[v], start[v + 1]
        for u, w, x in zip(other[low:high], weight[low:high], noise[low:high], strict=True):
            c = part[u]
            if c in links:
                links[c][0] += w
            else:
                links[c] = [w, x]
        best, most, joined = v, stay[v], 0.0
        for c, (w, x) in sorted(links.items()):
            gain = w - factor * size[v] * mass[c]
            if gain >= 0 and cut[c] >= factor * mass[c] * (total[v] - mass[c]) - 1e-12:
                score = gain / beta + x
                if score > most or score == most and best != v:
                    best, most, joined = c, score, w
        if best != v:
            cut[best] += cut[v] - 2 * joined
            mass[best] += size[v]
            part[v], alone[best], alone[v] = best, False, False
    return np.array(part)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of ranges one after the other, and the number of each one's range."""
    many = high - low
    k = np.repeat(np.arange(len(many)), many)
    return np.arange(len(k)) + (low - (np.cumsum(many) - many))[k], k


def _aggregated(graph: Adjacency, part: np.ndarray, k: int) -> Adjacency:
    """One node for each part: weights between two parts are summed, those within a part left out; ``AT_ONCE`` entries at a time."""
    order, entries = np.argsort(part, kind="stable"), np.diff(graph.start)
    first = np.searchsorted(part[order], np.arange(k + 1))
    begun = np.concatenate([[0], np.cumsum(entries[order])])[first]
    src, dst, weight = [], [], []
    for low, high in _spans(begun):
        nodes = order[first[low] : first[high]]
        at, own = _ranges(graph.start[nodes], graph.start[nodes + 1])
        keys = part[nodes][own] * k + part[graph.other[at]]
        apart = keys // k != keys % k
        keys, place = np.unique(keys[apart], return_inverse=True)
        src.append((keys // k).astype(np.int32))
        dst.append((keys % k).astype(np.int32))
        weight.append(np.bincount(place, graph.weight[at][apart], len(keys)))
    src, dst, weight = (np.concatenate(x) for x in (src, dst, weight))
    return Adjacency(k, np.searchsorted(src, np.arange(k + 1)), dst, weight, np.bincount(part, graph.degree, k))


def _numbered(of: list[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in of]


def leiden(graph: Adjacency, gamma: float, objective: str = "CPM", iterations: int = 10, beta: float = 0.1, seed: int = 1, initial: np.ndarray | None = None, total: float | None = None, names: np.ndarray | None = None, parts: np.ndarray | None = None) -> np.ndarray:
    """Labels 0, 1, ... of one run. ``modularity``: sizes are degrees and gamma is over the total weight; otherwise CPM.

    All ``iterations`` are run, as igraph does: one that changes nothing may be followed by one that does, since each refines anew.
    An iteration of a component ends when each of its clusters is one node, or its refinement joins none.
    ``total``: the weight of the whole graph, and ``names``: its cells here, if this is a piece of it. ``parts``: its components, if known.
    """
    n = graph.n
    if n == 0:
        return np.zeros(0, np.int32)
    rows, cells = Rows(graph), np.arange(n) if names is None else names
    parts = _components(graph) if parts is None else parts
    if objective == "modularity":
        base_size, factor = graph.degree.tolist(), gamma / ((float(graph.degree.sum()) if total is None else total) or 1.0)
    else:
        base_size, factor = [1.0] * n, gamma
    of = _numbered(initial.tolist()) if initial is not None else list(range(n))
    still = False  # whether no node gains by a move, as an iteration before this one found
    for iteration in range(max(1, iterations)):
        rng = random.Random((int(seed) << 20) + iteration)  # what a level draws does not depend on how many there were before
        level, near, size, nodes, now, named, within = graph, rows, base_size, np.arange(n), list(of), cells, parts
        before, steady, found, live, base = of, still, np.empty(n, np.int64), np.arange(n), 0
        while True:
            order = np.argsort(_drawn(rng.getrandbits(64), named), kind="stable").tolist()
            moved = not (still and level is graph) and _moved(near, size, now, factor, order)
            if level is graph:
                steady = not moved
            held, clusters = np.array(size), np.array(now)
            found[live], base = base + clusters[nodes], base + level.n
            part = _refined(level, held, clusters, factor, beta, rng, named)
            # components go on of which some clusters have several nodes and some nodes were joined
            many = np.bincount(within, minlength=n)
            apart = np.bincount(within[np.unique(clusters, return_index=True)[1]], minlength=n)
            joined = np.bincount(within[np.unique(part)], minlength=n)
            goes = (apart < many) & (joined < many)
            keep = goes[within]
            if not keep.any():
                break
            if not keep.all():
                stays = keep[nodes]
                place = np.cumsum(keep) - 1
                live, nodes = live[stays], place[nodes[stays]]
                level, held, clusters, part, named, within = _kept(level, keep), held[keep], clusters[keep], place[part[keep]], named[keep], within[keep]
            first, part = np.unique(part, return_inverse=True)
            k = len(first)
            nodes, size = part[nodes], np.bincount(part, held, k).tolist()
            named, within = named[first], within[first]
            level, now = _aggregated(level, part, k), _numbered(clusters[first].tolist())
            near = Rows(level)
        of = _numbered(found.tolist())
        still = steady and of == before
    return np.array(of, np.int32)


TASKS = "task int, gamma double, trial int, seed long"
LABELS = "task int, trial int, cell_idx long, label int"


def _in_pieces(graph: Dealt, tasks: DataFrame, handle, schema: str, initial: DataFrame | None = None) -> DataFrame:
    """Calls ``handle(cells, piece, number, runs)`` for each piece, with the (task, gamma, trial, seed, initial) of its runs.

    Where pieces are fewer than cores, each is sent to several tasks, which share the runs. Results do not depend on it.
    Spark would join small partitions to a few tasks: the number of them is given, as the runs take long and not the reading.
    """
    context = tasks.sparkSession.sparkContext
    names = ["task", "gamma", "trial", "seed"]
    rows = sorted(tuple(r) for r in tasks.select(*names).collect())  # one for each run
    slices = max(1, min(len(rows), -(-2 * context.defaultParallelism // max(1, graph.count))))
    at = {(task, trial): k % slices for k, (task, _, trial, _) in enumerate(rows)}
    pieces = graph.pieces.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys, tasks_at_most = ["piece", "slice"], max(1, min(graph.count * slices, 4096))
    pieces = pieces.repartition(tasks_at_most, *keys)
    if initial is None:

        def cold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            cells, piece = _piece(frame)
            return handle(cells, piece, int(key[0]), [(*row, None) for row in rows if at[row[0], row[2]] == key[1]])

        return pieces.groupBy(*keys).applyInPandas(cold, schema)

    where = graph.pieces.where("dst < 0").select(F.col("piece").alias("its_piece"), F.col("src").alias("cell_idx"))
    named = tasks.sparkSession.createDataFrame([(*row, at[row[0], row[2]]) for row in rows], TASKS + ", slice int")
    begun = initial.join(F.broadcast(named), ["task", "trial"]).join(where.hint("shuffle_hash"), "cell_idx")  # one row for each run
    begun = begun.repartition(tasks_at_most, "its_piece", "slice")

    def warm(key: tuple, frame: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        cells, piece = _piece(frame)
        begun = begun.sort_values([*names, "cell_idx"])
        runs = [(*of, own.label.to_numpy()) for of, own in begun.groupby(names, sort=True)]
        return handle(cells, piece, int(key[0]), runs)

    return pieces.groupBy(*keys).cogroup(begun.groupBy("its_piece", "slice")).applyInPandas(warm, schema)


def run_tasks(graph: Adjacency | Dealt, tasks: DataFrame, objective: str, iterations: int, beta: float, initial: DataFrame | None = None) -> DataFrame:
    """(task, trial, cell_idx, label) of task rows (task, gamma, trial, seed).

    ``initial`` (task, trial, cell_idx, label) gives starting labels: they meet their task in one group of the graph's size,
    which a run holds anyway.
    """
    if isinstance(graph, Dealt):
        total = graph.total

        def labelled(cells, piece, number, runs):
            out, parts = [], _components(piece)
            for task, gamma, trial, seed, first in runs:
                labels = leiden(piece, gamma, objective, iterations, beta, int(seed), first, total, cells, parts)
                least = cells[np.unique(labels, return_index=True)[1]]
                out.append(pd.DataFrame({"task": int(task), "trial": int(trial), "cell_idx": cells, "label": least[labels].astype(np.int32)}))
            return pd.concat(out) if out else pd.DataFrame({"task": [], "trial": [], "cell_idx": [], "label": []})

        # clusters have their least cell's number until all pieces meet
        return reindexed(stored(_in_pieces(graph, tasks, labelled, LABELS, initial), "labels"), ["task", "trial"]).select("task", "trial", "cell_idx", "label")
    shared = tasks.sparkSession.sparkContext.broadcast(graph)

    def out(task: int, trial: int, labels: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"task": task, "trial": trial, "cell_idx": np.arange(len(labels), dtype=np.int64), "label": labels})

    if initial is None:

        def run(frames):
            for frame in frames:
                for row in frame.itertuples():
                    yield out(row.task, row.trial, leiden(shared.value, row.gamma, objective, iterations, beta, int(row.seed)))

        return tasks.select("task", "gamma", "trial", "seed").repartition(max(1, min(tasks.count(), 4096)), "task", "trial").mapInPandas(run, LABELS)

    def warm(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.sort_values("cell_idx")
        row = first.iloc[0]
        return out(int(row.task), int(row.trial), leiden(shared.value, float(row.gamma), objective, iterations, beta, int(row.seed), first.label.to_numpy()))

    return tasks.join(initial, ["task", "trial"]).groupBy("task", "trial").applyInPandas(warm, LABELS)


def merged_labels(graph: Adjacency, labels: np.ndarray, min_cluster_size: int) -> np.ndarray:
    """One run's labels after the merging of small clusters, as ``merge.merged`` has it, while they are in one task anyway."""
    k = int(labels.max()) + 1 if len(labels) else 0
    sizes = np.bincount(labels, minlength=k)
    large = np.flatnonzero(sizes >= min_cluster_size)
    if min_cluster_size <= 1 or (sizes[sizes > 0] >= min_cluster_size).all():
        return labels
    if not len(large):
        return np.zeros_like(labels)
    a = labels[np.repeat(np.arange(graph.n), np.diff(graph.start))].astype(np.int64)
    b = labels[graph.other].astype(np.int64)
    cross = (sizes[a] < min_cluster_size) & (sizes[b] >= min_cluster_size)
    keys, at = np.unique(a[cross] * k + b[cross], return_inverse=True)
    mean = np.bincount(at, graph.weight[cross], minlength=len(keys)) / (sizes[keys // k] * sizes[keys % k])
    to, best = np.arange(k), np.zeros(k)
    to[sizes < min_cluster_size] = large[0]
    for key, value in zip(keys.tolist(), mean.tolist(), strict=True):  # ascending ids: the first of equals stays
        if value > best[key // k]:
            best[key // k], to[key // k] = value, key % k
    return to[labels]


def run_probes(graph: Adjacency | Dealt, tasks: DataFrame, objective: str, iterations: int, beta: float, min_cluster_size: int) -> DataFrame:
    """(task, gamma, raw_clusters, effective_clusters, final_clusters) of one run for each task; no labels leave the tasks."""
    if isinstance(graph, Dealt):
        total = graph.total

        def counted(cells, piece, number, runs):
            out, parts = [], _components(piece)
            for task, gamma, trial, seed, _ in runs:
                sizes = np.bincount(leiden(piece, gamma, objective, iterations, beta, int(seed), None, total, cells, parts))
                out.append((task, gamma, trial, int((sizes > 0).sum()), int((sizes >= min_cluster_size).sum())))
            return pd.DataFrame(out, columns=["task", "gamma", "trial", "raw", "effective"])

        found = _in_pieces(graph, tasks, counted, "task int, gamma double, trial int, raw long, effective long")
        found = found.groupBy("task", "gamma", "trial").agg(F.sum("raw").cast("int").alias("raw_clusters"), F.sum("effective").cast("int").alias("effective_clusters"))
        # merging leaves the large clusters, or one if there is none
        return found.drop("trial").withColumn("final_clusters", F.greatest("effective_clusters", F.lit(1)))
    shared = tasks.sparkSession.sparkContext.broadcast(graph)

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                labels = leiden(shared.value, row.gamma, objective, iterations, beta, int(row.seed))
                sizes = np.bincount(labels)
                final = merged_labels(shared.value, labels, min_cluster_size)
                out.append((row.task, row.gamma, int((sizes > 0).sum()), int((sizes >= min_cluster_size).sum()), len(np.unique(final))))
            yield pd.DataFrame(out, columns=["task", "gamma", "raw_clusters", "effective_clusters", "final_clusters"])

    schema = "task int, gamma double, raw_clusters int, effective_clusters int, final_clusters int"
    return tasks.select("task", "gamma", "trial", "seed").repartition(max(1, min(tasks.count(), 4096)), "task").mapInPandas(run, schema)
