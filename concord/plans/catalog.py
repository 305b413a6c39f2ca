"""Queries over the whole tables, one for each operator, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import gamma as G
from concord.functions import rules as R
from concord.operators import counts as C
from concord.operators import graph as N
from concord.operators import merge as M
from concord.operators import similarity as S
from concord.plans import admission as A
from concord.plans import results as V
from concord.plans import search as P
from concord.plans.api import evaluate_consistency
from concord.plans.params import recommended_table
from concord.operators.leiden import TASKS, adjacency, run_tasks
from concord.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums run in another order in another engine: six decimals are compared."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


NOISE = "CASE WHEN (p_partkey*7919 + t*104729) % 97 < 5 THEN (p_partkey*31 + t*17) % 5 ELSE 0 END"
TRIALS = f"""trials AS (
    SELECT t AS trial, p_partkey AS cell_idx, ((p_size + {NOISE}) % 5)::INT AS label
    FROM part, (SELECT unnest(range(1, 9)) AS t))"""
GAMMAS = f"""gt AS (
    SELECT g, t AS trial, p_partkey AS cell_idx, ((p_size + {NOISE}) % g)::INT AS label
    FROM part, (SELECT unnest(range(1, 9)) AS t), (SELECT unnest(range(1, 13)) AS g))"""
MATRIX = f"""{TRIALS},
joint AS (
    SELECT a.trial AS i, b.trial AS j, a.label AS la, b.label AS lb, count(*) AS n
    FROM trials a JOIN trials b ON a.cell_idx = b.cell_idx AND a.trial < b.trial GROUP BY ALL),
cells AS (
    SELECT *, n::DOUBLE / greatest(sum(n) OVER (PARTITION BY i, j, la), sum(n) OVER (PARTITION BY i, j, lb)) AS e FROM joint),
matrix AS (SELECT i, j, sum(n * e) / sum(n) AS ecs FROM cells GROUP BY i, j)"""
OUTCOMES = f"""{MATRIX},
signatures AS (SELECT trial, string_agg(label::VARCHAR, ',' ORDER BY cell_idx) AS sig FROM trials GROUP BY trial),
outcomes AS (
    SELECT row_number() OVER (ORDER BY count(*) DESC, sig) AS outcome_id, count(*)::INT AS n, count(*) / 8.0::DOUBLE AS prob, min(trial) AS rep_trial
    FROM signatures GROUP BY sig)"""
DRAWS = """weights AS (
    SELECT b, 1 + ((b*b*7919 + s*s*104729 + b*s*1299709 + 12345) % 1000003) % 8 AS trial, count(*) AS w
    FROM (SELECT unnest(range(1, 101)) AS b), (SELECT unnest(range(1, 9)) AS s) GROUP BY ALL),
boot AS (
    SELECT b, 64.0 / sum(x.w * y.w * CASE WHEN x.trial = y.trial THEN 1 ELSE m.ecs END) AS ic
    FROM weights x JOIN weights y USING (b) LEFT JOIN matrix m ON m.i = least(x.trial, y.trial) AND m.j = greatest(x.trial, y.trial) GROUP BY b)"""
PLANTED = """half AS (
    SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey // 200 = b.p_partkey // 200 AND a.p_partkey < b.p_partkey
    WHERE (a.p_partkey*7919 + b.p_partkey*104729) % 100 < CASE WHEN a.p_partkey % 10 = b.p_partkey % 10 THEN 50 ELSE 2 END),
edges AS (SELECT a AS src, b AS dst, 1.0::DOUBLE AS weight FROM half UNION ALL SELECT b, a, 1.0::DOUBLE FROM half)"""
COPARTS = """rows_ AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (
    SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::DOUBLE AS weight
    FROM rows_ a JOIN rows_ b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL)"""


def _parts(spark, sf):
    return T.read(spark, sf, "part")


def _trials(spark, sf):
    return T.trials(_parts(spark, sf))


def _patterns(spark, sf):
    return S.patterns(_trials(spark, sf))


def _matrix(spark, sf):
    return S.similarity_matrix(_patterns(spark, sf))


def _labels_ab(spark, sf):
    return _parts(spark, sf).select(F.col("p_partkey").alias("cell_idx"), "p_brand", "p_type")


AB = """ab AS (SELECT p_partkey AS cell_idx, count(*) OVER (PARTITION BY p_brand, p_type)::DOUBLE
    / greatest(count(*) OVER (PARTITION BY p_brand), count(*) OVER (PARTITION BY p_type)) AS ecs FROM part)"""


@query(f"WITH {AB} SELECT cell_idx, round(ecs, 6) AS ecs FROM ab")
def ecs_elements(spark, sf):
    return rounded(S.element_similarity(_labels_ab(spark, sf), "p_brand", "p_type"), "ecs")


@query(f"WITH {AB} SELECT round(avg(ecs), 6) AS ecs FROM ab")
def ecs_scalar(spark, sf):
    return rounded(S.scalar_similarity(_labels_ab(spark, sf), "p_brand", "p_type"), "ecs")


@query(f"WITH {MATRIX} SELECT i, j, round(ecs, 6) AS ecs FROM matrix")
def ecs_matrix(spark, sf):
    return rounded(_matrix(spark, sf), "ecs")


@query(f"WITH {OUTCOMES} SELECT outcome_id::INT AS outcome_id, n, prob, rep_trial FROM outcomes")
def clustering_outcomes(spark, sf):
    return S.outcomes(_patterns(spark, sf))


@query(f"WITH {MATRIX} SELECT round((8 + 2 * sum(ecs)) / 64, 6) AS ic_raw, round(64 / (8 + 2 * sum(ecs)), 6) AS ic FROM matrix")
def ic_score(spark, sf):
    return rounded(S.raw_consistency(_matrix(spark, sf), 8), "ic_raw", "ic")


@query(f"""WITH {MATRIX},
per AS (SELECT a.cell_idx, sum(c.e) AS s FROM trials a JOIN trials b ON a.cell_idx = b.cell_idx AND a.trial < b.trial
    JOIN cells c ON c.i = a.trial AND c.j = b.trial AND c.la = a.label AND c.lb = b.label GROUP BY a.cell_idx)
SELECT cell_idx, round((8 + 2 * s) / 64, 6) AS mei FROM per""")
def mei_scores(spark, sf):
    return rounded(S.element_consistency(_trials(spark, sf), _patterns(spark, sf)), "mei")


@query(f"""WITH {OUTCOMES},
both_ AS (SELECT i, j, ecs FROM matrix UNION ALL SELECT j, i, ecs FROM matrix UNION ALL SELECT trial, trial, 1.0 FROM signatures),
totals AS (SELECT o.outcome_id, o.rep_trial, sum(m.ecs) AS total FROM outcomes o JOIN both_ m ON m.i = o.rep_trial JOIN outcomes q ON q.rep_trial = m.j GROUP BY ALL)
SELECT outcome_id::INT AS outcome_id, rep_trial, round(total, 6) AS total FROM totals ORDER BY round(totals.total, 12) DESC, outcome_id LIMIT 1""")
def best_clustering(spark, sf):
    return rounded(S.best_outcome(S.outcomes(_patterns(spark, sf)), _matrix(spark, sf)), "total")


def _draw(b, s):
    return (b * b * 7919 + s * s * 104729 + b * s * 1299709 + 12345) % 1000003 % 8


def _boot(spark, sf):
    return S.bootstrap(_matrix(spark, sf), S.bootstrap_weights(spark, 100, 8, _draw), 8)


@query(f"WITH {MATRIX}, {DRAWS} SELECT b, round(ic, 6) AS ic FROM boot")
def bootstrap_ic(spark, sf):
    return rounded(_boot(spark, sf), "ic")


@query(f"WITH {MATRIX}, {DRAWS} SELECT round(median(ic), 6) AS ic_median, round(quantile_cont(ic, 0.025), 6) AS ic_ci_lower, round(quantile_cont(ic, 0.975), 6) AS ic_ci_upper FROM boot")
def bootstrap_ci(spark, sf):
    return rounded(S.interval(_boot(spark, sf)), "ic_median", "ic_ci_lower", "ic_ci_upper")


@query(f"WITH {TRIALS} SELECT trial, cell_idx, (dense_rank() OVER (PARTITION BY trial ORDER BY label) - 1)::INT AS label FROM (SELECT trial, cell_idx, label * 3 + 7 AS label FROM trials)")
def label_reindex(spark, sf):
    return C.reindexed(_trials(spark, sf).withColumn("label", F.col("label") * 3 + 7), ["trial"])


@query(f"""WITH {TRIALS}, f AS (SELECT *, min(cell_idx) OVER (PARTITION BY trial, label) AS first FROM trials)
SELECT trial, cell_idx, dense_rank() OVER (PARTITION BY trial ORDER BY first)::INT AS label FROM f""")
def label_compact(spark, sf):
    return C.compacted(_trials(spark, sf), ["trial"])


COUNTS = f"""{GAMMAS}, sizes AS (SELECT g, trial, label, count(*) AS size FROM gt GROUP BY ALL),
counts AS (SELECT g, trial, count(*)::INT AS raw_clusters, count(*) FILTER (size >= 0.11 * (SELECT count(*) FROM part))::INT AS effective_clusters FROM sizes GROUP BY ALL)"""


def _counts(spark, sf):
    parts = _parts(spark, sf)
    least = -(-parts.count() * 11 // 100)
    return C.cluster_counts(T.gamma_trials(parts), ["g", "trial"], least)


@query(f"WITH {COUNTS} SELECT * FROM counts")
def cluster_counts(spark, sf):
    return _counts(spark, sf)


@query(f"""WITH {COUNTS} SELECT g, median(raw_clusters) AS raw_clusters_median, trunc(median(raw_clusters))::INT AS raw_clusters_median_int,
median(effective_clusters) AS effective_clusters_median, trunc(median(effective_clusters))::INT AS effective_clusters_median_int FROM counts GROUP BY g""")
def gamma_medians(spark, sf):
    return C.count_medians(_counts(spark, sf), ["g"], ["raw_clusters", "effective_clusters"])


@query(f"""WITH {COUNTS} SELECT target, g, count(*) FILTER (effective_clusters = target)::INT AS hit_count, count(*) FILTER (effective_clusters = target) / 8.0::DOUBLE AS hit_rate
FROM counts, (SELECT unnest(range(1, 13))::INT AS target) GROUP BY target, g""")
def hit_counts(spark, sf):
    return C.hit_counts(_counts(spark, sf), spark.range(1, 13).select(F.col("id").cast("int").alias("target")), ["g"], "effective_clusters")


@query(f"WITH {PLANTED} SELECT * FROM edges")
def planted_graph(spark, sf):
    return T.planted_blocks(_parts(spark, sf)).edges


@query(f"WITH {COPARTS} SELECT * FROM edges")
def co_part_graph(spark, sf):
    return T.co_parts(T.read(spark, sf, "lineitem"))


@query(f"""WITH {COPARTS} SELECT (SELECT count(*) FROM part) AS n_cells, count(*) AS n_entries, round((1 - count(*) / ((SELECT count(*) FROM part)::DOUBLE ** 2)) * 100, 6) AS sparsity_percent,
min(weight) AS min_weight, max(weight) AS max_weight, round(avg(weight), 6) AS mean_weight, median(weight) AS median_weight FROM edges""")
def graph_profile(spark, sf):
    return rounded(N.profile(T.co_parts(T.read(spark, sf, "lineitem")), _parts(spark, sf).count()), "sparsity_percent", "mean_weight")


@query("""SELECT l_partkey AS src, l_orderkey AS dst, sum(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY ALL""")
def csc_to_edges(spark, sf):
    entries = T.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("col"), F.col("l_partkey").alias("row")).agg(F.sum("l_quantity").alias("value"))
    within = F.row_number().over(_window("col", "row")) - 1
    pointers = N.column_ranges(entries.groupBy("col").agg(F.count(F.lit(1)).alias("n")))
    placed = entries.withColumn("within", within).join(pointers, "col").select("row", "value", (F.col("start") + F.col("within")).alias("pos"))
    return N.from_columns(placed, pointers)


def _window(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)


@query("""WITH scored AS (
    SELECT a.vec_id AS src, b.vec_id AS dst, CASE WHEN a.vec_id = b.vec_id THEN 1e9 ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END AS s FROM embeddings a, embeddings b),
near AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM scored) WHERE r <= 20),
shared AS (SELECT a.src, b.src AS dst, count(*) AS s FROM near a JOIN near b ON a.dst = b.dst GROUP BY ALL)
SELECT src, dst, round(s / (40.0::DOUBLE - s), 6) AS weight FROM shared WHERE s / (40.0::DOUBLE - s) >= 1 / 15.0::DOUBLE""")
def snn_graph(spark, sf):
    vectors = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(N.shared_neighbours(N.nearest_exact(vectors, 20), 20), "weight")


#: Clusters of three among ten large ones, on the graph of all orders.
SMALL = f"""{COPARTS},
labels AS (SELECT p_partkey AS cell_idx, 1 AS trial, (CASE WHEN p_partkey % 37 = 0 THEN 20 + p_partkey // 111 ELSE p_partkey % 10 END)::INT AS label FROM part),
sizes AS (SELECT label, count(*) AS size FROM labels GROUP BY label),
small AS (SELECT label AS small, size AS n_small FROM sizes WHERE size < 5), large AS (SELECT label AS large, size AS n_large FROM sizes WHERE size >= 5),
w AS (SELECT a.label AS small, b.label AS large, sum(weight) AS w FROM edges JOIN labels a ON a.cell_idx = src JOIN labels b ON b.cell_idx = dst GROUP BY ALL),
conn AS (SELECT small, large, coalesce(w, 0) / (n_small * n_large) AS mean_weight FROM small CROSS JOIN large LEFT JOIN w USING (small, large))"""


def _small_labels(spark, sf):
    key = F.col("p_partkey")
    label = F.when(key % 37 == 0, 20 + F.floor(key / 111)).otherwise(key % 10).cast("int")
    return _parts(spark, sf).select(F.lit(1).alias("trial"), key.alias("cell_idx"), label.alias("label"))


@query(f"WITH {SMALL} SELECT 1 AS trial, small, large, round(mean_weight, 6) AS mean_weight FROM conn")
def small_cluster_connectivity(spark, sf):
    return rounded(M.connectivity(T.co_parts(T.read(spark, sf, "lineitem")), _small_labels(spark, sf), 5, ["trial"]), "mean_weight")


@query(f"""WITH {SMALL},
best AS (SELECT small, large FROM (SELECT *, row_number() OVER (PARTITION BY small ORDER BY mean_weight DESC, large) AS r FROM conn) WHERE r = 1),
moved AS (SELECT trial, cell_idx, coalesce(large, label) AS label FROM labels LEFT JOIN best ON small = label)
SELECT trial, cell_idx, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label FROM moved""")
def merge_small_clusters(spark, sf):
    return M.merged(T.co_parts(T.read(spark, sf, "lineitem")), _small_labels(spark, sf), 5, ["trial"])


QUALITY = f"{COPARTS}, {TRIALS}, inside AS (SELECT a.trial, sum(weight) AS w FROM edges JOIN trials a ON a.cell_idx = src JOIN trials b ON b.cell_idx = dst AND a.trial = b.trial AND a.label = b.label GROUP BY a.trial)"


@query(f"""WITH {QUALITY}, sq AS (SELECT trial, sum(n * n) AS s FROM (SELECT trial, label, count(*) AS n FROM trials GROUP BY ALL) GROUP BY trial)
SELECT trial, round(w - 0.01::DOUBLE * s, 6) AS quality FROM inside JOIN sq USING (trial)""")
def cpm_quality(spark, sf):
    return rounded(N.cpm_quality(T.co_parts(T.read(spark, sf, "lineitem")), _trials(spark, sf), 0.01, ["trial"]), "quality")


@query(f"""WITH {QUALITY}, total AS (SELECT sum(weight) AS t FROM edges), deg AS (SELECT src, sum(weight) AS k FROM edges GROUP BY src),
sq AS (SELECT trial, sum((k / t) * (k / t)) AS s FROM (SELECT trial, label, sum(k) AS k FROM deg JOIN trials ON cell_idx = src GROUP BY ALL), total GROUP BY trial)
SELECT trial, round(w / t - s, 6) AS quality FROM inside JOIN sq USING (trial), total""")
def modularity_quality(spark, sf):
    return rounded(N.modularity_quality(T.co_parts(T.read(spark, sf, "lineitem")), _trials(spark, sf), 1.0, ["trial"]), "quality")


GRID_KR = "kr AS (SELECT k::INT AS k, raw::INT AS raw, (raw % 7)::INT AS eff FROM (SELECT unnest(range(1, 121)) AS k), (SELECT unnest(range(1, 201)) AS raw))"
UPPER = "CASE WHEN k <= 10 THEN k + 1 ELSE greatest(k + 2, ceil(k * 1.05::DOUBLE)) END"


def _kr(spark):
    return spark.range(1, 121).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("raw")).withColumn("eff", F.col("raw") % 7)


@query(f"""WITH {GRID_KR} SELECT k, raw, greatest(k + 3, ceil(k * 1.1::DOUBLE))::BIGINT AS soft_limit, greatest(k + 5, ceil(k * 1.5::DOUBLE))::BIGINT AS hard_limit, ({UPPER})::BIGINT AS search_upper,
k <= 1 OR raw <= greatest(k + 3, ceil(k * 1.1::DOUBLE)) AS passes_soft, k <= 1 OR raw <= greatest(k + 5, ceil(k * 1.5::DOUBLE)) AS passes_hard FROM kr""")
def guard_flags(spark, sf):
    k, raw = F.col("k"), F.col("raw")
    return _kr(spark).select("k", "raw", R.soft_limit(k).cast("long").alias("soft_limit"), R.hard_limit(k).cast("long").alias("hard_limit"), R.search_upper(k).cast("long").alias("search_upper"), R.passes_guard(raw, k, 2).alias("passes_soft"), R.passes_guard(raw, k, 2, hard=True).alias("passes_hard"))


@query(f"""WITH {GRID_KR}, s AS (SELECT *, raw < k AS below, raw >= k AND NOT (k <= 1 OR raw <= {UPPER}) AS above, eff >= k AS met FROM kr)
SELECT k, raw, eff, CASE WHEN below THEN 'raw_below' WHEN above THEN 'raw_above_soft' ELSE 'raw_in_band' END AS raw_class, NOT below AND NOT met AS over_fragmented,
CASE WHEN below THEN 'increase_gamma' ELSE 'decrease_gamma' END AS lower_action, CASE WHEN below OR (NOT above AND met) THEN 'increase_gamma' ELSE 'decrease_gamma' END AS upper_action FROM s""")
def search_state(spark, sf):
    return _kr(spark).select("k", "raw", "eff", R.search_state(F.col("raw"), F.col("eff"), F.col("k"), 2).alias("s")).select("k", "raw", "eff", "s.*")


@query(f"WITH {GRID_KR} SELECT k, raw, eff, eff = 0 AND k = 1 AND raw >= 0.98::DOUBLE * 150 AS degenerate FROM kr")
def degenerate_flags(spark, sf):
    return _kr(spark).select("k", "raw", "eff", R.degenerate(F.col("raw"), F.col("eff"), F.col("k"), 150).alias("degenerate"))


@query("SELECT i::INT AS i, round(exp(ln(1e-8::DOUBLE) + (ln(0.5::DOUBLE) - ln(1e-8::DOUBLE)) * i / 10.0::DOUBLE), 12) AS gamma FROM (SELECT unnest(range(0, 11)) AS i)")
def gamma_grid_log(spark, sf):
    values = G.grid(1e-8, 0.5, "CPM", 1e-8)
    return spark.createDataFrame(list(enumerate(values)), "i int, gamma double").withColumn("gamma", F.round("gamma", 12))


@query("SELECT i::INT AS i, round(-13 + 33 * i / 10.0::DOUBLE, 9) AS gamma FROM (SELECT unnest(range(0, 11)) AS i)")
def gamma_grid_linear(spark, sf):
    values = G.grid(-13.0, 20.0, "modularity", 1e-8)
    return spark.createDataFrame(list(enumerate(values)), "i int, gamma double").withColumn("gamma", F.round("gamma", 9))


@query("SELECT i::INT AS i, round(least(1e-8::DOUBLE * 4 ** i, 1.0), 15) AS gamma FROM (SELECT unnest(range(0, 8)) AS i)")
def discovery_batch(spark, sf):
    values = G.discovery_batch(1e-8, 1.0, 8)
    return spark.createDataFrame(list(enumerate(values)), "i int, gamma double").withColumn("gamma", F.round("gamma", 15))


#: Probes: gammas from the parts' sizes; counts rise with gamma, with dips.
PROBES = "probes AS (SELECT p_size / 100.0::DOUBLE AS gamma, (1 + p_size // 4 + CASE WHEN p_size % 5 = 0 THEN -1 ELSE 0 END + CASE WHEN p_size % 11 = 0 THEN 2 ELSE 0 END)::INT AS final_clusters, (2 + p_size // 3)::INT AS raw_clusters FROM (SELECT DISTINCT p_size FROM part))"
TARGETS = "targets AS (SELECT unnest(range(1, 21))::INT AS target)"


def _probes(spark, sf):
    size = F.col("p_size")
    final = 1 + F.floor(size / 4) + F.when(size % 5 == 0, -1).otherwise(0) + F.when(size % 11 == 0, 2).otherwise(0)
    return _parts(spark, sf).select("p_size").distinct().select((size / 100).alias("gamma"), final.cast("int").alias("final_clusters"), (2 + F.floor(size / 3)).cast("int").alias("raw_clusters"))


def _targets(spark):
    return spark.range(1, 21).select(F.col("id").cast("int").alias("target"))


STABLE = f"{PROBES}, stable AS (SELECT *, max(final_clusters) OVER (ORDER BY gamma) AS s, lag(gamma) OVER (ORDER BY gamma) AS before_, lead(gamma) OVER (ORDER BY gamma) AS after_ FROM probes)"
INTERVALS = f"""{STABLE}, {TARGETS},
agg AS (SELECT target, min(gamma) FILTER (s = target) AS e0, max(gamma) FILTER (s = target) AS e1, min(coalesce(before_, gamma)) FILTER (s = target) AS w0, max(coalesce(after_, gamma)) FILTER (s = target) AS w1,
    max(gamma) FILTER (s < target) AS below, min(gamma) FILTER (s > target) AS above, list_sort(list(DISTINCT gamma) FILTER (s = target)) AS exact_gammas, list_sort(list(DISTINCT gamma) FILTER (abs(s - target) <= 1)) AS near_gammas
    FROM targets, stable GROUP BY target),
bounds AS (SELECT *, below IS NOT NULL AND above IS NOT NULL AND below < above AS between_,
    CASE WHEN e0 IS NOT NULL THEN CASE WHEN e0 = e1 THEN w0 ELSE e0 END WHEN below < above THEN below END AS gamma_left,
    CASE WHEN e0 IS NOT NULL THEN CASE WHEN e0 = e1 THEN w1 ELSE e1 END WHEN below < above THEN above END AS gamma_right FROM agg),
intervals AS (SELECT target, gamma_left, gamma_right, gamma_left IS NOT NULL AS bracketed, e0 IS NOT NULL AS optimization_ready,
    CASE WHEN e0 IS NULL THEN coalesce(gamma_left, CASE WHEN below IS NOT NULL AND (above IS NULL OR between_) THEN below ELSE 0.001::DOUBLE END) END AS open_left,
    CASE WHEN e0 IS NULL THEN coalesce(gamma_right, CASE WHEN above IS NOT NULL AND (below IS NULL OR between_) THEN above ELSE 2.0::DOUBLE END) END AS open_right,
    coalesce(exact_gammas, []) AS exact_gammas, coalesce(near_gammas, []) AS near_gammas FROM bounds)"""


def _intervals(spark, sf):
    return P.target_intervals(_probes(spark, sf), _targets(spark), 0.001, 2.0)


@query(f"WITH {STABLE} SELECT gamma, final_clusters, s AS stable FROM stable")
def monotone_counts(spark, sf):
    return P.monotone(_probes(spark, sf)).select("gamma", "final_clusters", "stable")


@query(f"WITH {INTERVALS} SELECT target, gamma_left, gamma_right, bracketed, optimization_ready, open_left, open_right, len(exact_gammas)::INT AS n_exact, len(near_gammas)::INT AS n_near FROM intervals")
def target_intervals(spark, sf):
    return _intervals(spark, sf).select("target", "gamma_left", "gamma_right", "bracketed", "optimization_ready", "open_left", "open_right", F.size("exact_gammas").alias("n_exact"), F.size("near_gammas").alias("n_near"))


@query(f"""WITH {INTERVALS}, wide AS (SELECT target, least(open_left, open_right) AS l, greatest(open_left, open_right) AS r FROM intervals WHERE NOT optimization_ready AND open_left <> open_right),
ranked AS (SELECT *, ln(r) - ln(l) AS width, row_number() OVER (ORDER BY ln(r) - ln(l) DESC, target) AS place, count(*) OVER () AS n FROM wide),
sized AS (SELECT *, least(8, greatest(1, 12 // n)) AS most FROM ranked),
pts AS (SELECT *, 1 + least((least(greatest(12 - n, 0), n * (most - 1)) // n) + CASE WHEN place <= least(greatest(12 - n, 0), n * (most - 1)) % n THEN 1 ELSE 0 END, most - 1) AS points FROM sized),
probes2 AS (SELECT target, width, points, exp(ln(l) + i / (points + 1.0::DOUBLE) * width) AS gamma FROM (SELECT *, unnest(range(1, points + 1)) AS i FROM pts))
SELECT target, round(width, 6) AS width, points::INT AS points, round(gamma, 9) AS gamma FROM (SELECT *, row_number() OVER (PARTITION BY gamma ORDER BY width DESC, target) AS rn FROM probes2) WHERE rn = 1""")
def refinement_plan(spark, sf):
    open_ = _intervals(spark, sf).where("not optimization_ready").select("target", "open_left", "open_right")
    return P.refinement_plan(open_, _probes(spark, sf), True, 1e-8, 12).withColumns({"width": F.round("width", 6), "gamma": F.round("gamma", 9)})


@query(f"""WITH {PROBES}, {TARGETS}, st AS (SELECT target, gamma, max(raw_clusters) OVER (PARTITION BY target ORDER BY gamma) AS s, lead(gamma) OVER (PARTITION BY target ORDER BY gamma) AS ng FROM targets, probes),
nx AS (SELECT *, lead(s) OVER (PARTITION BY target ORDER BY gamma) AS ns FROM st),
agg AS (SELECT target, min(gamma) FILTER (s = target) AS e0, max(gamma) FILTER (s = target) AS e1, arg_min(gamma, (ng - gamma, gamma)) FILTER (s < target AND ns > target) AS p0, arg_min(ng, (ng - gamma, gamma)) FILTER (s < target AND ns > target) AS p1,
    min(gamma) FILTER (abs(s - target) <= 1) AS n0, max(gamma) FILTER (abs(s - target) <= 1) AS n1, min(gamma) AS a0, max(gamma) AS a1 FROM nx GROUP BY target)
SELECT target, coalesce(e0, p0, n0, a0) AS gamma_left, coalesce(e1, p1, n1, a1) AS gamma_right, CASE WHEN e0 IS NOT NULL THEN 'raw_exact' WHEN p0 IS NOT NULL THEN 'raw_bracket' WHEN n0 IS NOT NULL THEN 'raw_near_target' ELSE 'coarse' END AS clamp_mode FROM agg""")
def plateau_clamp(spark, sf):
    curve = _targets(spark).join(F.broadcast(_probes(spark, sf).select("gamma", F.col("raw_clusters").alias("raw_median"))))
    return P.plateau_clamp(curve, [])


@query(f"""WITH {INTERVALS}, base AS (SELECT target, gamma_left, gamma_right, exact_gammas, near_gammas, list_distinct(list_concat([gamma_left, gamma_right], exact_gammas, near_gammas)) AS seeds FROM intervals WHERE bracketed),
sel AS (SELECT target, arg_min(g, (abs(g - (gamma_left + gamma_right) / 2), g)) AS g FROM (SELECT *, unnest(seeds) AS g FROM base) GROUP BY target),
roles AS (SELECT target, gamma_left AS gamma, 'left' AS seed_role FROM base UNION SELECT target, gamma_right, 'right' FROM base UNION SELECT target, g, 'selected' FROM sel
    UNION SELECT target, unnest(exact_gammas), 'exact' FROM base UNION SELECT target, unnest(near_gammas), 'near' FROM base UNION SELECT target, unnest(seeds), 'seed' FROM base)
SELECT target, roles.gamma, seed_role, final_clusters, raw_clusters FROM roles LEFT JOIN probes ON abs(roles.gamma - probes.gamma) <= 1.5e-8""")
def seed_table_nearest(spark, sf):
    return A.seed_table(_intervals(spark, sf), _probes(spark, sf))


SEEDS = "seeds AS (SELECT (1 + p_partkey % 5)::INT AS target, (p_size % 20) / 20.0::DOUBLE AS gamma, CASE p_partkey % 7 WHEN 0 THEN 'selected' WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'exact' WHEN 4 THEN 'near' WHEN 5 THEN 'seed' ELSE 'other' END AS seed_role FROM part)"


@query(f"""WITH {SEEDS}, d AS (SELECT DISTINCT *, CASE seed_role WHEN 'selected' THEN 1 WHEN 'left' THEN 2 WHEN 'right' THEN 2 WHEN 'exact' THEN 3 WHEN 'near' THEN 4 WHEN 'seed' THEN 5 ELSE 99 END AS priority FROM seeds WHERE gamma BETWEEN 0.1::DOUBLE - 1e-12 AND 0.8::DOUBLE + 1e-12)
SELECT target, gamma, seed_role, priority, row_number() OVER (PARTITION BY target ORDER BY gamma, priority, seed_role)::INT AS place FROM d""")
def seed_dedup(spark, sf):
    key = F.col("p_partkey")
    role = F.element_at(F.array(*[F.lit(x) for x in ("selected", "left", "right", "exact", "near", "seed", "other")]), (key % 7 + 1).cast("int"))
    seeds = _parts(spark, sf).select((1 + key % 5).cast("int").alias("target"), (F.col("p_size") % 20 / 20).alias("gamma"), role.alias("seed_role"), F.lit(0.1).alias("gamma_left"), F.lit(0.8).alias("gamma_right"))
    return A.normalised_seeds(seeds)


@query("""WITH v AS (SELECT DISTINCT p_size / 10.0::DOUBLE AS g FROM part), r AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM v),
pos AS (SELECT DISTINCT round_even(k * ((SELECT max(n) FROM r) - 1) / 7.0::DOUBLE, 0)::BIGINT AS i FROM (SELECT unnest(range(0, 8)) AS k))
SELECT g AS gamma FROM r JOIN pos USING (i)""")
def even_spacing(spark, sf):
    values = [r.gamma for r in _parts(spark, sf).select((F.col("p_size") / 10).alias("gamma")).distinct().collect()]  # sizes: fifty values
    return spark.createDataFrame([(v,) for v in G.evenly_selected(values, 8)], "gamma double")


EVALS = """evals AS (
    SELECT (1 + s_nationkey)::INT AS target, s_suppkey AS id, s_suppkey / 1000.0::DOUBLE AS gamma, (1 + s_nationkey + (s_suppkey % 4) - 1.5::DOUBLE) AS raw_median,
        (1 + s_nationkey + (s_suppkey % 3) - 1 + (s_suppkey % 2) * 0.5::DOUBLE) AS final_median, (s_suppkey % 3)::INT AS hit_count, (s_suppkey % 5)::INT AS raw_hit_count, 1 + (s_suppkey % 9) / 100.0::DOUBLE AS ic FROM supplier),
flags AS (SELECT *, abs(final_median - target) AS median_gap, abs(raw_median - target) AS raw_median_gap, trunc(final_median) = target AS st, hit_count > 0 AND abs(final_median - target) <= 1 AS re, trunc(raw_median) = target AS rs,
    raw_hit_count > 0 AND abs(raw_median - target) <= 1 AS rr, target <= 1 OR raw_median <= greatest(target + 3, ceil(target * 1.1::DOUBLE)) AS so, target <= 1 OR raw_median <= greatest(target + 5, ceil(target * 1.5::DOUBLE)) AS ha FROM evals),
fam AS (SELECT *, list_filter([CASE WHEN rs AND so THEN 0 END, CASE WHEN st AND so THEN 1 END, CASE WHEN re AND so THEN 2 END, CASE WHEN st AND ha THEN 3 END, CASE WHEN re AND ha THEN 4 END, CASE WHEN re THEN 5 END,
    CASE WHEN rr AND so THEN 6 END, CASE WHEN rr AND ha THEN 7 END, CASE WHEN rr THEN 8 END], lambda x: x IS NOT NULL) AS f FROM flags),
first_ AS (SELECT *, min(list_min(f)) OVER (PARTITION BY target) AS m FROM fam),
adm AS (SELECT *, ['raw_strict_soft','strict_soft','relaxed_soft','strict_hard','relaxed_hard','relaxed_unguarded','raw_relaxed_soft','raw_relaxed_hard','raw_relaxed_unguarded'][m + 1] AS admission_mode FROM first_ WHERE list_contains(f, m)),
near AS (SELECT * FROM (SELECT *, min(raw_median_gap) OVER (PARTITION BY target) AS least_gap FROM adm) WHERE raw_median_gap = least_gap),
hits AS (SELECT * FROM (SELECT *, max(hit_count) OVER (PARTITION BY target) AS mh FROM near) WHERE starts_with(admission_mode, 'raw_') OR mh = 0 OR hit_count > 0)"""


def _evals(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = T.read(spark, sf, "supplier").select(
        (1 + n).cast("int").alias("target"), k.alias("id"), (k / 1000).alias("gamma"), (1 + n + k % 4 - F.lit(1.5)).alias("raw_median"), (1 + n + k % 3 - 1 + (k % 2) * F.lit(0.5)).alias("final_median"),
        (k % 3).cast("int").alias("hit_count"), (k % 5).cast("int").alias("raw_hit_count"), (1 + (k % 9) / 100).alias("ic"),
    )
    return A.evaluated(rows, 2)


@query(f"WITH {EVALS} SELECT target, id, admission_mode FROM adm")
def admission_ladder(spark, sf):
    return A.admitted(_evals(spark, sf)).select("target", "id", "admission_mode")


@query(f"WITH {EVALS} SELECT target, id, raw_median_gap FROM near")
def raw_gap_refine(spark, sf):
    return A.nearest_raw(A.admitted(_evals(spark, sf)), 2).select("target", "id", "raw_median_gap")


@query(f"WITH {EVALS} SELECT target, id, hit_count FROM hits")
def exact_hit_priority(spark, sf):
    return A.exact_hits_first(A.nearest_raw(A.admitted(_evals(spark, sf)), 2)).select("target", "id", "hit_count")


@query(f"WITH {EVALS} SELECT target, id, gamma, round(ic, 6) AS ic FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(ic, 12), gamma) AS r FROM hits) WHERE r = 1")
def best_gamma(spark, sf):
    return rounded(A.best_gamma(A.exact_hits_first(A.nearest_raw(A.admitted(_evals(spark, sf)), 2))).select("target", "id", "gamma", "ic"), "ic")


GIC = f"""{GAMMAS}, joint AS (SELECT a.g, a.trial AS i, b.trial AS j, a.label AS la, b.label AS lb, count(*) AS n FROM gt a JOIN gt b ON a.g = b.g AND a.cell_idx = b.cell_idx AND a.trial < b.trial GROUP BY ALL),
cells AS (SELECT *, n::DOUBLE / greatest(sum(n) OVER (PARTITION BY g, i, j, la), sum(n) OVER (PARTITION BY g, i, j, lb)) AS e FROM joint),
gic AS (SELECT g, 64 / (8 + 2 * sum(ecs)) AS ic FROM (SELECT g, i, j, sum(n * e) / sum(n) AS ecs FROM cells GROUP BY ALL) GROUP BY g)"""


def _gamma_ic(spark, sf):
    found = S.patterns(T.gamma_trials(_parts(spark, sf)), ["g"])
    return S.raw_consistency(S.similarity_matrix(found, ["g"]), 8, ["g"]).select("g", "ic")


@query(f"WITH {GIC} SELECT (1 + g // 3)::INT AS target, round(min(ic), 6) AS least_ic, min(ic) >= 1.15::DOUBLE AS excluded FROM gic GROUP BY 1")
def prefilter_targets(spark, sf):
    targets = _gamma_ic(spark, sf).select((1 + F.floor(F.col("g") / 3)).cast("int").alias("target"), "ic")
    return rounded(A.prefiltered(targets, 1.15), "least_ic")


@query(f"""WITH {EVALS}, c AS (SELECT target, gamma, ic, id % 4 = 0 AS stable, CASE WHEN target % 2 = 0 THEN 4 ELSE 2 END AS most FROM evals),
p AS (SELECT *, round(ic, 12) AS r, quantile_cont(round(ic, 12), 0.5) OVER (PARTITION BY target) AS middle, row_number() OVER (PARTITION BY target ORDER BY round(ic, 12), gamma) = 1 AS best,
    stable AND row_number() OVER (PARTITION BY target ORDER BY stable DESC, round(ic, 12), gamma) = 1 AS steady FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY best DESC, steady DESC, r, gamma) AS place FROM p WHERE r <= middle OR stable OR best)
SELECT target, gamma, round(ic, 6) AS ic, stable FROM k WHERE place <= most""")
def refinement_keep(spark, sf):
    rows = _evals(spark, sf).select("target", "gamma", "ic", (F.col("id") % 4 == 0).alias("stable"), F.when(F.col("target") % 2 == 0, 4).otherwise(2).alias("limit"))
    return rounded(A.kept_candidates(rows).select("target", "gamma", "ic", "stable"), "ic")


RES = "res AS (SELECT s_suppkey::INT AS source_target, s_suppkey / 100.0::DOUBLE AS gamma, (2 + s_suppkey % 7)::INT AS final_clusters, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 1 + (s_suppkey * 37 % 101) / 1000.0::DOUBLE END AS ic, s_suppkey % 5 = 0 AS excluded, CASE WHEN s_suppkey % 5 = 0 THEN 'high_inconsistency' ELSE 'none' END AS why FROM supplier)"
REKEYED = f"""{RES}, rk AS (SELECT source_target, gamma, final_clusters, ic, excluded, NOT excluded AND row_number() OVER (PARTITION BY excluded, final_clusters ORDER BY ic NULLS LAST, source_target, gamma) = 1 AS selected_main_result, why FROM res),
rekeyed AS (SELECT source_target, gamma, final_clusters, ic, excluded, selected_main_result, CASE WHEN excluded THEN why WHEN selected_main_result THEN 'none' ELSE 'deduplicated' END AS exclusion_reason FROM rk)"""


def _rekeyed(spark, sf):
    k = F.col("s_suppkey")
    rows = T.read(spark, sf, "supplier").select(
        k.cast("int").alias("source_target"), (k / 100).alias("gamma"), (2 + k % 7).cast("int").alias("final_clusters"), F.when(k % 13 != 0, 1 + (k * 37 % 101) / 1000).alias("ic"),
        (k % 5 == 0).alias("excluded"), F.when(k % 5 == 0, "high_inconsistency").otherwise("none").alias("exclusion_reason"),
    )
    return V.rekeyed(rows)


@query(f"WITH {REKEYED} SELECT source_target, gamma, final_clusters, round(ic, 6) AS ic, excluded, selected_main_result, exclusion_reason FROM rekeyed")
def rekey_results(spark, sf):
    return rounded(_rekeyed(spark, sf), "ic").select("source_target", "gamma", "final_clusters", "ic", "excluded", "selected_main_result", "exclusion_reason")


@query(f"""WITH {REKEYED}, {INTERVALS},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_target ORDER BY CASE WHEN selected_main_result THEN 1 WHEN NOT excluded THEN 2 ELSE 3 END, ic NULLS LAST, gamma NULLS LAST) AS r FROM rekeyed) WHERE r = 1),
odd AS (SELECT (2 * s_suppkey - 1)::INT AS target FROM supplier)
SELECT t.target, gamma_left, gamma_right, gamma, final_clusters, round(ic, 6) AS ic, coalesce(selected_main_result, false) AS selected_main_result, coalesce(excluded, true) AS excluded,
CASE WHEN source_target IS NULL THEN CASE WHEN coalesce(bracketed, false) THEN 'optimization_admission_failed' ELSE 'resolution_search_failed' END WHEN selected_main_result THEN 'selected_main_result' WHEN excluded THEN exclusion_reason ELSE 'candidate' END AS result_status
FROM odd t LEFT JOIN best ON source_target = t.target LEFT JOIN intervals i ON i.target = t.target""")
def target_diagnostics(spark, sf):
    targets = T.read(spark, sf, "supplier").select((2 * F.col("s_suppkey") - 1).cast("int").alias("target"))  # the upper half has no results
    return rounded(V.target_diagnostics(_rekeyed(spark, sf), targets, _intervals(spark, sf)), "ic")


@query(f"WITH {RES} SELECT gamma, final_clusters, round(ic, 6) AS ic, row_number() OVER (PARTITION BY final_clusters ORDER BY ic NULLS LAST, gamma) = 1 AS selected FROM res")
def resolution_diagnostics(spark, sf):
    return rounded(V.resolution_diagnostics(_rekeyed(spark, sf).select("gamma", "final_clusters", "ic")), "ic")


#: Counts 2 .. 6 with the ic of the gamma axis; labels of trial 1.
MAIN = f"{GIC}, main AS (SELECT g::INT AS n_cluster, g / 10.0::DOUBLE AS gamma, ic, 10 AS n_iterations FROM gic WHERE g BETWEEN 2 AND 6)"


def _main(spark, sf):
    return _gamma_ic(spark, sf).where(F.col("g").between(2, 6)).select(F.col("g").cast("int").alias("n_cluster"), (F.col("g") / 10).alias("gamma"), "ic", F.lit(10).alias("n_iterations"))


def _best_labels(spark, sf):
    return T.gamma_trials(_parts(spark, sf)).where("g between 2 and 6 and trial = 1").select(F.col("g").alias("n_cluster"), "cell_idx", "label")


def _cells(spark, sf):
    return _parts(spark, sf).select(F.col("p_partkey").alias("cell_idx"), F.format_string("cell_%d", "p_partkey").alias("cell_id"))


ROBUST = f"""{MAIN}, robust AS (SELECT format('cell_{{}}', cell_idx) AS cell_id, {', '.join(f"max(label + 1) FILTER (g = {k} AND ic < 1.2)::INT AS clusters_{k}" for k in range(2, 7))}
FROM gt JOIN main ON g = n_cluster WHERE trial = 1 AND ic < 1.2 GROUP BY cell_idx)"""


@query(f"WITH {ROBUST} SELECT * FROM robust")
def robust_labels(spark, sf):
    return V.robust_labels(_main(spark, sf), _best_labels(spark, sf), _cells(spark, sf), [2, 3, 4, 5, 6], 1.2)


@query(f"WITH {ROBUST} SELECT format('cell_{{}}', p_partkey) AS cell_id, p_brand, p_type, clusters_2, clusters_3 FROM part LEFT JOIN robust ON cell_id = format('cell_{{}}', p_partkey)")
def labels_to_metadata(spark, sf):
    wide = V.robust_labels(_main(spark, sf), _best_labels(spark, sf), _cells(spark, sf), [2, 3], 1.2)
    metadata = _parts(spark, sf).select(F.format_string("cell_%d", "p_partkey").alias("cell_id"), "p_brand", "p_type")
    return V.labels_to_metadata(metadata, wide)


BOOTS = f"{MAIN}, boots AS (SELECT n_cluster, b, ic + ((b * 7919 + n_cluster * 31) % 101) / 10000.0::DOUBLE AS ic FROM main, (SELECT unnest(range(1, 51)) AS b))"


def _boots(spark, sf):
    return _main(spark, sf).select("n_cluster", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("b"), "ic").select("n_cluster", "b", (F.col("ic") + (F.col("b") * 7919 + F.col("n_cluster") * 31) % 101 / 10000).alias("ic"))


@query(f"""WITH {BOOTS} SELECT m.n_cluster, round(m.ic, 6) AS ic_median, gamma, n_iterations, round(quantile_cont(b.ic, 0.025), 6) AS ic_ci_lower, round(quantile_cont(b.ic, 0.975), 6) AS ic_ci_upper
FROM main m JOIN boots b USING (n_cluster) WHERE m.ic < 1.2 GROUP BY ALL""")
def consistent_summary(spark, sf):
    return rounded(V.consistent_clusters(_main(spark, sf), _boots(spark, sf), 1.2), "ic_median", "ic_ci_lower", "ic_ci_upper")


@query(f"WITH {MAIN} SELECT count(*) AS n_counts, count(*) FILTER (ic < 1.2) AS n_consistent, round(min(ic), 6) AS min_ic, round(max(ic), 6) AS max_ic, round(avg(ic), 6) AS mean_ic, round(median(ic), 6) AS median_ic FROM main")
def ic_overview(spark, sf):
    return rounded(V.overview(_main(spark, sf), 1.2), "min_ic", "max_ic", "mean_ic", "median_ic")


@query(f"WITH {BOOTS} SELECT b.n_cluster, round(b.ic, 6) AS ic, m.ic < 1.2 AS is_consistent, format('{{}}\n{{:.2e}}', m.n_cluster, m.gamma) AS tick_label FROM boots b JOIN main m USING (n_cluster)")
def plot_ic_data(spark, sf):
    return rounded(V.consistency_points(_main(spark, sf), _boots(spark, sf), 1.2), "ic")


@query(f"WITH {MAIN} SELECT n_cluster, round(ic, 6) AS ic, gamma FROM main")
def plot_stability_data(spark, sf):
    return rounded(V.stability_points(_main(spark, sf)), "ic")


@query("""WITH v AS (SELECT p_retailprice AS x FROM part), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS high, count(*) AS count FROM (SELECT least(floor((x - lo) / (hi - lo) * 30), 29)::INT AS bin, lo, hi FROM v, e) GROUP BY ALL""")
def ic_histogram(spark, sf):
    return rounded(V.histogram(_parts(spark, sf), "p_retailprice"), "low", "high")


@query("""WITH g AS (SELECT DISTINCT l_suppkey * 700 AS n_cells FROM lineitem), a(analysis, m) AS (VALUES ('quick', 0.5::DOUBLE), ('standard', 1.0::DOUBLE), ('thorough', 1.5::DOUBLE)),
c AS (SELECT n_cells, analysis, m, CASE WHEN n_cells < 1000 THEN [2, 8, 2, 10, 50] WHEN n_cells < 10000 THEN [2, 12, 4, 12, 75] WHEN n_cells < 50000 THEN [3, 20, 6, 10, 50] ELSE [5, 25, 8, 8, 30] END AS p FROM g, a)
SELECT n_cells, analysis, p[1]::INT AS k_min, p[2]::INT AS k_max, p[3]::INT AS parallelism, greatest(5, round_even(p[4] * m, 0))::INT AS n_trials, greatest(20, round_even(p[5] * m, 0))::INT AS n_bootstrap, CASE WHEN n_cells < 1000 THEN 'modularity' ELSE 'CPM' END AS objective FROM c""")
def recommended_parameters(spark, sf):
    sizes = T.read(spark, sf, "lineitem").select((F.col("l_suppkey") * 700).alias("n_cells")).distinct()
    return recommended_table(sizes)


@query("""SELECT 'normalized' AS step, (SELECT count(*) FROM part) AS n_rows, (SELECT count(*) FROM part) > 0 AS ready, '' AS suggestion
UNION ALL SELECT 'features', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier) > 0, ''
UNION ALL SELECT 'scaled', 0, false, 'scale the features' UNION ALL SELECT 'pca', (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings) > 0, ''
UNION ALL SELECT 'graph', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem) > 0, ''""")
def readiness_check(spark, sf):
    return T.readiness(spark, {"normalized": _parts(spark, sf), "features": T.read(spark, sf, "supplier"), "scaled": None, "pca": T.read(spark, sf, "embeddings"), "graph": T.read(spark, sf, "lineitem")})


@query(f"""WITH RECURSIVE {PROBES}, apart AS (SELECT DISTINCT gamma FROM probes WHERE gamma > 0 AND abs(ln(gamma) - ln(0.1::DOUBLE)) >= 0.08),
kept AS (SELECT min(gamma) AS gamma FROM apart UNION ALL SELECT min(a.gamma) FROM kept k JOIN apart a ON ln(a.gamma) - ln(k.gamma) >= 0.08 GROUP BY k.gamma)
SELECT gamma FROM kept WHERE gamma IS NOT NULL""")
def thin_gamma(spark, sf):
    values = [r.gamma for r in _probes(spark, sf).select("gamma").collect()]  # fifty sizes
    return spark.createDataFrame([(v,) for v in G.thinned(values, [0.1], "CPM")], "gamma double")


@query("""WITH RECURSIVE steps AS (
    SELECT 0 AS step, NULL::DOUBLE AS middle, [ln(0.01::DOUBLE), ln(0.02::DOUBLE), ln(0.2::DOUBLE), ln(0.5::DOUBLE)] AS places
    UNION ALL SELECT step + 1, (places[k] + places[k + 1]) / 2, list_sort(list_append(places, (places[k] + places[k + 1]) / 2))
    FROM (SELECT step, places, list_position(gaps, list_max(gaps)) AS k
        FROM (SELECT step, places, list_transform(range(1, len(places)), lambda i: places[i + 1] - places[i]) AS gaps FROM steps WHERE step < 4)))
SELECT exp(middle) AS gamma FROM steps WHERE step > 0""")
def secondary_gamma(spark, sf):
    return spark.createDataFrame([(v,) for v in G.secondary([0.01, 0.02, 0.2], 0.01, 0.5, "CPM", 4)], "gamma double")


@query()
def leiden_trials(spark, sf):
    parts = _parts(spark, sf)
    arrays = adjacency(T.planted_blocks(parts).edges, parts.count())
    rows = [(k, g, t, 100 * k + t) for k, g in enumerate((0.05, 0.2, 0.3)) for t in range(1, 5)]
    return run_tasks(arrays, spark.createDataFrame(rows, TASKS), "CPM", 10, 0.1)


@query("""SELECT t.trial, p.p_partkey AS cell_idx, min(p.p_partkey) OVER (PARTITION BY t.trial, p.p_partkey // 200, p.p_partkey % 10) AS least
FROM part p, (SELECT unnest(range(1, 5))::INT AS trial) t""")
def leiden_planted(spark, sf):
    """At a resolution between those of the two kinds of pairs, every run finds the planted groups; each is named by its least cell."""
    parts = _parts(spark, sf)
    tasks = spark.createDataFrame([(0, 0.2, t, t) for t in range(1, 5)], TASKS)
    found = run_tasks(adjacency(T.planted_blocks(parts).edges, parts.count()), tasks, "CPM", 10, 0.1)
    least = found.groupBy("trial", "label").agg(F.min("cell_idx").alias("least"))
    return found.join(least, ["trial", "label"]).select(F.col("trial").cast("int").alias("trial"), "cell_idx", "least")


@query("""SELECT count(DISTINCT (p_partkey // 200, p_partkey % 10))::INT AS n_cluster, 0.2::DOUBLE AS gamma, 1.0::DOUBLE AS ic, true AS consistent,
count(*)::BIGINT AS n_stable FROM part""")
def consistency_of_planted(spark, sf):
    """The whole evaluation of that resolution: as many clusters as groups, and no cell inconsistent."""
    found = evaluate_consistency(T.planted_blocks(_parts(spark, sf)), resolution=[0.2], n_trials=6, n_bootstrap=20, seed=1)
    stable = found.mei.where("mei = 1").groupBy("n_cluster").agg(F.count(F.lit(1)).alias("n_stable"))
    return found.main.select("n_cluster", "gamma", "ic", "consistent").join(stable, "n_cluster")


@query()
def consistency_by_resolution(spark, sf):
    found = evaluate_consistency(T.planted_blocks(_parts(spark, sf)), resolution=[0.05, 0.2, 0.3], n_trials=6, n_bootstrap=20, seed=1)
    return found.resolution_diagnostics


@query()
def consistency_by_cluster_range(spark, sf):
    found = evaluate_consistency(T.planted_blocks(_parts(spark, sf)), cluster_range=[2, 10], n_trials=5, n_bootstrap=20, seed=1)
    return found.target_diagnostics
