"""Element-centric similarity (ECS) of flat partitions, and what is built on it.

For disjoint partitions the similarity of an element is |A(i) & B(i)| / max(|A(i)|, |B(i)|), so
everything is counts. Trials are compressed to patterns first: one row for each different vector
of labels over the trials, with its number of cells. Pairs of trials are then formed per pattern
and not per cell, and no trial's labels are ever gathered in one task.

Frames: ``trials`` (trial, cell_idx, label); ``pairs`` (i, j, ecs) with i < j.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def element_similarity(labels: DataFrame, a: str, b: str, element: str = "cell_idx") -> DataFrame:
    """(element, ecs) of two label columns; joint and single counts come from grouped tables.

    The joins back to the elements are on labels, whose tables are small next to the elements.
    """
    joint = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_ab"))
    sizes = (
        joint.withColumn("n_a", F.sum("n_ab").over(Window.partitionBy(a)))
        .withColumn("n_b", F.sum("n_ab").over(Window.partitionBy(b)))
        .select(a, b, (F.col("n_ab") / F.greatest("n_a", "n_b")).alias("ecs"))
    )
    return labels.select(element, a, b).join(sizes, [a, b]).select(element, "ecs")


def aligned(left: DataFrame, right: DataFrame, element: str = "cell_idx") -> DataFrame:
    """Two label tables (element, label) as one (element, a, b); raises if their elements differ or a label is null."""
    both = left.select(element, F.col("label").alias("a"), F.lit(1).alias("_l")).join(
        right.select(element, F.col("label").alias("b"), F.lit(1).alias("_r")), element, "full_outer"
    )
    said = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1)).alias("apart"),
        F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("missing"),
    ).first()
    if not said.n:
        raise ValueError("cluster vectors must not be empty")
    if said.apart:
        raise ValueError(f"cluster vectors must cover the same elements; {said.apart} differ")
    if said.missing:
        raise ValueError("cluster vectors must not contain missing labels")
    return both.select(element, "a", "b")


def scalar_similarity(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ecs): the mean of ``element_similarity``, from the contingency table alone."""
    joint = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_ab"))
    sized = joint.withColumn("n_a", F.sum("n_ab").over(Window.partitionBy(a))).withColumn("n_b", F.sum("n_ab").over(Window.partitionBy(b)))
    return sized.agg((F.sum(F.col("n_ab") * F.col("n_ab") / F.greatest("n_a", "n_b")) / F.sum("n_ab")).alias("ecs"))


def patterns(trials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, labels, n, first_cell): cells with one label vector; trials are in ascending order in ``labels``."""
    keys = keys or []
    wide = trials.groupBy(*keys, "cell_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("trial", "label"))), lambda x: x["label"]).alias("labels"))
    return wide.groupBy(*keys, "labels").agg(F.count(F.lit(1)).alias("n"), F.min("cell_idx").alias("first_cell"))


def trial_pairs(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, a, b, n, first_cell) for i < j (from 1) of each pattern."""
    keys = keys or []
    size = F.size("labels")
    left = found.select(*keys, "n", "first_cell", "labels", F.posexplode("labels").alias("i", "a"))
    return left.select(
        *keys, "n", "first_cell", (F.col("i") + 1).alias("i"), "a",
        F.posexplode(F.slice("labels", F.col("i") + 2, F.greatest(size - F.col("i") - 1, F.lit(0)))).alias("k", "b"),
    ).select(*keys, "i", (F.col("i") + F.col("k") + 1).alias("j"), "a", "b", "n", "first_cell")


def contingency(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, a, b, n, ecs): joint counts of trial pairs, and the similarity of their cells."""
    keys = keys or []
    joint = trial_pairs(found, keys).groupBy(*keys, "i", "j", "a", "b").agg(F.sum("n").alias("n"))
    n_a = F.sum("n").over(Window.partitionBy(*keys, "i", "j", "a"))
    n_b = F.sum("n").over(Window.partitionBy(*keys, "i", "j", "b"))
    return joint.withColumn("ecs", F.col("n") / F.greatest(n_a, n_b))


def similarity_matrix(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, ecs) for i < j."""
    keys = keys or []
    return contingency(found, keys).groupBy(*keys, "i", "j").agg((F.sum(F.col("n") * F.col("ecs")) / F.sum("n")).alias("ecs"))


def outcomes(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, outcome_id, n, prob, rep_trial): the different trials, most frequent first, then by label text.

    Two trials are one outcome if they agree on every pattern. Label texts are compared at the
    first cell where two trials differ, which the patterns' first cells give.
    """
    keys = keys or []
    count = found.groupBy(*keys).agg(F.max(F.size("labels")).alias("t")) if keys else found.agg(F.max(F.size("labels")).alias("t"))
    trials = count.select(*keys, "t", F.explode(F.sequence(F.lit(1), "t")).alias("i"))
    pairs = trial_pairs(found, keys).groupBy(*keys, "i", "j").agg(F.min(F.when(F.col("a") != F.col("b"), F.struct("first_cell", "a", "b"))).alias("differ"))
    same = pairs.where("differ is null").groupBy(*keys, F.col("j").alias("i")).agg(F.min("i").alias("rep"))
    grouped = trials.join(same, [*keys, "i"], "left").withColumn("rep_trial", F.coalesce("rep", "i")).groupBy(*keys, "rep_trial").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    order = pairs.where("differ is not null").select(*keys, "i", "j", (F.concat(F.col("differ.a").cast("string"), F.lit(",")) < F.concat(F.col("differ.b").cast("string"), F.lit(","))).alias("i_first"))
    both = order.unionByName(order.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), (~F.col("i_first")).alias("i_first")))
    other = grouped.select(*keys, F.col("rep_trial").alias("other"), F.col("n").alias("other_n"))
    ranked = grouped.join(both.withColumnsRenamed({"i": "rep_trial", "j": "other"}), [*keys, "rep_trial"], "left").join(other, [*keys, "other"], "left")
    ahead = F.when(F.col("other_n") > F.col("n"), 1).when((F.col("other_n") == F.col("n")) & ~F.col("i_first"), 1).otherwise(0)
    return ranked.groupBy(*keys, "rep_trial", "n", "t").agg((F.sum(ahead) + 1).cast("int").alias("outcome_id")).select(
        *keys, "outcome_id", F.col("n").cast("int").alias("n"), (F.col("n") / F.col("t")).alias("prob"), "rep_trial"
    )


def normalised_outcomes(table: DataFrame) -> DataFrame:
    """Checks probabilities (not null, finite, not negative, not all zero) and makes them sum to 1."""
    p = F.col("prob")
    said = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(p.isNull() | F.isnan(p) | (p < 0) | (p == float("inf")), 1)).alias("bad"),
        F.sum("prob").alias("total"),
    ).first()
    if not said.n:
        raise ValueError("clustering array must hold at least one clustering")
    if said.bad or not said.total:
        raise ValueError("clustering probabilities must be finite, non-negative and not all zero")
    return table.withColumn("prob", p / F.lit(float(said.total)))


def raw_consistency(pairs: DataFrame, trials: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, ic_raw, ic): the mean similarity of all ordered trial pairs, itself pairs included, and its inverse."""
    keys = keys or []
    t = F.lit(trials) if trials else F.max("j")
    raw = (t + 2 * F.coalesce(F.sum("ecs"), F.lit(0.0))) / (t * t)
    table = pairs.groupBy(*keys).agg(raw.alias("ic_raw")) if keys else pairs.agg(raw.alias("ic_raw"))
    return table.withColumn("ic", 1 / F.col("ic_raw"))


def weighted_consistency(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ic_raw, ic) of outcomes (outcome_id, prob) and their pair similarities (i, j, ecs) by outcome."""
    own = table.agg(F.sum(F.col("prob") * F.col("prob")).alias("own"))
    p = table.select(F.col("outcome_id").alias("i"), F.col("prob").alias("p"))
    q = table.select(F.col("outcome_id").alias("j"), F.col("prob").alias("q"))
    cross = pairs.join(p, "i").join(q, "j").agg(F.coalesce(F.sum(F.col("p") * F.col("q") * F.col("ecs")), F.lit(0.0)).alias("cross"))
    return own.join(F.broadcast(cross)).select((F.col("own") + 2 * F.col("cross")).alias("ic_raw")).withColumn("ic", 1 / F.col("ic_raw"))


def element_consistency(trials: DataFrame, found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, cell_idx, mei): the mean over ordered trial pairs of the cell's similarity; computed per pattern.

    Pairs of trials are many times what Spark takes them for from the patterns' table: none is broadcast.
    """
    keys = keys or []
    exploded = trial_pairs(found, keys).select(*keys, "first_cell", "i", "j", "a", "b")
    scored = exploded.join(contingency(found, keys).select(*keys, "i", "j", "a", "b", "ecs").hint("merge"), [*keys, "i", "j", "a", "b"]).groupBy(*keys, "first_cell").agg(F.sum("ecs").alias("s"))
    t = F.size("labels")
    by_pattern = found.join(scored.hint("merge"), [*keys, "first_cell"], "left").select(*keys, "labels", ((t + 2 * F.coalesce("s", F.lit(0.0))) / (t * t)).alias("mei"))
    wide = trials.groupBy(*keys, "cell_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("trial", "label"))), lambda x: x["label"]).alias("labels"))
    return wide.join(by_pattern.hint("merge"), [*keys, "labels"]).select(*keys, "cell_idx", "mei")


def best_outcome(table: DataFrame, pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, outcome_id, rep_trial, total): the outcome most similar to all outcomes, unweighted; ties to the first."""
    keys = keys or []
    own = pairs.select(*keys, F.col("i").alias("rep_trial"), F.col("j").alias("other"), "ecs")
    both = own.unionByName(own.select(*keys, F.col("other").alias("rep_trial"), F.col("rep_trial").alias("other"), "ecs"))
    others = table.select(*keys, F.col("rep_trial").alias("other"))
    met = both.join(others, [*keys, "other"])
    total = table.join(met, [*keys, "rep_trial"], "left").groupBy(*keys, "outcome_id", "rep_trial").agg((F.lit(1.0) + F.coalesce(F.sum("ecs"), F.lit(0.0))).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("total", 12)), "outcome_id"))  # one row for each outcome
    return total.withColumn("_r", rank).where("_r = 1").drop("_r")


def bootstrap(pairs: DataFrame, weights: DataFrame, trials: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, b, ic) for multiplicities (b, trial, w): each replicate is a weighted sum of one similarity matrix.

    ``weights`` may have draws of its own for each key.
    """
    keys = keys or []
    shared = [k for k in keys if k in weights.columns]
    own = weights.groupBy(*shared, "b").agg(F.sum(F.col("w") * F.col("w")).alias("own"))
    left = weights.select(*shared, "b", F.col("trial").alias("i"), F.col("w").alias("w_i"))
    right = weights.select(*shared, "b", F.col("trial").alias("j"), F.col("w").alias("w_j"))
    cross = pairs.join(left, [*shared, "i"]).join(right, [*shared, "b", "j"]).groupBy(*keys, "b").agg(F.sum(F.col("w_i") * F.col("w_j") * F.col("ecs")).alias("cross"))
    # replicates x keys rows: a draw of one trial only has no pair
    grid = own.join(F.broadcast(pairs.select(*keys).distinct()), shared or None) if keys else own
    return grid.join(cross, [*keys, "b"], "left").select(*keys, "b", (F.lit(float(trials * trials)) / (F.col("own") + 2 * F.coalesce("cross", F.lit(0.0)))).alias("ic"))


def bootstrap_weights(spark, replicates: int, trials: int, draw=None, seeds: DataFrame | None = None) -> DataFrame:
    """(b, trial, w); ``draw(b, s)`` is the column of the trial, from 0, drawn for slot s (default: by hash).

    With ``seeds`` (key columns, seed; a few rows): (keys, b, trial, w), with draws by each key's seed.
    """
    slots = spark.range(1, replicates + 1).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(trials)).cast("array<bigint>")).alias("s"))
    keys = [c for c in seeds.columns if c != "seed"] if seeds is not None else []
    if seeds is not None:
        slots = slots.join(F.broadcast(seeds))
    seed = [F.col("seed")] if keys else []
    draw = draw or (lambda b, s: F.pmod(F.xxhash64(b, s, *seed), F.lit(trials)))
    return slots.select(*keys, "b", (draw(F.col("b"), F.col("s")) + 1).cast("int").alias("trial")).groupBy(*keys, "b", "trial").agg(F.count(F.lit(1)).alias("w"))


def interval(table: DataFrame, column: str = "ic", keys: list[str] | None = None) -> DataFrame:
    """(keys, ic_median, ic_ci_lower, ic_ci_upper): linear-interpolated 50, 2.5 and 97.5 % points."""
    points = F.percentile(column, F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("p")
    found = table.groupBy(*keys).agg(points) if keys else table.agg(points)
    return found.select(*(keys or []), F.col("p")[0].alias("ic_median"), F.col("p")[1].alias("ic_ci_lower"), F.col("p")[2].alias("ic_ci_upper"))
