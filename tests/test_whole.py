"""Inputs beyond the sizes and shapes of the given tables."""

import re

import numpy as np
from pyspark.sql import functions as F

from concord.operators import graph as N
from concord.plans.catalog import QUERIES


def test_nearest_exact_in_blocks_and_with_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    x[rng.random(300) < 0.3] = x[7]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    out = {(r.src, r["rank"]): r.dst for r in N.nearest_exact(df, 10).collect()}
    s = x @ x.T
    np.fill_diagonal(s, np.inf)
    assert out == {(q, r + 1): int(v) for q in range(300) for r, v in enumerate(np.lexsort((np.arange(300), -s[q]))[:10])}


def test_nearest_exact_has_no_limit_of_rows(spark):
    # multiples of one vector: the largest are nearest to all
    df = spark.range(20_500).select("id", F.array(F.col("id").cast("double") + 1, F.lit(0.5)).alias("vector"))
    out = N.nearest_exact(df, 3).where("src < 3").collect()
    assert sorted((r.src, r["rank"], r.dst) for r in out) == sorted((q, r, d) for q in range(3) for r, d in ((1, q), (2, 20_499), (3, 20_498)))


def test_csc_columns_of_any_size(spark, tmp_path):
    rows = spark.range(3000).selectExpr("1L as l_orderkey", "id as l_partkey", "1.0D as l_quantity")
    rows = rows.union(spark.range(3).selectExpr("2L", "id", "2.0D")).union(spark.range(3).selectExpr("9000000L", "id", "3.0D"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["csc_to_edges"](spark, str(tmp_path))
    assert out.count() == 3006
    assert out.exceptAll(rows.selectExpr("l_partkey as src", "l_orderkey as dst", "l_quantity as weight")).isEmpty()


def test_leiden_runs_on_all_parts(spark):
    out = QUERIES["leiden_trials"](spark, "/root/testdata/sf0.01").groupBy("cell_idx").count().agg(F.count("count"), F.max("cell_idx")).first()
    assert tuple(out) == (2000, 1999)


def test_qualities_broadcast_no_labels(spark):
    for name in ("modularity_quality", "cpm_quality"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"BroadcastHashJoin (\[[^]]*\])", plan)
        assert not [keys for keys in joins if re.match(r"\[(src|dst|cell_idx|vector|va|vb|l)#", keys)], (name, joins)


def test_modularity_with_cells_without_labels(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0), (2, 9, 3.0), (9, 2, 3.0)], "src long, dst long, weight double")
    labels = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 2, 6), (2, 0, 5), (2, 1, 6), (2, 2, 6)], "trial int, cell_idx long, label int")
    out = {r.trial: r.quality for r in N.modularity_quality(edges, labels, 1.0, ["trial"]).collect()}
    assert abs(out[1] - (4 / 12 - (5 / 12) ** 2 - (4 / 12) ** 2)) < 1e-12 and abs(out[2] - (2 / 12 - (2 / 12) ** 2 - (7 / 12) ** 2)) < 1e-12
