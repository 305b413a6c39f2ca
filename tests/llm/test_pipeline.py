"""The pipeline on empty tables, nulls, ties, repeated rows, very long texts and columns with clashing names."""

import random

import corpus_pipeline

from tests.llm.test_llm import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, label int, row string"


def tables(spark, tmp_path, rows, marks):
    full = [(i, t, "en", None, None if t is None else len(t), 0.5, None, 1, "r") for i, t in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    good = [prose(rng, 60) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(40)]
    rows = list(enumerate(good + bad))
    marks = [(k, int(k < 60), 0) for k in range(100)]
    rows += [(200, good[0]), (200, good[0]), (201, good[1] + " tail"), (202, None), (203, ""), (204, good[2] + " password = s3cretPw9x"), (205, " ".join(good) * 40)]
    folder = tables(spark, tmp_path, rows, marks)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, folder)
        assert after.schema.names == docs.schema.names
        kept = spark.createDataFrame(after.collect(), docs.schema)
        ids = [r.doc_id for r in kept.collect()]
        if name == "quality":
            assert not any(60 <= i < 100 for i in ids) and {*range(60), 200, 201, 204, 205} <= set(ids)
        if name == "exact_dedup":
            assert 0 not in ids and ids.count(200) == 1
        if name == "near_dedup":
            assert 201 not in ids and 204 not in ids and {1, 2, 200, 205} <= set(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()} == set(ids)


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_secrets_far_from_their_first_digit(spark):
    from concord.llm import secrets

    long = "AbCdEfGhIjKlMnOpQrStUvWxYz" * 4 + "9f8e7d6c5b4a"
    docs = spark.createDataFrame([(1, f"token = {long} end"), (2, f"api_key: {long}")], "doc_id long, text string")
    assert {(r.doc_id, r.value) for r in secrets.findings(docs).collect()} == {(1, long), (2, long)}
