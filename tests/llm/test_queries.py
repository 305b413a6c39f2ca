"""The registered queries, column by column, on tables made to break them; and what they leave behind."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from concord.llm import ann, bpe, entries, jaccard, packing, shared, suffix_dedup, token_counts, token_files, words
from concord.llm.encoders import Library, encoder, vocabulary
from tests.llm.test_llm import brute_components, brute_count, brute_spans, prose

OTHERS = "“Schöne” — ‘neue’ Welt… Привет, мир! Ёлки 中文分词测试 日本語のテキスト 한국어 नमस्ते दुनिया ไทย שלום مرحبا été 👩‍👩‍👧 😀 ½ Ⅻ ǅ İstanbul ΑΣ ΣΑΣ ​﻿ ﬁn J̌"


def doubling(n, a="a", b="b"):
    """The word of 2**n letters whose halves swap letters, and its complement: equal under every prefix-sum hash modulo 2**64."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return [x, y]


def folder_of(spark, tmp_path, rows, **tables):
    tmp_path.mkdir(exist_ok=True)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def hard_texts():
    rng = random.Random(2)
    out = []
    for n in (10, 11, 12):
        x, y = doubling(n)
        out += [x, y, f"{y} {x}", " ".join([x] * 5 + [y])]
    out += [OTHERS, OTHERS.upper(), " ".join(reversed(OTHERS.split())), None, "", "<|endoftext|>a <|endoftext|>", " \n\n x", "x" * 9000]
    return out + ["".join(rng.choice(OTHERS) for _ in range(200)) for _ in range(60)] + [prose(rng, 100) for _ in range(20)]


@pytest.mark.parametrize("backwards", [False, True])
def test_token_queries_equal_the_library(spark, tmp_path, backwards):
    texts = hard_texts()[:: -1 if backwards else 1]
    folder = folder_of(spark, tmp_path, list(enumerate(texts)))
    byte, word = Library(vocabulary("byte_bpe_50k.json")), Library(vocabulary("word_bpe_49k.json"))
    ids = [byte.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {r.doc_id: tuple(r)[1:4] for r in entries.op3_bpe_round_trip(spark, folder).collect()}
    assert out == {k: (len(x), sha(",".join(map(str, x))), sha(byte.tokenizer.decode(x, skip_special_tokens=False))) for k, x in enumerate(ids)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    out, at = {r.doc_id: tuple(r)[1:4] for r in entries.op9_token_files(spark, folder).collect()}, 0
    for k, t in enumerate(texts):
        own = [*word.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert out[k] == (at, len(own), crc(own))
        at += len(own)
    pieces, used, lengths = entries.op10_packing(spark, folder).collect(), {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own = [*ids[r.doc_id], 1]
        assert r.doc_tokens == len(own) and r.start == used.get(r.doc_id, 0) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        used[r.doc_id] = r.start + r.length
    assert used == {k: len(x) + 1 for k, x in enumerate(ids)}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths.get(r.sequence_id, 0)
        lengths[r.sequence_id] = r.offset + r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())
    scores = token_counts.piece_scores(vocabulary(token_counts.VOCABULARY))
    least = min(scores.values()) - token_counts.BYTE_PENALTY
    for r in entries.op7_token_counts(spark, folder).collect():
        said = [w for w in (texts[r.doc_id] or "").split() if w]
        if (texts[r.doc_id] or "").isascii():
            assert (r.n_words, r.n_tokens) == (len(said), sum(brute_count(scores, least, w) for w in said))


def test_all_scripts_go_without_the_library(monkeypatch):
    said = bpe.speculative(vocabulary(bpe.VOCABULARY))
    library = Library(vocabulary(bpe.VOCABULARY))
    texts = [t for t in hard_texts() if t]
    theirs, counts = library(texts)
    monkeypatch.setattr(Library, "__call__", lambda *_: pytest.fail("the library was called"))
    ours, own = said(texts)
    assert np.array_equal(ours, theirs) and np.array_equal(own, counts)


def test_words_are_told_apart_by_content(monkeypatch):
    hashes = words.Ranges.hashes
    monkeypatch.setattr(words.Ranges, "hashes", lambda self: hashes(self) % np.uint64(5) + np.uint64(1))
    texts = [t for t in hard_texts() if t]
    merge, library = bpe.rules(vocabulary(bpe.VOCABULARY)), Library(vocabulary(bpe.VOCABULARY))
    ids = words.WordIds(words.split_spaced, merge, words.regex_classes(), specials=merge.specials, max_words=100, chars=300)
    for at in range(0, len(texts), 7):
        for ours, theirs in zip(ids(texts[at : at + 7]), library(texts[at : at + 7]), strict=True):
            assert np.array_equal(ours, theirs)


def test_lower_case_table_equals_the_library():
    from tokenizers import normalizers

    lower, care = words.lower_codes()
    plain = np.flatnonzero(~care)
    text = "".join(map(chr, plain.tolist()))
    assert normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text) == "".join(map(chr, lower[plain].tolist()))


def test_jaccard_query_tells_doubling_words_apart(spark, tmp_path):
    rows = []
    for n in (10, 11, 12):
        for x in doubling(n):
            rows += [(len(rows) + k, f"{x} {x} tail {x}" + " more" * (k % 2)) for k in range(3)]
    folder = folder_of(spark, tmp_path, rows)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in entries.op5_ngram_jaccard(spark, folder).collect()}
    assert out == brute_components(rows, 4, 85, 100)


def test_jaccard_under_equal_hashes(monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, 30) for _ in range(30)] + ["", "one"]
    said = [(s, n) for s, n in zip(jaccard.exact_sets(texts, 4), jaccard.sized_sets(texts, 4)[1], strict=True)]
    monkeypatch.setattr(jaccard, "mixed", lambda h: h % np.uint64(7))
    again = [(s, n) for s, n in zip(jaccard.exact_sets(texts, 4), jaccard.sized_sets(texts, 4)[1], strict=True)]
    for (a, n), (b, m) in zip(said, again, strict=True):
        assert n == m == len(a) == len(b)
    for (a, _), (c, _) in zip(said, again, strict=True):
        for (b, _), (d, _) in zip(said, again, strict=True):
            assert len(np.intersect1d(a, b)) == len(np.intersect1d(c, d))


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_of_repeated_ids_in_any_order(spark, seed):
    rng = random.Random(7)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(5, a), (5, b), (6, a), (7, b), (8, a), (9, c), (9, c), (None, a), (10, a + " x")]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + seed)
    join = jaccard.ShingleJoin(4, 85, 100)
    assert {(r.doc_id, r.component_id) for r in join.components(docs).collect()} == {(5, 5), (6, 5), (7, 5), (8, 5), (9, 9), (None, None), (10, 5)}
    kept = sorted(((r.doc_id, r.text) for r in join.without_copies(docs).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (9, c), (9, c), (None, a)], key=str)


def test_jaccard_of_a_large_group_of_unlike_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 4)
    rng = random.Random(11)
    base = prose(rng, 60).split()
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(k % 9):
            own[rng.randrange(60)] = f"e{rng.randint(0, 99)}"
        rows.append((k, " ".join(own)))
    out = jaccard.ShingleJoin(4, 85, 100).components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 4, 85, 100)


def test_unlike_texts_of_a_candidate_group_meet_no_other_part(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_DOCS", 4)
    rng = random.Random(5)
    rows = [(k, prose(rng, 40)) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(20)] + [(200, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(i, 0) for i, _ in rows if i], "a long, b long")  # as if frequent shingles had put all together
    info = spark.createDataFrame([(i, n) for i, (n, _) in brute_components(rows, 4, 85, 100).items()], "doc_id long, n_shingles long")
    dealt, plain = [], jaccard.ShingleJoin._grouped
    monkeypatch.setattr(jaccard.ShingleJoin, "_grouped", lambda self, rows, *rest: dealt.append(rows.count()) or plain(self, rows, *rest))
    found = {r.doc_id: r.component_id for r in jaccard.ShingleJoin(4, 85, 100)._verified(docs, groups, info).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute_components(rows, 4, 85, 100).items()}
    assert sum(dealt) <= len(rows)


def test_suffix_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    shared_ = [prose(rng, 40) for _ in range(3)]
    rows = [(k, " ".join(rng.choice([prose(rng, 20), rng.choice(shared_)]) for _ in range(3))) for k in range(60)] + [(70, None), (71, "é" * 200)]
    out = {r.doc_id: tuple(r)[1:5] for r in entries.op1_suffix_dedup(spark, folder_of(spark, tmp_path, rows)).collect()}
    assert out == {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, (n, gone, spans, kept) in brute_spans(rows, 100).items()}


@pytest.mark.parametrize("size", [1e25, 1e-25, None])
def test_neighbours_of_any_magnitude(spark, tmp_path, size):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)) * (size or 10.0 ** rng.integers(-30, 30, (1200, 1)))
    rows = [(k, v.tolist(), "extra") for k, v in enumerate(x)]
    tmp_path.mkdir(exist_ok=True)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = entries.op2_nearest_neighbours(spark, str(tmp_path)).collect()
    assert len(out) == 60 * 20
    hits = 0
    with np.errstate(over="ignore"):
        for q in range(0, 1200, 20):
            s = x @ x[q]
            s[q] = -np.inf
            want = np.lexsort((np.arange(1200), -s))[:20]
            hits += len({r.vec_id for r in out if r.query_id == q} & set(want.tolist()))
    assert hits / 1200 >= 0.9


def test_neighbours_of_several_dimensions(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, [0.5, 1.0, 9.0]), (2, []), (3, [float("inf"), 1.0])]
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == [(0, 1, 1, 2.5), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]


def test_settings_stay_and_tables_go(spark, tmp_path):
    rng = random.Random(1)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(50)], "vec_id long, embedding array<float>")
    folder = folder_of(spark, tmp_path, [(k, prose(rng, 20)) for k in range(40)], labels=labels, embeddings=vectors)
    before = dict(spark.conf.getAll)
    for query in entries.queries().values():
        query(spark, folder).collect()
    assert dict(spark.conf.getAll) == before
    shared.clear(spark)
    place = shared.shared_dir(spark).removeprefix("file://")
    import os

    assert not os.path.exists(place)


def test_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * (k % 50) for k in range(999)] + ["y" * 5000]}).slice(3)
    parts = list(shared.bounded([batch, batch.slice(0, 0)], rows=100, size=1000))
    assert sum(p.num_rows for p in parts) == 997 and max(p.num_rows for p in parts) <= 100
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_files_and_packing_of_long_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(700_000))
    docs = spark.createDataFrame([(1, long), (2, "x" * 100_000), (3, None)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    ids, n = encoder(vocabulary(packing.VOCABULARY))([long, "x" * 100_000, ""])
    assert counts == {k + 1: int(x) + 1 for k, x in enumerate(n)}
    assert suffix_dedup.remove_repeats(docs).where("doc_id = 2").first().n_removed == 99_999
    assert token_files.BLOCK_TOKENS > 0 and len(ids) == n.sum()


def test_members_of_a_center_are_chosen_once(spark):
    """All who have a center as neighbour meet before any is left out, so no more rows are made than lists have entries."""
    lists = spark.createDataFrame([(u, [0, u % 7 + 1], [1.0, 0.5]) for u in range(10, 60)], ann.LISTS)
    vectors = spark.createDataFrame([(u, bytes([1, 2]), 1.0) for u in range(60)], "id long, small binary, scale double")
    near = ann.NeighbourGraph()._neighbourhoods(lists, vectors, 5, 4)
    assert near._jdf.queryExecution().executedPlan().toString().count("MapInArrow turn") == 1 == near._jdf.queryExecution().executedPlan().toString().count("MapInArrow ")
    found = {}
    for r in near.collect():
        found.setdefault(r.center, set()).add(r.member)
    luck = {u: u * 2654435761 % 1000003 for u in range(10, 60)}
    assert found[0] == set(sorted(luck, key=lambda u: (-luck[u], u))[:5])
    assert found[10] == {10, 0, 4} and len(found) == 50 + 8
