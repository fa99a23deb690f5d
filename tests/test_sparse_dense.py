import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.operators import dense, fusion, sparse
from quarrylight.sources.tables import verbatim_matches

CHUNKS = [
    (1, "Deep learning models learn representations"),
    (2, "Transformers use attention; attention is all"),
    (3, "BERT uses masked attention in transformers"),
    (4, "Reinforcement learning optimises reward reward"),
    (5, "the of and"),
]


def tokens(text):
    return [w for w in re.findall(V.BM25_TOKEN, text.lower()) if w not in V.BM25_STOP and len(w) > 1]


def bm25(question, docs):
    toks = {i: tokens(t) for i, t in docs}
    avgdl = sum(map(len, toks.values())) / len(toks)
    df = Counter(w for ts in toks.values() for w in set(ts))
    out = {}
    for i, ts in toks.items():
        score = 0.0
        for w in tokens(question):
            tf = ts.count(w)
            if tf:
                idf = math.log((len(toks) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))
        if score > 0:
            out[i] = round(score, 8)
    return out


def frames(spark, questions):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, text string")
    return spark.createDataFrame(questions, "query_id long, question string"), chunks


def test_bm25_matches_the_formula_and_counts_repeated_words(spark):
    questions = [(1, "attention attention in transformers"), (2, "learning reward"), (3, "zebra"), (4, "")]
    queries, chunks = frames(spark, questions)
    got = {}
    for r in sparse.bm25_search(queries, sparse.build_index(chunks), 3).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    for qid, text in questions:
        assert got.get(qid, {}) == bm25(text, CHUNKS)


def test_saved_index_gives_the_same_hits_and_is_checked(spark, tmp_path):
    queries, chunks = frames(spark, [(1, "masked attention"), (2, "deep reward")])
    index = sparse.build_index(chunks)
    sparse.save_index(index, str(tmp_path / "ix"))
    loaded = sparse.load_index(spark, str(tmp_path / "ix"), expected_docs=5)
    a = sorted(map(tuple, sparse.bm25_search(queries, index, 5).collect()))
    b = sorted(map(tuple, sparse.bm25_search(queries, loaded, 5).collect()))
    assert a == b and a
    assert sparse.load_index(spark, str(tmp_path / "ix"), expected_docs=6) is None
    assert sparse.load_index(spark, str(tmp_path / "none"), expected_docs=5) is None


def test_scoring_tasks_follow_the_pairs_and_not_the_bytes(spark, monkeypatch, tmp_path):
    queries, chunks = frames(spark, [(i, "masked attention in deep learning") for i in range(30)])
    index = sparse.build_index(chunks)
    sparse.save_index(index, str(tmp_path / "ix"))
    want = sorted(map(tuple, sparse.bm25_search(queries, index, 5).collect()))
    monkeypatch.setattr(sparse, "TASK_PAIRS", 4)
    for each in (index, sparse.load_index(spark, str(tmp_path / "ix"), expected_docs=5)):
        assert sparse.bm25_scores(queries, each).rdd.getNumPartitions() == 38
        assert sorted(map(tuple, sparse.bm25_search(queries, each, 5).collect())) == want and want


def test_ties_go_to_the_smaller_id(spark):
    chunks = spark.createDataFrame([(9, "alpha beta"), (3, "alpha beta"), (5, "alpha beta")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "alpha")], "query_id long, question string")
    rows = sparse.bm25_search(queries, sparse.build_index(chunks), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [3, 5]


def test_many_blocks_give_the_rows_of_one(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(size=8).tolist(), int(i % 3)) for i in range(300)]
    vectors += [(1000 + i, vectors[i][1], vectors[i][2]) for i in range(50)]
    qs = [(i, rng.normal(size=8).tolist(), int(i % 3)) for i in range(40)]
    v = spark.createDataFrame(vectors, "chunk_id long, vector array<double>, `group` int")
    q = spark.createDataFrame(qs, "query_id long, vector array<double>, `group` int")
    for same in (False, True):
        direct = {tuple(r) for r in dense.knn(q, v, 5, same_group=same).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(dense, "MAX_BLOCK", 16)
            assert {tuple(r) for r in dense.knn(q, v, 5, same_group=same).collect()} == direct
        assert len(direct) == 200
    assert dense.knn(q.where("false"), v, 5).count() == 0


def test_zero_vectors_have_zero_cosine(spark):
    row = spark.range(1).select(
        dense.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("z"),
        dense.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("o"),
    ).first()
    assert row.z == 0.0 and abs(row.o - 1.0) < 1e-12


def test_fusion_keeps_both_sides(spark):
    left = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2)], "query_id long, chunk_id long, score double, rank int")
    right = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    rows = {r.chunk_id: r for r in fusion.reciprocal_rank_fusion(left, right).collect()}
    assert rows[10].sources == ["bm25"] and rows[12].sources == ["dense"] and rows[11].sources == ["bm25", "dense"]
    assert math.isclose(rows[11].score, round(0.4 / 62 + 0.6 / 61, 10))


def test_injection_replaces_at_most_a_quarter(spark):
    pool = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "query_id long, chunk_id long, rank int")
    extra = spark.createDataFrame([(1, 3, 1), (1, 50, 2), (1, 51, 3), (1, 52, 4)], "query_id long, chunk_id long, inject_rank int")
    rows = sorted((r["rank"], r.chunk_id, r.injected) for r in fusion.inject(pool, extra).collect())
    assert rows == [(i, i, False) for i in range(1, 7)] + [(7, 50, True), (8, 51, True)]


def test_source_filter_cases(spark):
    data = [(1, i, s, i) for i, s in enumerate([4.0, 1.0, 0.9, 0.8], 1)]
    data += [(2, i, s, i) for i, s in enumerate([0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3], 1)]
    data += [(3, i, s, i) for i, s in enumerate([0.04, 0.03], 1)]
    frame = spark.createDataFrame(data, "query_id long, chunk_id long, score double, rank int")
    kept = {}
    for r in fusion.filter_sources(frame).collect():
        kept.setdefault(r.query_id, []).append(r.chunk_id)
    assert sorted(kept[1]) == [1, 2, 3] and sorted(kept[2]) == [1, 2, 3, 4, 5] and kept[3] == [1]


def test_verbatim_matches_agree_with_substring_search(spark):
    docs = [(1, "x one two three four five six seven y"), (2, "one two three"), (3, "aone two three four five six sevenb"), (4, "")]
    asks = [(1, "one two three four five six seven"), (2, "two three four"), (3, "one two three"), (4, "nine ten")]
    got = verbatim_matches(
        spark.createDataFrame(asks, "query_id long, question string"), spark.createDataFrame(docs, "chunk_id long, text string")
    ).collect()
    assert sorted(map(tuple, got)) == sorted((q, d) for q, a in asks for d, t in docs if a in t)
