"""Stored indexes: they find what a search without them finds, and read less for it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import block_index, dense, sparse, vector_index


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of four topics with words of their own and words of all; a third hold one very common word."""
    draw = random.Random(3)
    texts = []
    for i in range(2000):
        topic = i % 4
        words = [f"t{topic}w{int(draw.paretovariate(0.8)) % 300}" for _ in range(draw.randrange(3, 40))]
        words += [f"all{draw.randrange(20)}" for _ in range(draw.randrange(4))] + (["common"] * draw.randrange(1, 4) if i % 3 == 0 else [])
        texts.append((i, f"topic{topic}", " ".join(words)))
    texts += [(2000, "topic0", None), (2001, "topic1", ""), (2002, "topic2", "the of and"), (2003, "topic0", texts[0][2]), (2004, "topic3", texts[0][2])]
    questions = [(1, "t0w1 t0w2 common"), (2, "t3w5 t3w250 all3 all3"), (3, "zebra"), (4, ""), (5, None), (6, "common"), (7, texts[0][2]), (8, "t1w7")]
    chunks = spark.createDataFrame(texts, "chunk_id long, section string, text string").repartition(4)
    return chunks, spark.createDataFrame(questions, "query_id long, question string")


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "ix")
    block_index.store(corpus[0], path, ("section", "chunk_id"))
    return path


@pytest.mark.parametrize("k, first", [(10, 1), (3, 2), (500, 1)])
def test_block_search_equals_a_full_search(spark, corpus, stored, k, first):
    chunks, questions = corpus
    index = block_index.load(spark, stored, expected_docs=2005)
    want = rows(sparse.bm25_search(questions, sparse.build_index(chunks), k))
    assert rows(block_index.search(questions, index, k, first_blocks=first)) == want and want


def test_block_search_reads_part_of_the_blocks_and_no_texts(spark, corpus, stored):
    _, questions = corpus
    index = block_index.load(spark, stored)
    plan = block_index.search_plan(questions, index, 5, first_blocks=1)
    told = block_index.read_share(plan).first()
    assert 0 < told["n_read"] < 0.7 * told["n_met"]
    text = plan.hits._jdf.queryExecution().toString()
    assert "postings" in text and "index_tokens" not in text and "LogicalRDD" not in text


def test_block_order_changes_nothing(spark, corpus, tmp_path):
    chunks, questions = corpus
    block_index.store(chunks, str(tmp_path / "ix"))
    assert rows(block_index.search(questions, block_index.load(spark, str(tmp_path / "ix")), 10)) == rows(sparse.bm25_search(questions, sparse.build_index(chunks), 10))


def test_block_index_is_checked_and_may_be_empty(spark, corpus, stored, tmp_path):
    chunks, questions = corpus
    assert block_index.load(spark, stored, expected_docs=7) is None
    assert block_index.load(spark, str(tmp_path / "none")) is None
    block_index.store(chunks.limit(0), str(tmp_path / "empty"))
    empty = block_index.load(spark, str(tmp_path / "empty"))
    assert block_index.search(questions, empty, 5).count() == 0
    assert block_index.search(questions.limit(0), block_index.load(spark, stored), 5).count() == 0


def clustered(n=3000, width=24, groups=30, seed=5):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((groups, width)) * 3
    of = np.where(draw.random(n) < 0.35, 0, draw.integers(0, groups, n))  # one group has a third of all rows
    return centres[of] + draw.standard_normal((n, width)) * 0.6


@pytest.fixture(scope="module")
def vectors(spark):
    data = [(i, v.tolist()) for i, v in enumerate(clustered())]
    data += [(5000 + i, data[i][1]) for i in range(60)] + [(6000, None), (6001, [0.0] * 24)]
    return spark.createDataFrame(data, "chunk_id long, vector array<double>").repartition(4)


def asked(vectors):
    return vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def test_recall_is_high_where_vectors_have_structure(vectors):
    index = vector_index.build(vectors, 60)
    found = vector_index.search(asked(vectors), index, 10, 8)
    exact = dense.knn(asked(vectors).where("vector IS NOT NULL"), vectors.where("vector IS NOT NULL"), 10)
    assert vector_index.recall(found, exact).first()["recall"] >= 0.95
    assert vector_index.scan_share(asked(vectors), index, 8).first()[0] < 0.5
    few = vector_index.search(asked(vectors), index, 10, 1)
    assert vector_index.recall(few, exact).first()["recall"] < vector_index.recall(found, exact).first()["recall"] + 1e-9


@pytest.mark.parametrize("part, block", [(16_384, 1_024), (100, 5)])
def test_all_lists_are_exact_in_parts_and_blocks_too(vectors, monkeypatch, part, block):
    for module in (vector_index, dense):
        monkeypatch.setattr(module, "PART_ROWS", part)
    monkeypatch.setattr(dense, "ASKED_ROWS", block)
    index = vector_index.build(vectors, 20)
    assert index.rows.count() == 3061 and index.rows.groupBy("list", "part").count().agg(F.max("count")).first()[0] <= max(1.5 * part, 100)
    known = vectors.where("vector IS NOT NULL")
    got = rows(vector_index.search(asked(vectors), index, 10, 20))
    assert got == rows(dense.knn(asked(known), known, 10))


def test_saved_vectors_are_found_again_by_list(spark, vectors, tmp_path):
    index = vector_index.build(vectors, 12)
    path = str(tmp_path / "ix")
    vector_index.save(index, path)
    loaded = vector_index.load(spark, path, expected_vectors=3061)
    assert rows(vector_index.search(asked(vectors), loaded, 5, 3)) == rows(vector_index.search(asked(vectors), index, 5, 3))
    assert sorted(p.name for p in (tmp_path / "ix" / "rows").glob("list=*")) == sorted(f"list={r['list']}" for r in index.sizes().collect())
    assert vector_index.load(spark, path, expected_vectors=1) is None and vector_index.load(spark, str(tmp_path / "no")) is None


def test_vector_index_of_nothing_and_of_copies(spark, vectors):
    empty = vector_index.build(vectors.limit(0), 5)
    assert vector_index.search(asked(vectors), empty, 3, 2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "chunk_id long, vector array<double>")
    hits = vector_index.search(asked(same.limit(1)), vector_index.build(same, 7), 4, 7).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == [0, 1, 2, 3]
    assert vector_index.search(asked(vectors).limit(0), vector_index.build(vectors, 5), 3, 2).count() == 0


def test_group_search_stays_inside_the_wanted_groups(spark, corpus, monkeypatch):
    monkeypatch.setattr(dense, "PART_ROWS", 150)
    monkeypatch.setattr(dense, "ASKED_ROWS", 2)
    chunks, questions = corpus
    wanted = [(q, f"topic{g}") for q in (1, 2, 5, 7, 8) for g in (0, 3)] + [(1, "topic0"), (2, "none"), (3, None), (99, "topic1")]
    wanted = spark.createDataFrame(wanted, "query_id long, section string")
    got = dense.group_search(questions, wanted, chunks, "section", 4).collect()
    for topic in ("topic0", "topic3"):
        part = chunks.where(F.col("section") == topic)
        want = rows(dense.hashed_search(questions.where("query_id IN (1, 2, 5, 7, 8)"), part, 4))
        assert sorted((r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got if r["section"] == topic) == want
    assert {r["section"] for r in got} == {"topic0", "topic3"}
