"""Queries over stored indexes: postings in blocks, and vectors in inverted lists."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import HYBRID
from quarrylight.operators import block_index, dense, vector_index
from quarrylight.plans import hybrid
from quarrylight.session import own_folder, settle

BASE = f"WITH {P.CHUNKS}, {P.QUESTIONS}"
#: Lists a question looks into, as a share of all. The given vectors have hardly any structure, so it takes many.
PROBED_SHARE = 0.65


def stored_postings(t) -> block_index.BlockIndex:
    path = own_folder(t.spark, "postings")
    block_index.store(t.chunks().select("chunk_id", "section", "paper_id", "text"), path, ("section", "paper_id", "chunk_id"))
    return block_index.load(t.spark, path)


@query(
    "indexed_bm25_topk",
    f"{BASE}, {P.INDEX}, {P.BM25}, {P.top('best', 'bm25', 10, where='score > 0')} SELECT query_id, chunk_id, score, rank FROM best",
)
def indexed_bm25_topk(t):
    return block_index.search(t.questions(), stored_postings(t), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "indexed_terms",
    f"WITH {P.CHUNKS}, {P.INDEX} SELECT term, df, n_docs, round(avgdl, 6) AS avgdl FROM terms, corpus",
)
def indexed_terms(t):
    index = stored_postings(t)
    n, avgdl = (index.corpus.select(c).scalar() for c in ("n_docs", "avgdl"))
    return index.terms.select("term", "df", n.alias("n_docs"), F.round(avgdl, 6).alias("avgdl"))


@query("indexed_hybrid", f"{BASE}, {HYBRID} SELECT query_id, chunk_id, score, rank FROM hybrid")
def indexed_hybrid(t):
    """Hybrid retrieval whose sparse half searches the stored postings."""
    best = hybrid.hybrid_search(t.questions(), t.chunks(), index=stored_postings(t))
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


ASKED = """asked AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 100 = 0),
sims AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, list_transform(embedding, lambda x: x::DOUBLE)), 8) AS score FROM asked, embeddings)"""


def asked_vectors(t):
    """Every vector whose key is divisible by 100 is a question to all vectors."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def all_vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def stored_vectors(t) -> vector_index.VectorIndex:
    vectors = all_vectors(t)
    path = own_folder(t.spark, "vectors")
    vector_index.save(vector_index.build(vectors, max(1, round(math.sqrt(vectors.count())))), path)
    return vector_index.load(t.spark, path)


@query("ann_all_lists", f"WITH {ASKED}, {P.top('best', 'sims', 10)} SELECT query_id, chunk_id, score, rank FROM best")
def ann_all_lists(t):
    """With every list probed the stored index gives exact neighbours: no vector is missing from it."""
    index = stored_vectors(t)
    return vector_index.search(asked_vectors(t), index, 10, index.lists).withColumn("rank", F.col("rank").cast("bigint"))


@query("ann_topk")
def ann_topk(t):
    index = stored_vectors(t)
    return vector_index.search(asked_vectors(t), index, 10, math.ceil(index.lists * PROBED_SHARE)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "ann_recall",
    """SELECT count(*) AS n_queries, count(*) * least(10, (SELECT count(*) FROM embeddings)) AS n_exact, true AS nine_in_ten, true AS fewer_scanned
    FROM embeddings WHERE vec_id % 100 = 0""",
)
def ann_recall(t):
    """Recall at 10 against brute force reaches 0.9 while part of the vectors is compared."""
    index, asked = stored_vectors(t), asked_vectors(t)
    probes = math.ceil(index.lists * PROBED_SHARE)
    found = settle(vector_index.search(asked, index, 10, probes), "near")
    told = vector_index.recall(found, dense.knn(asked, all_vectors(t), 10))
    share = vector_index.scan_share(asked, index, probes).select("scanned_share").scalar()
    return told.select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("nine_in_ten"), (share < 0.8).alias("fewer_scanned"))


@query(
    "paper_fetch_for_query",
    f"""{BASE}, {P.HASHED},
    best_chunk AS (SELECT query_id, paper_id, max(dense.score) AS score FROM dense JOIN chunks USING (chunk_id) WHERE section = 'en' GROUP BY query_id, paper_id),
    {P.top('papers', 'best_chunk', 3, key='paper_id')},
    inside AS (SELECT query_id, paper_id, chunk_id, dense.score, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY dense.score DESC, chunk_id) AS rank
      FROM dense JOIN chunks USING (chunk_id) JOIN papers USING (query_id, paper_id))
    SELECT query_id, paper_id, chunk_id, score, rank FROM inside WHERE rank <= 3""",
)
def paper_fetch_for_query(t):
    """The chunks of each paper the abstracts point to that are nearest to the question."""
    questions, chunks = t.questions(), t.chunks()
    papers = settle(hybrid.abstract_search(questions, chunks, "en", 3), "papers")
    return dense.group_search(questions, papers, chunks, "paper_id", 3).withColumn("rank", F.col("rank").cast("bigint"))
