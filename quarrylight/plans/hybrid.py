"""Hybrid retrieval as one plan per batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.operators import block_index
from quarrylight.operators.block_index import BlockIndex
from quarrylight.operators.dense import hashed_group_best, hashed_search
from quarrylight.operators.fusion import (
    inject,
    keyword_rerank,
    readd_injected,
    reciprocal_rank_fusion,
    relevance_filter,
)
from quarrylight.operators.ranking import top_k
from quarrylight.operators.sizing import broadcast_if_small
from quarrylight.operators.sparse import bm25_search, build_index
from quarrylight.session import settle


def first_stage(queries: DataFrame, chunks: DataFrame, k: int = V.FIRST_STAGE_K, index: BlockIndex | None = None) -> DataFrame:
    """Sparse and dense top ``k``, fused. With a stored index of the chunks the sparse half reads no texts."""
    sparse = bm25_search(queries, build_index(chunks), k) if index is None else block_index.search(queries, index, k)
    return reciprocal_rank_fusion(sparse, hashed_search(queries, chunks, k))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = V.TOP_K,
    pool: int = V.RERANK_POOL,
    first_k: int = V.FIRST_STAGE_K,
    threshold: float = 0.0,
    injections: DataFrame | None = None,
    index: BlockIndex | None = None,
) -> DataFrame:
    """``query_id, chunk_id, score, rank, injected`` after fusion, injection and reranking."""
    candidates = top_k(first_stage(queries, chunks, first_k, index), pool).select("query_id", "chunk_id", "rank")
    if injections is None:
        candidates = candidates.select("query_id", "chunk_id", F.lit(False).alias("injected"))
    else:
        # Pool and reranked list are read several times; both hold at most ``pool`` rows a question.
        candidates = settle(inject(settle(candidates, "pool"), injections).drop("rank"), "mixed")
    reranked = keyword_rerank(candidates, queries, chunks, pool)
    if injections is not None:
        reranked = settle(reranked, "reranked")
    best = top_k(reranked, k)
    if injections is not None:
        best = readd_injected(best, reranked)
    return relevance_filter(best, threshold) if threshold > 0 else best


def abstract_search(queries: DataFrame, chunks: DataFrame, section: str, papers: int = 3) -> DataFrame:
    """Best papers by their best chunk in one section. The section filter reaches the scan."""
    part = chunks.where(F.col("section") == section)
    return hashed_group_best(queries, part, "paper_id", papers)


def search_with_citations(
    queries: DataFrame, chunks: DataFrame, k: int = V.TOP_K, threshold: float = V.RELEVANCE_THRESHOLD
) -> DataFrame:
    """Results as numbered citation lines, with a flag whether the best one is relevant."""
    best = hybrid_search(queries, chunks, k)
    small = broadcast_if_small(best, queries.select("query_id"), k * 8)
    shown = chunks.select("chunk_id", "paper_id", "section").join(small, "chunk_id")
    top = F.max("score").over(Window.partitionBy("query_id"))
    line = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.col("paper_id"), F.lit(" — "), F.col("section")
    )
    return shown.select("query_id", "rank", line.alias("citation"), (top >= threshold).alias("is_relevant"))
