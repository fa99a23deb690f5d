"""Corrective retrieval and the agent loop as fixed unrollings over a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.operators import routing
from quarrylight.plans.hybrid import hybrid_search
from quarrylight.session import settle

Rewriter = Callable[[DataFrame], DataFrame]
COLUMNS = ["query_id", "chunk_id", "score", "rank"]


def corrective_search(queries: DataFrame, chunks: DataFrame, rewrite: Rewriter | None = None, k: int = V.TOP_K) -> DataFrame:
    """Search, grade, and act per question.

    Correct results pass, ambiguous ones lose their weak tail, incorrect ones are searched again
    with the rewritten question, merged and refined. Without a rewriter the original results of
    incorrect questions are kept, as when rewriting fails.
    """
    first = settle(hybrid_search(queries, chunks, k).select(*COLUMNS), "first")
    graded = routing.crag_confidence(first).select("query_id", "confidence")
    marked = first.join(graded, "query_id")
    correct = marked.where("confidence = 'correct'").select(*COLUMNS)
    ambiguous = routing.refine(marked.where("confidence = 'ambiguous'").select(*COLUMNS))
    bad = marked.where("confidence = 'incorrect'").select(*COLUMNS)
    if rewrite is not None:
        asked = queries.join(bad.select("query_id").distinct(), "query_id", "left_semi")
        again = hybrid_search(rewrite(asked), chunks, k)
        bad = routing.refine(routing.merge_results(bad, again, k).select(*COLUMNS))
    return correct.unionByName(ambiguous).unionByName(bad)


def keyword_rewrite(queries: DataFrame) -> DataFrame:
    """Offline rewriter: the content words of the question."""
    from quarrylight.functions import text as T

    return queries.withColumn("question", F.array_join(T.overlap_terms(F.col("question")), " "))


def agent_search(queries: DataFrame, chunks: DataFrame, rewriters: list[Rewriter], k: int = V.TOP_K) -> DataFrame:
    """Search until the context suffices, trying one rewriter per extra round.

    Questions that are not sufficient yet go to the next round; what they find is added to their
    context. Each round is written out, so later rounds only read its result.
    """
    context = settle(hybrid_search(queries, chunks, k).select(*COLUMNS), "round")
    rounds = context.select("query_id").distinct().withColumn("rounds", F.lit(1))
    for n, rewrite in enumerate(rewriters, start=2):
        state = routing.sufficiency(context)
        pending = queries.join(state.where("sufficient").select("query_id"), "query_id", "left_anti")
        if pending.isEmpty():
            break
        found = hybrid_search(rewrite(pending), chunks, k)
        ids = pending.select("query_id")
        merged = routing.merge_context(context.join(ids, "query_id", "left_semi"), found, k).select(*COLUMNS)
        context = settle(context.join(ids, "query_id", "left_anti").unionByName(merged), "round")
        rounds = settle(
            rounds.join(ids.withColumn("more", F.lit(True)), "query_id", "left").select(
                "query_id", F.when(F.col("more"), F.lit(n)).otherwise(F.col("rounds")).alias("rounds")
            ),
            "rounds",
        )
    return context.join(rounds, "query_id", "left")
