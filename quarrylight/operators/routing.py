"""Confidence, refinement, merging and gating of ranked results (``query_id, chunk_id, score, rank``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import top_k

# Thresholds of the corrective step, the agent, and the gate.
CORRECT, AMBIGUOUS, REFINE_FLOOR = 0.90, 0.70, 0.30
FLAT_GAP, FLAT_TOP = 0.005, 0.95
SUFFICIENT_SCORE, SUFFICIENT_ROWS = 0.85, 2
GATE_SCORE, GATE_ROWS, GATE_OVERLAP, GATE_OVERLAP_MULTI = 0.3, 1, 0.25, 0.15


def score_profile(results: DataFrame) -> DataFrame:
    """One row per query: size, best scores, mean of the first three."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    return results.groupBy("query_id").agg(
        F.count("*").alias("n"),
        at(1).alias("top"),
        at(2).alias("second"),
        F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean3"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
    )


def confidence_class(n: Column, top: Column, mean3: Column) -> Column:
    flat = (n >= 3) & (top - mean3 < FLAT_GAP) & (top < FLAT_TOP)
    return (
        F.when(n == 0, "unknown")
        .when((top >= CORRECT) & ~flat, "correct")
        .when(top >= AMBIGUOUS, "ambiguous")
        .otherwise("incorrect")
    )


def action_of(confidence: Column) -> Column:
    return (
        F.when(confidence.isin("correct", "unknown"), "pass_through")
        .when(confidence == "ambiguous", "refine_only")
        .otherwise("hyde_rewrite")
    )


def crag_confidence(results: DataFrame) -> DataFrame:
    profile = score_profile(results)
    graded = profile.withColumn("confidence", confidence_class(F.col("n"), F.col("top"), F.col("mean3")))
    return graded.select("query_id", "confidence", action_of(F.col("confidence")).alias("action"), "top")


def refine(results: DataFrame, k: int | None = None) -> DataFrame:
    """Drop rows below the floor, but never the best row."""
    kept = results.where((F.col("score") >= REFINE_FLOOR) | (F.col("rank") == 1))
    return kept if k is None else kept.where(F.col("rank") <= k)


def merge_results(original: DataFrame, rewritten: DataFrame, k: int) -> DataFrame:
    """Union of two lists; a chunk in both keeps its better score (the original on a tie)."""
    both = original.select("query_id", "chunk_id", "score", F.lit(0).alias("origin")).unionByName(
        rewritten.select("query_id", "chunk_id", "score", F.lit(1).alias("origin"))
    )
    best = both.groupBy("query_id", "chunk_id").agg(
        F.max(F.struct("score", (-F.col("origin")).alias("pref"))).alias("best")
    )
    flat = best.select("query_id", "chunk_id", F.col("best.score").alias("score"), (-F.col("best.pref")).alias("origin"))
    return top_k(flat, k)


def union_steps(steps: list[DataFrame], default_score: float = 0.5) -> DataFrame:
    """What the steps of a plan found, one after the other: ``query_id, chunk_id, score, step``.

    Steps that bring no score (graph context) count ``default_score``; nothing is merged here.
    """
    rows = []
    for n, found in enumerate(steps):
        score = F.col("score") if "score" in found.columns else F.lit(default_score)
        rows.append(found.select("query_id", "chunk_id", score.cast("double").alias("score"), F.lit(n).alias("step")))
    return reduce(DataFrame.unionByName, rows)


def merge_context(existing: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Add unseen chunks to a context; rows already there keep their score."""
    unseen = new.join(existing.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    columns = ["query_id", "chunk_id", "score"]
    return top_k(existing.select(*columns).unionByName(unseen.select(*columns)), k)


def sufficiency(results: DataFrame) -> DataFrame:
    good = F.count_if(F.col("score") >= SUFFICIENT_SCORE)
    return results.groupBy("query_id").agg(good.alias("good"), (good >= SUFFICIENT_ROWS).alias("sufficient"))


def retrieval_confidence(profile: DataFrame) -> Column:
    """high / medium / low from the best score and its lead over the second."""
    top, second = F.col("top"), F.col("second")
    lead = F.when(second > 0, top / second).otherwise(F.lit(float("inf")))
    strong = F.when((top > 3.0) & (lead >= 1.8), "high").when(lead >= 1.3, "medium")
    weak = F.when((top > 0.65) & (lead >= 1.5), "high").when((top > 0.4) & (lead >= 1.2), "medium")
    return F.coalesce(F.when(top > 2.0, strong).otherwise(weak), F.lit("low"))


def gap_ratio(profile: DataFrame) -> Column:
    return F.when(F.col("second") > 0, F.col("top") / F.col("second")).otherwise(F.lit(0.0))


def tiers(results: DataFrame) -> DataFrame:
    top = F.first("score").over(Window.partitionBy("query_id").orderBy("rank"))
    score = F.col("score")
    wide = F.when(score >= 3.0, "high").when(score >= 1.0, "medium").otherwise("low")
    narrow = F.when(score >= 0.5, "high").when(score >= 0.2, "medium").otherwise("low")
    return results.withColumn("top", top).withColumn("tier", F.when(F.col("top") > 2.0, wide).otherwise(narrow)).drop("top")


def source_diversity(results: DataFrame) -> DataFrame:
    """Distinct papers and sections among the rows of a query (a bounded list)."""
    return results.groupBy("query_id").agg(
        F.count_distinct(F.nullif("paper_id", F.lit(""))).alias("unique_papers"),
        F.count_distinct(F.nullif("section", F.lit(""))).alias("unique_sections"),
        F.array_sort(F.collect_set(F.nullif("paper_id", F.lit("")))).alias("papers"),
    )


def rates(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """One row: number of rows and the share of every class."""
    return df.agg(
        F.count("*").alias("total_queries"),
        *[
            (F.count_if(F.col(column) == c) / F.greatest(F.count("*"), F.lit(1))).alias(f"{c}_pct")
            for c in classes
        ],
    )


def calibrated_threshold(top: Column, base: float = GATE_SCORE) -> Column:
    """Threshold for the scale the best score is on, decided per query."""
    return F.when(top > 2.0, F.lit(max(base, 0.5))).when(top > 0.05, F.lit(max(base, 0.3))).otherwise(F.lit(base))


def gate(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Decide whether a question can be answered from its results.

    ``results(query_id, chunk_id, score, rank, paper_id)``. Questions without results deflect.
    Returns ``query_id, deflect, reason`` with a reason code.
    """
    profile = score_profile(results).join(
        results.where(F.col("rank") <= 10)
        .groupBy("query_id")
        .agg(F.count_distinct(F.nullif("paper_id", F.lit(""))).alias("papers")),
        "query_id",
    )
    question = F.col("question")
    asked = queries.select(
        "query_id",
        T.is_multi_document(question).alias("multi"),
        T.is_abstract_analysis(question).alias("abstract"),
        T.contains_any(question, V.NEEDS_TWO_SOURCES_WORDS).alias("needs_two"),
    )
    base = asked.join(profile, "query_id", "left")
    t = calibrated_threshold(F.col("top"))
    threshold = (
        F.when(F.col("abstract"), F.greatest(F.lit(0.3), t * 0.4))
        .when(F.col("multi"), F.greatest(F.lit(0.5), t * 0.6))
        .otherwise(t)
    )
    limits = base.withColumn("threshold", threshold)
    enough = (
        results.join(limits.select("query_id", "threshold"), "query_id")
        .groupBy("query_id")
        .agg(F.count_if(F.col("score") >= F.col("threshold")).alias("good"))
    )
    joined = limits.join(enough, "query_id", "left")
    reason = (
        F.when(F.col("n").isNull(), "no_results")
        .when(F.col("top") < F.col("threshold"), "low_score")
        .when(F.col("multi") & ~F.col("abstract") & F.col("needs_two") & (F.col("papers") < 2), "single_source")
        .when(F.col("good") < GATE_ROWS, "too_few")
        .otherwise("")
    )
    out = joined.withColumn("reason", reason)
    return out.select("query_id", (F.col("reason") != "").alias("deflect"), "reason", "threshold")


def overlap_gate(results: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Deflect when the three best passages share too few words with the question."""
    top3 = results.where(F.col("rank") <= 3).select("query_id", "chunk_id", "rank")
    passages = (
        texts.join(top3, "chunk_id")
        .groupBy("query_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda p: p["text"]), " ").alias("passage"))
    )
    overlap = T.keyword_overlap(F.col("question"), F.col("passage"))
    scored = queries.join(passages, "query_id").withColumn("overlap", overlap)
    limit = F.when(T.is_multi_document(F.col("question")), GATE_OVERLAP_MULTI).otherwise(GATE_OVERLAP)
    return scored.select("query_id", "overlap", (F.col("overlap") < limit).alias("deflect"))


def occurrences(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


# The three question shapes that ask for a detail, and how often it must occur.
FOCAL_WORD = r"([\p{L}\p{N}_][\p{L}\p{N}_-]+)"
FOCAL_SHAPES = [
    (r"what\s+(?:specific|particular|exact)\s+([\p{L}\p{N}_]+)", 3),
    (r"\buse(?:s|d)?\s+to\s+[\p{L}\p{N}_]+\s+" + FOCAL_WORD, 2),
    (r"\bused\s+to\s+[\p{L}\p{N}_]+\s+" + FOCAL_WORD, 2),
]


def focal_gate(results: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Deflect when the detail a question asks for is hardly in its five best passages."""
    top5 = results.where(F.col("rank") <= 5).select("query_id", "chunk_id", "rank")
    passages = (
        texts.join(top5, "chunk_id")
        .groupBy("query_id")
        .agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda p: p["text"]), " ")).alias("passage"))
    )
    lowered = F.lower(F.col("question"))
    rows = queries.join(passages, "query_id", "left").withColumn("passage", F.coalesce("passage", F.lit("")))
    verdict = None
    for pattern, least in FOCAL_SHAPES:
        focal = F.regexp_extract(lowered, pattern, 1)
        tokens = F.regexp_extract_all("passage", F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
        plain = F.regexp_extract_all("passage", F.lit(T.WORD), F.lit(0))
        count = F.greatest(occurrences(tokens, focal), occurrences(plain, focal))
        fails = (F.length(focal) > 3) & (count < least)
        verdict = fails if verdict is None else verdict | fails
    return rows.select("query_id", verdict.alias("deflect"))


def routing_trace(results: DataFrame, queries: DataFrame) -> DataFrame:
    """What the router decided per question: query type, confidence, action, rows kept."""
    kept = results.groupBy("query_id").agg(F.count_if(F.col("score") >= REFINE_FLOOR).alias("refined_count"))
    asked = queries.select("query_id", T.query_type(F.col("question")).alias("query_type"))
    return asked.join(crag_confidence(results), "query_id", "left").join(kept, "query_id", "left").select(
        "query_id",
        "query_type",
        F.coalesce("confidence", F.lit("unknown")).alias("confidence"),
        F.coalesce("action", F.lit("hyde_rewrite")).alias("action"),
        F.coalesce("refined_count", F.lit(0)).cast("bigint").alias("refined_count"),
    )

