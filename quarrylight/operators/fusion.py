"""Fusing, injecting and reranking candidate lists, all keyed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import ranked, top_k
from quarrylight.operators.sizing import broadcast_if_small


def reciprocal_rank_fusion(
    sparse: DataFrame,
    dense: DataFrame,
    sparse_weight: float = V.SPARSE_WEIGHT,
    dense_weight: float = V.DENSE_WEIGHT,
    k: int = V.RRF_K,
) -> DataFrame:
    """Full outer merge of two ranked lists, scored by weighted reciprocal ranks."""
    if abs(sparse_weight + dense_weight - 1.0) > 0.01:
        raise ValueError("fusion weights must add up to 1")
    left = sparse.select("query_id", "chunk_id", F.col("rank").alias("r1"), F.col("score").alias("sparse_score"))
    right = dense.select("query_id", "chunk_id", F.col("rank").alias("r2"), F.col("score").alias("dense_score"))
    merged = left.join(right, ["query_id", "chunk_id"], "full_outer")

    def part(weight: float, rank: str):
        return F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))

    return merged.select(
        "query_id",
        "chunk_id",
        F.round(part(sparse_weight, "r1") + part(dense_weight, "r2"), 10).alias("score"),
        F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"),
        F.array_compact(
            F.array(
                F.when(F.col("r1").isNotNull(), F.lit("bm25")), F.when(F.col("r2").isNotNull(), F.lit("dense"))
            )
        ).alias("sources"),
    )


def inject(pool: DataFrame, injections: DataFrame) -> DataFrame:
    """Swap the tail of each pool for unseen injected chunks, at most a quarter of the pool.

    ``pool(query_id, chunk_id, rank, sources, ...)`` is ranked; ``injections(query_id, chunk_id,
    inject_rank)`` is ordered. Kept rows keep their rank; injected rows follow them.
    """
    size = pool.groupBy("query_id").agg(F.count("*").alias("pool_size"))
    fresh = ranked(
        injections.join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"),
        "query_id",
        [F.col("inject_rank"), F.col("chunk_id")],
        "nth",
    )
    new = fresh.join(size, "query_id").where(F.col("nth") <= F.floor(F.col("pool_size") / 4))
    n_new = new.groupBy("query_id").agg(F.count("*").alias("n_new"))
    kept = (
        pool.join(size, "query_id")
        .join(n_new, "query_id", "left")
        .where(F.col("rank") <= F.col("pool_size") - F.coalesce("n_new", F.lit(0)))
        .select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.lit(False).alias("injected"))
    )
    added = new.join(n_new, "query_id").select(
        "query_id",
        "chunk_id",
        (F.col("pool_size") - F.col("n_new") + F.col("nth")).cast("bigint").alias("rank"),
        F.lit(True).alias("injected"),
    )
    return kept.unionByName(added)


def question_features(queries: DataFrame) -> DataFrame:
    """Per question: distinct words, and its 3- and 2-word phrases with repeats."""
    words = F.filter(F.split(F.lower(F.col("question")), r"\s+"), lambda w: F.length(w) > 0)
    split = queries.select("query_id", "question", words.alias("words"))

    def phrases(n: int):
        starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))
        return F.when(F.size("words") >= n, joined).otherwise(F.array().cast("array<string>"))

    return split.select(
        "query_id",
        T.ascii_word_set(F.col("question")).alias("q_words"),
        phrases(3).alias("triples"),
        phrases(2).alias("pairs"),
    )


def keyword_rerank(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    per_query: int = V.RERANK_POOL,
    k: int | None = None,
) -> DataFrame:
    """``0.4 prior + 0.4 word overlap + 0.2 phrase bonus``: 0.1 per word of every shared phrase.

    ``candidates`` holds at most ``per_query`` rows a query and may carry ``prior``, the score a
    candidate brings along; fused rows bring none. Candidate ids are the small side of the text
    join, so only texts of candidates are looked at and the corpus is not shuffled. Question
    features are computed once per question, chunk features once per candidate chunk. A candidate
    whose text is missing stays and counts as empty.
    """
    wanted = broadcast_if_small(candidates.select("chunk_id").distinct(), queries.select("query_id"), per_query * 8)
    features = chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", F.lower("text").alias("low"), T.ascii_word_set(F.col("text")).alias("c_words"))
    # Few bytes and much work a row: by size alone the pairs would be merged into a handful of tasks.
    width = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.repartition(width, "chunk_id")
    featured = dealt.join(features.repartition(width, "chunk_id"), "chunk_id", "left").select(
        *candidates.columns, F.coalesce("low", F.lit("")).alias("low"), F.coalesce("c_words", F.array().cast("array<string>")).alias("c_words")
    )
    rows = featured.join(broadcast_if_small(question_features(queries), queries, 16), "query_id")

    # A three-word phrase can only occur where both of its two-word phrases do.
    rows = rows.withColumn("hit", F.transform("pairs", lambda p: F.contains(F.col("low"), p)))
    n_pairs = F.size(F.filter("hit", lambda h: h))
    n_triples = F.size(
        F.filter(
            "triples",
            lambda p, i: F.get(F.col("hit"), i) & F.get(F.col("hit"), i + 1) & F.contains(F.col("low"), p),
        )
    )
    overlap = F.size(F.array_intersect("q_words", "c_words")) / F.greatest(F.size("q_words"), F.lit(1))
    bonus = n_triples * F.lit(0.1 * 3) + n_pairs * F.lit(0.1 * 2)
    prior = F.col("prior") if "prior" in candidates.columns else F.lit(0.0)
    score = F.round(prior * 0.4 + overlap * 0.4 + bonus * 0.2, 8).alias("score")
    scored = rows.select(*[c for c in candidates.columns if c not in ("prior", "score")], score)
    return scored if k is None else top_k(scored, k)


def readd_injected(final: DataFrame, reranked: DataFrame) -> DataFrame:
    """Injected candidates that missed the cut are appended after it, best first."""
    missed = reranked.where("injected").join(
        final.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"
    )
    count = final.groupBy("query_id").agg(F.max("rank").alias("last"))
    tail = ranked(missed, "query_id", [F.col("score").desc(), F.col("chunk_id")], "nth").join(count, "query_id")
    appended = tail.withColumn("rank", (F.col("last") + F.col("nth")).cast("int")).select(*final.columns)
    return final.unionByName(appended)


def relevance_filter(results: DataFrame, threshold: float) -> DataFrame:
    """Rows at or above the threshold; injected rows pass regardless."""
    return results.where((F.col("score") >= threshold) | F.col("injected"))


def filter_sources(results: DataFrame, most: int = 5, least: int = 3) -> DataFrame:
    """Keep results close to the best score, by how dominant the best one is.

    Needs ``query_id, rank, score``. At most ``most`` rows pass the ratio; then the best of the
    rest fill up to ``least``. With a top score of 0.05 or less only the first row stays.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    top = F.first("score").over(w)
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(whole)
    dominant = second.isNull() | (second <= 0) | (F.col("top") >= V.DOMINANT_LEAD * F.col("second"))
    scale = [
        F.when(F.col("top") > above, F.when((F.col("top") > high) & F.col("dominant"), strict).otherwise(loose))
        for above, high, strict, loose in (V.SOURCE_RATIOS["logit"], V.SOURCE_RATIOS["sigmoid"])
    ]
    ratio = F.coalesce(*scale)
    base = (
        results.withColumn("top", top)
        .withColumn("second", second)
        .withColumn("dominant", dominant)
        .withColumn("ratio", ratio)
        .withColumn("passes", F.coalesce(F.col("score") >= F.col("top") * F.col("ratio"), F.col("rank") == 1))
    )
    nth = F.sum(F.col("passes").cast("int")).over(w)
    chosen = base.withColumn("nth", nth).withColumn("passes", F.col("passes") & (F.col("nth") <= most))
    n_pass = F.sum(F.col("passes").cast("int")).over(whole)
    misses = F.sum((~F.col("passes")).cast("int")).over(w)
    filled = chosen.withColumn("n_pass", n_pass).withColumn("misses", misses)
    fill = ~F.col("passes") & F.col("ratio").isNotNull() & (F.col("n_pass") + F.col("misses") <= least)
    kept = filled.where(F.col("passes") | fill)
    order = [F.col("passes").desc(), F.col("rank")]
    return ranked(kept, "query_id", order, "source_number").select(*results.columns, "source_number")
