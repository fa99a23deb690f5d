"""Sparse retrieval: inverted index and BM25 scoring.

A search works on the query vocabulary only. Texts are tokenised where they lie, tokens outside
the vocabulary are dropped by a broadcast semi join before anything is shuffled, and the rest is
hash-partitioned by chunk once, to so many tasks that each has a bounded number of pairs to sum.
Counting terms, joining the query weights (broadcast while their size bound holds) and summing per
``(query, chunk)`` all run inside that partitioning, and each task passes on at most ``k`` rows per query. A very frequent term never gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import top_k
from quarrylight.operators.sizing import broadcast_if_small

INDEX_VERSION = 1
# A question byte yields at most half a token; a token row takes well under 64 bytes.
TERM_GROWTH = 32
#: Pairs of question and chunk that a task may have to add up at once.
TASK_PAIRS = 1 << 20


@dataclass(frozen=True)
class SparseIndex:
    """Either tokenised chunks (``chunk_id, dl, tokens``) or stored postings with chunk lengths."""

    lengths: DataFrame
    tokens: DataFrame | None = None
    stored: DataFrame | None = None

    def postings(self, vocabulary: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
        """``chunk_id, dl, term, tf``, restricted to ``vocabulary(term)`` when given, and dealt to ``tasks`` by chunk."""
        deal = lambda rows: rows.repartition(*([tasks] if tasks else []), "chunk_id")
        if self.stored is not None:
            rows = self.stored if vocabulary is None else self.stored.join(vocabulary, "term", "left_semi")
            return deal(rows) if tasks else rows
        terms = self.tokens.select("chunk_id", "dl", T.unnest(F.col("tokens")).alias("term"))
        if vocabulary is not None:
            terms = deal(terms.join(vocabulary, "term", "left_semi"))
        return terms.where("term IS NOT NULL").groupBy("chunk_id", "dl", "term").agg(
            F.least(F.count("*"), F.lit(V.BM25_TF_CAP)).alias("tf")
        )

    def corpus(self) -> DataFrame:
        """One row: number of chunks (empty ones too) and their mean length."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    def terms(self, vocabulary: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
        """``term, df, idf``."""
        n = self.corpus().select("n_docs").scalar()
        df = F.col("df")
        return (
            self.postings(vocabulary, tasks)
            .groupBy("term")
            .agg(F.count("*").alias("df"))
            .withColumn("idf", F.log((n - df + 0.5) / (df + 0.5) + 1.0))
        )


def build_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> SparseIndex:
    tokens = chunks.select(F.col(key).alias("chunk_id"), T.index_tokens(F.col(text)).alias("tokens"))
    sized = tokens.withColumn("dl", F.size("tokens"))
    return SparseIndex(lengths=sized.select("chunk_id", "dl"), tokens=sized)


def save_index(index: SparseIndex, path: str) -> None:
    """Write the index; the manifest comes last, so a half-written index is never loaded.

    Rows of one chunk share a file and rows are sorted by term inside it, which lets row-group
    statistics skip terms nobody asked for.
    """
    placed = index.postings().repartition("chunk_id").sortWithinPartitions("term")
    placed.write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    n = index.lengths.agg(F.count("*").alias("n_docs"))
    n.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, expected_docs: int) -> SparseIndex | None:
    """Saved index, or None when its version or chunk count does not match."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest").first()
    except Exception:  # no such table yet
        return None
    if manifest is None or manifest["version"] != INDEX_VERSION or manifest["n_docs"] != expected_docs:
        return None
    return SparseIndex(
        lengths=spark.read.parquet(f"{path}/lengths"), stored=spark.read.parquet(f"{path}/postings")
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf``: a word said twice counts twice."""
    return (
        queries.select("query_id", T.unnest(T.index_tokens(F.col("question"))).alias("term"))
        .where("term IS NOT NULL")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def vocabulary_of(queries: DataFrame) -> DataFrame:
    return broadcast_if_small(query_terms(queries).select("term").distinct(), queries, TERM_GROWTH)


def scoring_tasks(queries: DataFrame, index: SparseIndex) -> int:
    """Tasks the chunks are dealt to, so that the pairs of each stay bounded however many chunks there are.

    Frequent terms make a pair of nearly every question and chunk, and adaptive execution, which sees only
    the bytes of the postings, would leave all of them to a few tasks.
    """
    pairs = index.lengths.count() * queries.count()
    return max(queries.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))


def term_weights(queries: DataFrame, index: SparseIndex, tasks: int | None = None) -> DataFrame:
    return query_terms(queries).join(index.terms(vocabulary_of(queries), tasks), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )


def bm25_scores(queries: DataFrame, index: SparseIndex) -> DataFrame:
    """``query_id, chunk_id, score`` for every chunk that shares a term with the query."""
    tasks = scoring_tasks(queries, index)
    weights = broadcast_if_small(term_weights(queries, index, tasks), queries, TERM_GROWTH)
    avgdl = index.corpus().select("avgdl").scalar()
    tf, dl = F.col("tf"), F.col("dl")
    norm = tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / avgdl)
    gain = F.col("weight") * tf * (V.BM25_K1 + 1) / norm
    return (
        index.postings(vocabulary_of(queries), tasks)
        .join(weights, "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(gain), 8).alias("score"))
    )


def bm25_search(queries: DataFrame, index: SparseIndex, k: int) -> DataFrame:
    """Top ``k`` chunks per query with a positive score: ``query_id, chunk_id, score, rank``."""
    return top_k(bm25_scores(queries, index).where(F.col("score") > 0), k)


def title_matches(queries: DataFrame, titles: DataFrame, max_papers: int = 3) -> DataFrame:
    """Papers whose titles share rare words with the question.

    ``titles`` has ``paper_id, title`` with one row per paper. Words in more than half of the
    titles are ignored, and a match needs at least ``ln(N / 200)`` in total.
    """
    words = titles.select(
        "paper_id", T.unnest(T.ascii_word_set(F.col("title"))).alias("term")
    ).where(F.length("term") >= 2)
    n = titles.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).select("n").scalar()
    asked = queries.select(
        "query_id",
        T.unnest(T.drop_words(T.ascii_word_set(F.col("question")), V.TITLE_STOP)).alias("term"),
    )
    asked_small = broadcast_if_small(asked, queries, TERM_GROWTH)
    rare = (
        words.join(broadcast_if_small(asked.select("term").distinct(), queries, TERM_GROWTH), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("n_titles"))
        .where(F.col("n_titles") <= n * 0.5)
        .select("term", F.log(n / F.col("n_titles")).alias("weight"))
    )
    weighted = asked_small.join(rare, "term")
    scores = (
        words.join(broadcast_if_small(weighted, queries, TERM_GROWTH), "term")
        .groupBy("query_id", "paper_id")
        .agg(F.round(F.sum("weight"), 8).alias("score"))
    )
    best = top_k(scores, max_papers * 3, key="paper_id").where(F.col("score") >= F.log(n / 200.0))
    return best.where(F.col("rank") <= max_papers)
