"""The given tables, and the views of them that play the engine's roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.sizing import broadcast_if_small

ANCHOR_WORDS = 5

# Tables whose rows are costly to process (texts, vectors), with their row key.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "conversations": "conv_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan that has fewer splits than cores out to all cores.

    A file of one row group is one split however large it is. A table of many splits is left
    alone, so nothing is shuffled on a cluster.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy parquet readers for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        # Timestamps in the tables carry no zone; epoch arithmetic reads them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table, TEXT_KEYS[name]) if name in TEXT_KEYS else table

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def chunks(self) -> DataFrame:
        """Documents as chunks: the source is the paper, the language is the section."""
        return self.documents.select(
            F.col("doc_id").alias("chunk_id"),
            F.col("source").alias("paper_id"),
            F.col("lang").alias("section"),
            (2012 + F.col("doc_id") % 14).cast("int").alias("year"),
            "text",
        )

    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))

    def relevant(self) -> DataFrame:
        """``query_id, chunk_id`` for chunks that hold the question text verbatim."""
        return verbatim_matches(self.questions(), self.chunks().select("chunk_id", "text"))

    def exchanges(self) -> DataFrame:
        """User turns with the assistant turn that follows: ``query_id, question, answer``."""
        turns = self.conversations
        user = turns.where("role = 'user'").select(
            "conv_id", "turn", F.col("text").alias("question")
        )
        reply = turns.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        pairs = user.join(reply, ["conv_id", "turn"])
        return pairs.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "question", "answer"
        )


def verbatim_matches(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact substring containment without comparing every pair.

    A text that contains a passage contains the passage's inner words as whole words, in order.
    Chunks are joined on a run of inner words (anchor) and the candidates are verified with the
    real substring test. Passages too short for a full anchor use a shorter one.
    """
    words = F.split(F.col("question"), r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    anchored = queries.select(
        "query_id",
        "question",
        F.least(F.size(inner), F.lit(ANCHOR_WORDS)).alias("span"),
        F.slice(inner, F.lit(1), F.least(F.size(inner), F.lit(ANCHOR_WORDS))).alias("head"),
    ).withColumn("anchor", F.xxhash64(F.array_join("head", " ")))
    tokens = F.split(F.col("text"), r"\s+")
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("tokens") - (ANCHOR_WORDS - 1), F.lit(1))),
        lambda i: F.xxhash64(F.array_join(F.slice("tokens", i, F.lit(ANCHOR_WORDS)), " ")),
    )
    long_side = chunks.withColumn("tokens", tokens).select(
        "chunk_id", F.explode_outer(F.array_distinct(runs)).alias("anchor")
    )
    long_queries = anchored.where(F.col("span") == ANCHOR_WORDS)
    hits = long_side.join(
        broadcast_if_small(long_queries.select("query_id", "anchor"), queries, 8), "anchor"
    ).select("query_id", "chunk_id")
    verified = (
        chunks.join(broadcast_if_small(hits.distinct(), queries, 64), "chunk_id")
        .join(broadcast_if_small(queries, queries, 2), "query_id")
        .where(F.contains("text", F.col("question")))
        .select("query_id", "chunk_id")
    )
    # Passages of fewer than seven words: one-word anchors over the few short queries.
    short = anchored.where((F.col("span") > 0) & (F.col("span") < ANCHOR_WORDS)).select(
        "query_id", "question", F.get("head", F.lit(0)).alias("word")
    )
    by_word = (
        chunks.withColumn("word", F.explode_outer(F.array_distinct(tokens)))
        .join(broadcast_if_small(short, queries, 4), "word")
        .where(F.contains("text", F.col("question")))
        .select("query_id", "chunk_id")
    )
    # Passages of one or two words have no whole inner word; as a stated, small set they meet every text.
    brief = broadcast_if_small(anchored.where((F.col("span") == 0) & (F.col("question") != "")).select("query_id", "question"), queries, 2)
    by_text = chunks.join(brief, F.contains("text", F.col("question"))).select("query_id", "chunk_id")
    return verified.unionByName(by_word).unionByName(by_text)
