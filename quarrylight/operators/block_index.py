"""Sparse search over a stored index: postings in blocks of chunks, with the best gain of a term in each block.

Chunks are put in an order that keeps likely neighbours together (say, language and paper) and cut into blocks
of ``BLOCK`` chunks, the same for every term. For each term and block the index keeps the largest gain a
chunk of the block gets from the term, so the sum over a question's terms bounds every score in a block.
A search scores the most promising blocks of each question first; their ``k``-th score is a floor, and only
blocks whose bound reaches it are read at all. The result is the exact top ``k``.

Blocks are part of every join key, so a term that a third of all chunks hold is met in as many pieces
as it has blocks. The corpus text isn't read again once the index is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import ranked, top_k
from quarrylight.operators.sizing import broadcast_if_small
from quarrylight.operators.sparse import TERM_GROWTH, query_terms
from quarrylight.session import settle

INDEX_VERSION = 1
#: A block is 2 ** BLOCK_BITS chunks; folders a term can lie in; blocks scored before there is a floor.
BLOCK_BITS, TERM_FOLDERS, FIRST_BLOCKS = 7, 64, 8


@dataclass(frozen=True)
class BlockIndex:
    """``postings(folder, term, block, chunk_id, dl, tf)``, ``blocks(term, block, best, n)``, ``terms(term, df)``, ``corpus(n_docs, avgdl)``."""

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame


def gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a posting adds to a score, per unit of its term's weight."""
    return tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * dl / avgdl))


def store(chunks: DataFrame, path: str, order: tuple[str, ...] = ("chunk_id",)) -> None:
    """Index ``chunks(chunk_id, text, *order)``; the corpus row comes last and marks the index as whole.

    Null and empty texts count as chunks of length 0. The order decides how much a search can skip, never what
    it finds. Nothing is numbered globally: a block is a run of rows within a range partition.
    """
    spark = chunks.sparkSession
    tokens = chunks.select("chunk_id", *(c for c in order if c != "chunk_id"), T.index_tokens(F.col("text")).alias("tokens"))
    placed = tokens.repartitionByRange(*order, "chunk_id").sortWithinPartitions(*order, "chunk_id")
    placed = placed.select("chunk_id", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"), F.size("tokens").alias("dl"), "tokens")
    placed = settle(placed, "index-tokens")
    counted = placed.select("chunk_id", "block", "dl", F.explode("tokens").alias("term")).groupBy("chunk_id", "block", "dl", "term")
    counted = counted.agg(F.least(F.count("*"), F.lit(V.BM25_TF_CAP)).alias("tf"))
    counted = counted.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(TERM_FOLDERS)).cast("int"))
    # A folder holds the postings of its terms; a hot term's are dealt over tasks by block.
    dealt = counted.repartition("folder", F.pmod("block", F.lit(16))).sortWithinPartitions("folder", "term", "block")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    postings = open_postings(spark, path)
    corpus = placed.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).withColumn("version", F.lit(INDEX_VERSION))
    corpus.write.mode("overwrite").parquet(f"{path}/sums")
    avgdl = spark.read.parquet(f"{path}/sums").select("avgdl").scalar()
    best = postings.groupBy("term", "block").agg(F.max(gain(F.col("tf"), F.col("dl"), avgdl)).alias("best"), F.count("*").alias("n"))
    best.repartition("term").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    df = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
    df.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    spark.read.parquet(f"{path}/sums").write.mode("overwrite").parquet(f"{path}/corpus")


def open_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id bigint, block bigint, dl int, term string, tf bigint, folder int").parquet(f"{path}/postings")


def load(spark: SparkSession, path: str, expected_docs: int | None = None) -> BlockIndex | None:
    """The stored index; None where there is none, or where its version or number of chunks is another."""
    try:
        corpus = spark.read.parquet(f"{path}/corpus")
        row = corpus.first()
    except Exception:  # no such table yet
        return None
    if row is None or row["version"] != INDEX_VERSION or expected_docs not in (None, row["n_docs"]):
        return None
    return BlockIndex(open_postings(spark, path), spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), corpus)


def bounds(queries: DataFrame, index: BlockIndex) -> DataFrame:
    """``query_id, block, term, weight, bound`` for every block that holds a term of a question."""
    asked = query_terms(queries)
    n, df = index.corpus.select("n_docs").scalar(), F.col("df")
    weights = index.terms.join(broadcast_if_small(asked, queries, TERM_GROWTH), "term")
    weights = weights.select("query_id", "term", (F.col("qtf") * F.log((n - df + 0.5) / (df + 0.5) + 1.0)).alias("weight"))
    met = index.blocks.join(broadcast_if_small(weights, queries, TERM_GROWTH), "term")
    return met.select("query_id", "block", "term", "weight", (F.col("weight") * F.col("best")).alias("bound"))


def scored(wanted: DataFrame, index: BlockIndex) -> DataFrame:
    """Exact scores of all chunks in ``wanted(query_id, block, term, weight)``."""
    avgdl = index.corpus.select("avgdl").scalar()
    wanted = wanted.withColumn("folder", F.pmod(F.xxhash64("term"), F.lit(TERM_FOLDERS)).cast("int"))
    met = index.postings.join(wanted, ["folder", "term", "block"])
    score = F.round(F.sum(F.col("weight") * gain(F.col("tf"), F.col("dl"), avgdl)), 8)
    return met.groupBy("query_id", "chunk_id").agg(score.alias("score"))


@dataclass(frozen=True)
class Plan:
    """A search's blocks: ``first`` are scored to find a floor, ``rest`` are those whose bound reaches it."""

    hits: DataFrame
    first: DataFrame
    rest: DataFrame
    met: DataFrame


def search_plan(queries: DataFrame, index: BlockIndex, k: int, first_blocks: int = FIRST_BLOCKS) -> Plan:
    """The search with its intermediate tables, which are stored as each is read more than once."""
    met = settle(bounds(queries, index), "block-bounds")
    by_block = met.groupBy("query_id", "block").agg(F.sum("bound").alias("most"))
    by_block = settle(ranked(by_block, "query_id", [F.col("most").desc(), F.col("block")], "place"), "block-places")
    first = by_block.where(F.col("place") <= first_blocks).select("query_id", "block")
    early = settle(top_k(scored(met.join(first, ["query_id", "block"], "left_semi"), index).where("score > 0"), k), "early-hits")
    floors = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    later = by_block.where(F.col("place") > first_blocks).join(floors, "query_id", "left")
    # Scores are rounded: a bound that falls short of the floor by less than a rounding unit still counts.
    rest = settle(later.where(F.col("most") * (1 + 1e-9) + 1e-7 >= F.coalesce("floor", F.lit(0.0))).select("query_id", "block"), "later-blocks")
    late = scored(met.join(rest, ["query_id", "block"], "left_semi"), index).where("score > 0")
    both = early.select("query_id", "chunk_id", "score").unionByName(late)
    return Plan(top_k(both, k), first, rest, met)


def search(queries: DataFrame, index: BlockIndex, k: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """Exact top ``k`` chunks per question with a positive score: ``query_id, chunk_id, score, rank``."""
    return search_plan(queries, index, k, first_blocks).hits


def read_share(plan: Plan) -> DataFrame:
    """``n_met, n_read, share``: question-and-block pairs that share a term, and those whose postings were read."""
    met = plan.met.select("query_id", "block").distinct().agg(F.count("*").alias("n_met"))
    read = plan.first.unionByName(plan.rest).agg(F.count("*").alias("n_read"))
    return met.withColumn("n_read", read.select("n_read").scalar()).withColumn("share", F.col("n_read") / F.greatest("n_met", F.lit(1)))
