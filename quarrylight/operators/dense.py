"""Dense retrieval: exact cosine search, run as one matrix product per Arrow batch.

Questions are the stated query set: they go to the tasks in blocks of bounded size, and every block
meets every vector where the vector is read. A batch keeps its best ``k`` rows per question, so it
emits at most that many however many vectors it holds, and the final ranking sees ``k`` rows per
question and batch. Vectors are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import top_k
from quarrylight.session import settle

MAX_BLOCK = 4096
#: Vectors of a group one task compares at a time, and questions it compares them with.
PART_ROWS, ASKED_ROWS = 16_384, 1_024


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def dense_matrix(values: pd.Series, hashed_dim: int | None) -> np.ndarray:
    """Rows of numbers, or rows of bucket numbers that are counted into ``hashed_dim`` columns."""
    if hashed_dim is None:
        return np.array([np.asarray(v, dtype=np.float64) for v in values])
    return np.array(
        [np.bincount(np.asarray(v, dtype=np.int64), minlength=hashed_dim) for v in values], dtype=np.float64
    )


def best_in_batch(
    query_ids: np.ndarray, query_units: np.ndarray, query_groups, ids: np.ndarray, units: np.ndarray, groups, k: int
) -> pd.DataFrame:
    """Best ``k`` of one batch for every query; equal scores go to the smaller id."""
    scores = np.round(units @ query_units.T, 8) + 0.0
    if query_groups is not None:
        scores[np.asarray(groups)[:, None] != np.asarray(query_groups)[None, :]] = -np.inf
    kept_q, kept_i, kept_s = [], [], []
    for j in range(len(query_ids)):
        column = scores[:, j]
        if len(column) > k:
            edge = -np.partition(-column, k - 1)[k - 1]
            above = np.flatnonzero(column > edge)
            ties = np.flatnonzero(column == edge)
            ties = ties[np.argsort(ids[ties], kind="stable")][: k - len(above)]
            rows = np.concatenate([above, ties])
        else:
            rows = np.arange(len(column))
        rows = rows[column[rows] > -np.inf]
        kept_q.append(np.full(len(rows), query_ids[j]))
        kept_i.append(ids[rows])
        kept_s.append(column[rows])
    return pd.DataFrame(
        {
            "query_id": np.concatenate(kept_q) if kept_q else [],
            "chunk_id": np.concatenate(kept_i) if kept_i else [],
            "score": np.concatenate(kept_s) if kept_s else [],
        }
    )


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    hashed_dim: int | None = None,
    same_group: bool = False,
) -> DataFrame:
    """Exact cosine top ``k``: ``query_id, chunk_id, score, rank``.

    ``queries(query_id, vector)`` and ``vectors(chunk_id, vector)``; with ``same_group`` both
    carry a ``group`` column and only equal groups are compared (a metadata filter per query).
    """
    group = ["group"] if same_group else []
    vectors = vectors.select("chunk_id", "vector", *group)
    schema = "query_id bigint, chunk_id bigint, score double"

    def found(block) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, units, groups = block.value
            for batch in batches:
                if len(batch):
                    numbers = unit_rows(dense_matrix(batch["vector"], hashed_dim))
                    yield best_in_batch(query_ids, units, groups, batch["chunk_id"].to_numpy(), numbers, batch["group"] if same_group else None, k)

        return vectors.mapInPandas(scan, schema)

    return top_k(over_blocks(queries.select("query_id", "vector", *group), found, hashed_dim, schema), k)


def grouped_candidates(asked: DataFrame, vectors: DataFrame, keys: list[str], k: int, hashed_dim: int | None = None) -> DataFrame:
    """Best ``k`` rows a question in every part of the groups it asks: ``query_id, *keys, chunk_id, score``.

    ``asked(query_id, vector, *keys)`` and ``vectors(chunk_id, vector, *keys)`` meet in cogroups. A group of more than
    ``PART_ROWS`` vectors is dealt into parts by chunk and one that many ask for into blocks of ``ASKED_ROWS``
    questions, so a cogroup is bounded whatever the size or the popularity of its group. A question's best
    rows of a group are the best of those its parts tell.
    """
    sizes = vectors.join(asked.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    heads = asked.groupBy(*keys).agg(F.ceil(F.count("*") / ASKED_ROWS).cast("int").alias("_blocks"))
    cuts = settle(sizes.join(heads, keys), "group-parts")
    part, block = F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    named = [F.col(key).alias(f"a_{key}") for key in keys]
    left = asked.join(cuts, keys).withColumn("b", block).withColumn("p", every("_parts")).select("query_id", "vector", "b", "p", *named)
    right = vectors.join(cuts, keys).withColumn("part", part).withColumn("block", every("_blocks")).select("chunk_id", "vector", "part", "block", *keys)
    kinds = {name: kind for name, kind in asked.dtypes}
    schema = ", ".join(f"{name} {kinds[name]}" for name in ("query_id", *keys)) + ", chunk_id bigint, score double"

    def compare(key, heads: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(heads) or not len(rows):
            return pd.DataFrame({name: [] for name in ("query_id", *keys, "chunk_id", "score")})
        rows = rows.sort_values("chunk_id", kind="stable")  # equal scores go to the smaller key
        units, told = unit_rows(dense_matrix(heads["vector"], hashed_dim)), unit_rows(dense_matrix(rows["vector"], hashed_dim))
        scores = np.round(units @ told.T, 8) + 0.0
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = {"query_id": heads["query_id"].repeat(best.shape[1]).to_numpy()}
        found |= {name: value for name, value in zip(keys, key)}
        return pd.DataFrame(found | {"chunk_id": rows["chunk_id"].to_numpy()[best].ravel(), "score": np.take_along_axis(scores, best, axis=1).ravel()})

    met = left.groupBy(*(f"a_{key}" for key in keys), "p", "b").cogroup(right.groupBy(*keys, "part", "block"))
    return met.applyInPandas(compare, schema)


def group_search(queries: DataFrame, wanted: DataFrame, chunks: DataFrame, group: str, k: int) -> DataFrame:
    """The ``k`` chunks of each wanted group that are nearest to the question: ``query_id, <group>, chunk_id, score, rank``.

    ``wanted(query_id, <group>)`` names the groups (say, papers) per question; nothing outside them is compared. Hashed
    term-frequency vectors; a group without chunks gives no rows, and repeated wishes count once.
    """
    heads = queries.select("query_id", T.hash_buckets(F.col("question")).alias("vector"))
    asked = wanted.select("query_id", group).where(F.col(group).isNotNull()).distinct().join(heads, "query_id")
    vectors = chunks.select("chunk_id", group, T.hash_buckets(F.col("text")).alias("vector"))
    found = grouped_candidates(asked.select("query_id", "vector", group), vectors, [group], k, V.HASH_DIM)
    order = Window.partitionBy("query_id", group).orderBy(F.col("score").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def over_blocks(queries: DataFrame, found: Callable[..., DataFrame], hashed_dim: int | None, schema: str) -> DataFrame:
    """``found`` of every block of questions, brought together; a block holds about half of ``MAX_BLOCK``."""
    spark = queries.sparkSession
    blocks = -(-queries.count() // (MAX_BLOCK // 2))
    parts = []
    for i in range(blocks):
        head = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        if len(head):
            groups = head["group"].to_numpy() if "group" in head else None
            parts.append(found(spark.sparkContext.broadcast((head["query_id"].to_numpy(), unit_rows(dense_matrix(head["vector"], hashed_dim)), groups))))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def hashed_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Cosine search over hashed term-frequency vectors of the texts."""
    return knn(
        queries.select("query_id", T.hash_buckets(F.col("question")).alias("vector")),
        chunks.select("chunk_id", T.hash_buckets(F.col("text")).alias("vector")),
        k,
        hashed_dim=V.HASH_DIM,
    )


def hashed_group_best(queries: DataFrame, chunks: DataFrame, group: str, most: int) -> DataFrame:
    """The ``most`` groups (say, papers) with the best cosine of any chunk per query: ``query_id, <group>, score, rank``.

    A batch passes on its own ``most`` best groups per query; a group that is beaten by as many in
    the batch of its best chunk is beaten by them everywhere. Equal scores go to the first name.
    """
    asked = queries.select("query_id", T.hash_buckets(F.col("question")).alias("vector"))
    vectors = chunks.select(F.col(group).cast("string").alias(group), T.hash_buckets(F.col("text")).alias("vector"))
    schema = f"query_id bigint, {group} string, score double"

    def found(block) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, units, _ = block.value
            for batch in batches:
                if len(batch):
                    scores = np.round(unit_rows(dense_matrix(batch["vector"], V.HASH_DIM)) @ units.T, 8) + 0.0
                    best = pd.DataFrame(scores).groupby(batch[group].to_numpy()).max()  # sorted by name
                    order = np.argsort(-best.to_numpy(), axis=0, kind="stable")[:most]
                    kept = np.take_along_axis(best.to_numpy(), order, axis=0)
                    names = best.index.to_numpy()[order]
                    yield pd.DataFrame({"query_id": np.tile(query_ids, len(order)), group: names.ravel(), "score": kept.ravel()})

        return vectors.mapInPandas(scan, schema)

    merged = over_blocks(asked, found, V.HASH_DIM, schema).groupBy("query_id", group).agg(F.max("score").alias("score"))
    return top_k(merged, most, key=group)


def hashed_vector(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse unit vectors ``key, bucket, weight`` of the hashed embedder."""
    counts = (
        df.select(key, T.unnest(T.hash_buckets(F.col(text))).alias("bucket")).where("bucket IS NOT NULL").groupBy(key, "bucket").agg(F.count("*").alias("w"))
    )
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, position by position: ``group, vector``."""
    means = (
        vectors.select(group, F.posexplode(vector).alias("pos", "x"))
        .groupBy(group, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    return means.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector")
    )


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0).cast("double"), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm))
