"""Approximate vector search over a stored inverted-file index, with an exact answer one parameter away.

Training groups a bounded sample of unit vectors around ``lists`` centroids (spherical k-means; the sample
is the ``sample`` vectors with the smallest hashes of their keys, the same ones on every run). Indexing sends
*every* vector to its nearest centroid, in parts of bounded size; a saved index has one folder a list, so a
search reads the folders of the lists it probes. A search probes the ``probes`` nearest
lists of every question and compares exactly inside them; ``probes = lists`` is exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.dense import PART_ROWS, grouped_candidates, unit_rows
from quarrylight.operators.ranking import top_k
from quarrylight.session import settle

INDEX_VERSION = 1
#: Vectors the centroids are learned from: the bound on what the driver holds besides the centroids.
TRAIN_SAMPLE = 20_000


@dataclass(frozen=True)
class VectorIndex:
    """``centroids`` (lists x width) and the stored rows ``list, part, chunk_id, vector`` (unit vectors)."""

    centroids: np.ndarray
    rows: DataFrame

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("list").agg(F.count("*").alias("n_vectors"))


def stacked(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in values])


def train(vectors: DataFrame, lists: int, sample: int = TRAIN_SAMPLE, rounds: int = 12, seed: int = 17) -> np.ndarray:
    """Unit centroids from a bounded sample of ``vectors(chunk_id, vector)``; fewer than ``lists`` where vectors are few.

    Starting points are drawn far apart (each next one by its distance from those before); an emptied
    centroid moves to the vector that is farthest from its own.
    """
    drawn = vectors.select("chunk_id", "vector").where("vector IS NOT NULL").orderBy(F.xxhash64(F.col("chunk_id"), F.lit(seed)), "chunk_id").limit(sample).toPandas()
    if not len(drawn):
        return np.zeros((0, 0))
    units = unit_rows(stacked(drawn["vector"]))
    lists = min(lists, len(units))
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(units)))]
    far = 1.0 - units @ units[chosen[0]]
    while len(chosen) < lists:
        weight = np.clip(far, 0, None)
        at = int(draw.choice(len(units), p=weight / weight.sum())) if weight.sum() > 1e-12 else int(np.argmax(far))
        chosen.append(at)
        far = np.minimum(far, 1.0 - units @ units[at])
    centroids = units[chosen]
    for _ in range(rounds):
        like = units @ centroids.T
        nearest = like.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        empty = np.flatnonzero(np.bincount(nearest, minlength=lists) == 0)
        sums[empty] = units[np.argsort(like.max(axis=1))[: len(empty)]]
        centroids = unit_rows(sums)
    return centroids


def build(vectors: DataFrame, lists: int, sample: int = TRAIN_SAMPLE) -> VectorIndex:
    """Index of every vector of ``vectors(chunk_id, vector)``; null vectors are in no list.

    A list that attracts a large share of all vectors is dealt over parts by key, so no task and no file
    holds it whole.
    """
    centroids = train(vectors, lists, sample)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                units = unit_rows(stacked(batch["vector"]))
                yield pd.DataFrame({"list": (units @ centroids.T).argmax(axis=1).astype(np.int32), "chunk_id": batch["chunk_id"], "vector": list(units)})

    placed = vectors.select(F.col("chunk_id").cast("bigint"), "vector").where("vector IS NOT NULL")
    placed = settle(placed.mapInPandas(place, "list int, chunk_id bigint, vector array<double>"), "placed-vectors")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    rows = placed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
    return VectorIndex(centroids, rows.select("list", "part", "chunk_id", "vector"))


def save(index: VectorIndex, path: str) -> None:
    """One folder a list, one file a part; the manifest comes last, so a half-written index is never loaded."""
    spark = index.rows.sparkSession
    index.rows.repartition("list", "part").sortWithinPartitions("list", "part", "chunk_id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    rows = [(i, c.tolist()) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    counted = index.rows.agg(F.count("*").alias("n_vectors"))
    counted.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str, expected_vectors: int | None = None) -> VectorIndex | None:
    """The saved index; None where there is none, or where its version or number of vectors is another."""
    try:
        manifest = spark.read.parquet(f"{path}/manifest").first()
    except Exception:  # no such table yet
        return None
    if manifest is None or manifest["version"] != INDEX_VERSION or expected_vectors not in (None, manifest["n_vectors"]):
        return None
    found = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()
    centroids = stacked(found["centroid"]) if len(found) else np.zeros((0, 0))
    rows = spark.read.schema("part int, chunk_id bigint, vector array<double>, list int").parquet(f"{path}/rows")
    return VectorIndex(centroids, rows)


def probed(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """``query_id, vector, list`` for the ``probes`` nearest lists of every question; centroids ride in the task."""
    centroids = index.centroids
    probes = min(probes, len(centroids))
    kind = queries.schema["query_id"].dataType.simpleString()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not probes:
                continue
            units = unit_rows(stacked(batch["vector"]))
            near = np.argsort(-(units @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pd.DataFrame({"query_id": batch["query_id"].repeat(probes), "vector": list(np.repeat(units, probes, axis=0)), "list": near.ravel()})

    return queries.select("query_id", "vector").where("vector IS NOT NULL").mapInPandas(choose, f"query_id {kind}, vector array<double>, list int")


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int) -> DataFrame:
    """Approximate cosine top ``k``: ``query_id, chunk_id, score, rank``.

    ``queries(query_id, vector)``. Questions and vectors meet by list, large and popular lists in pieces; each piece
    passes on ``k`` rows a question, so the ranking sees ``k`` rows per probe and piece.
    """
    asked = probed(queries, index, probes)
    found = grouped_candidates(asked, index.rows.select("list", "chunk_id", "vector"), ["list"], k)
    return top_k(found.select("query_id", "chunk_id", "score"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_queries, n_exact, n_found, recall``: the share of the exact neighbours that were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    total = hits.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return total.withColumn("recall", F.col("n_found") / F.greatest(F.col("n_exact"), F.lit(1)))


def scan_share(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """``scanned_share``: vectors a question is compared with, of all vectors, on average."""
    sizes = index.sizes()
    met = probed(queries, index, probes).select("query_id", "list").join(sizes, "list")
    n = sizes.agg(F.sum("n_vectors").alias("n")).select("n").scalar()
    per = met.groupBy("query_id").agg(F.sum("n_vectors").alias("seen"))
    return per.agg((F.avg("seen") / n).alias("scanned_share"))
