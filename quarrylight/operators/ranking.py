"""Per-query ranking. ``row_number`` below a filter plans a group limit before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, query: str, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(query).orderBy(*order)))


def top_k(df: DataFrame, k: int, query: str = "query_id", score: str = "score", key: str = "chunk_id") -> DataFrame:
    """Best ``k`` rows per query; equal scores go by key, so the result is the same on every run."""
    return ranked(df, query, [F.col(score).desc(), F.col(key).asc()]).where(F.col("rank") <= k)
