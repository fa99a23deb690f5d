"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXTS_PER_BATCH = 2000
#: What separates words in every contract here: space, tab and the four line characters after it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str | Column) -> Column:
    """The text itself; a null text counts as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fold(key: str, parts: int) -> Column:
    """Fold of a row: crc32 of the key written as text, modulo ``parts``; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows from here on: texts are long, and a task holds a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def pick(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """Only the columns an operator needs, under names of its own, so that others can't clash."""
    short_batches(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"), *(c.alias(n) for n, c in more.items())
    )


def by_bytes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that stay near ``most`` bytes (one row may be larger)."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, rows * most // max(1, batch.nbytes))
        for start in range(0, rows, step):
            yield batch.slice(start, step)
