"""Writing results: keyed tables, runs, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.operators.corpus import upsert


def latest_version(spark: SparkSession, path: str) -> int | None:
    try:
        row = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()
    except Exception:  # nothing written yet
        return None
    return None if row is None else row[0]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    version = latest_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v{version}")


def upsert_table(incoming: DataFrame, path: str, key: str) -> int:
    """Replace rows by key in a stored table; readers see the new version once it is complete."""
    spark = incoming.sparkSession
    version = latest_version(spark, path)
    rows = incoming if version is None else upsert(spark.read.parquet(f"{path}/v{version}"), incoming, key)
    number = 0 if version is None else version + 1
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    spark.range(1).select(F.lit(number).alias("version")).write.mode("append").parquet(f"{path}/versions")
    return number


def stage_table(spark: SparkSession, path: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A named stage of a run: read if it was written to its end before, else made and written."""
    place = f"{path}/stage={name}"
    try:
        return spark.read.parquet(place)
    except AnalysisException:  # not there, or no success marker yet
        make().write.mode("overwrite").parquet(place)
        return spark.read.parquet(place)


def save_run(metrics: DataFrame, path: str, run_id: str) -> None:
    """Metrics of an experiment below ``run_id=<id>``; saving a run again replaces it."""
    metrics.write.mode("overwrite").json(f"{path}/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def history(runs: DataFrame, order: str, keep: int = V.RING_RECENT) -> DataFrame:
    return runs.orderBy(F.col(order).desc()).limit(keep)


def latest_report(spark: SparkSession, path: str, production: str = "production") -> DataFrame:
    """Rows of the newest report file; a production file wins over another of the same time."""
    rows = spark.read.json(path).select("*", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"))
    rank = F.struct("written", F.contains("file", F.lit(production)).alias("is_production"), "file")
    newest = rows.agg(F.max(rank).alias("m")).select("m.file").scalar()
    return rows.where(F.col("file") == newest)


def markdown_report(summary: DataFrame, title: str) -> DataFrame:
    """A grouped summary as one Markdown line per row, header lines first: ``line_no, line``.

    The summary has one row per group; lines are built where the rows are.
    """
    names = summary.columns
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    body = summary.select(F.lit(3).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    spark = summary.sparkSession
    head = [(0, f"# {title}"), (1, "| " + " | ".join(names) + " |"), (2, "|" + " --- |" * len(names))]
    return spark.createDataFrame(head, "line_no int, line string").unionByName(body).orderBy("line_no", "line")
