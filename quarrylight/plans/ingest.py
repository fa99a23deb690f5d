"""Resumable ingest: from papers through named stages to chunks, redoing changed papers only.

A folder holds ``manifest/run=n`` (key, fingerprint of the paper as it came in; null once it is gone), ``plan/run=n``
(what the run has to do) and ``<stage>/run=n`` (what a stage made of that run's papers). Rows of a stage count
if their run is the last one the manifest names for their key, so nothing is ever rewritten and a reader
always sees whole runs: the manifest is written last. A run that was ended on the way is taken up again: its
plan is compared with the new one, and stages that were written to their end are read instead of made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.corpus import last_by_key, merge_sources

#: A stage takes the rows of the stage before it (the first one the papers) and gives rows that have the key.
Stage = tuple[str, Callable[[DataFrame], DataFrame]]
PLAN, MANIFEST = "plan", "manifest"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that was written to its end, or None."""
    try:
        spark.read.text(f"{path}/_SUCCESS").isEmpty()
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def all_runs(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/{table}")
    except AnalysisException:  # no run yet
        return None


def last_known(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    """``key, fingerprint, run`` of the last run that touched each paper."""
    rows = all_runs(spark, folder, MANIFEST)
    if rows is None:
        return None
    last = rows.groupBy(key).agg(F.max_by(F.struct("fingerprint", "run"), "run").alias("l"))
    return last.select(key, "l.fingerprint", "l.run")


def current(spark: SparkSession, folder: str, stage: str, key: str) -> DataFrame | None:
    """The rows of a stage as they stand after the last whole run."""
    rows, known = all_runs(spark, folder, stage), last_known(spark, folder, key)
    if rows is None or known is None:
        return None
    return rows.join(known.where("fingerprint IS NOT NULL").select(key, "run"), [key, "run"], "left_semi").drop("run")


def fingerprinted(papers: DataFrame, key: str) -> DataFrame:
    """One row per key with ``fingerprint``; of repeated keys the row with the largest fingerprint. Null keys are left out."""
    columns = sorted(c for c in papers.columns if c != key)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = papers.where(F.col(key).isNotNull()).withColumn("fingerprint", F.md5(F.coalesce(text, F.lit(""))))
    return last_by_key(rows, key, F.col("fingerprint"))


def planned(papers: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """``key, fingerprint`` of new and changed papers, and of papers that are gone with a null fingerprint."""
    here = papers.select(key, "fingerprint")
    if known is None:
        return here
    before = known.where("fingerprint IS NOT NULL").select(key, F.col("fingerprint").alias("was"))
    both = here.join(before, key, "full_outer")
    return both.where(~F.col("fingerprint").eqNullSafe(F.col("was"))).select(key, "fingerprint")


def digest(plan: DataFrame, key: str) -> tuple[int, int]:
    row = plan.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, "fingerprint")).alias("x")).first()
    return row["n"], row["x"] or 0


def ingest(papers: DataFrame, folder: str, key: str, stages: list[Stage]) -> DataFrame:
    """Bring the stages in ``folder`` up to date; ``run, step, n_papers, n_rows, reused`` per step.

    Steps are the plan (``n_papers`` to do, ``n_rows`` papers in all), ``gone`` and the stages.
    """
    spark = papers.sparkSession
    papers = fingerprinted(papers, key)
    runs = all_runs(spark, folder, MANIFEST)
    number = 0 if runs is None else runs.agg(F.max("run")).first()[0] + 1
    place = lambda table: f"{folder}/{table}/run={number}"
    new = planned(papers, last_known(spark, folder, key), key)
    old = stored(spark, place(PLAN))
    taken_up = old is not None and digest(old, key) == digest(new, key)
    if not taken_up:
        new.write.mode("overwrite").parquet(place(PLAN))
    plan = spark.read.parquet(place(PLAN))
    counts = plan.agg(F.count("fingerprint").alias("n"), F.count_if(F.col("fingerprint").isNull()).alias("gone")).first()
    report = [(number, PLAN, counts["n"], papers.count(), taken_up), (number, "gone", counts["gone"], 0, False)]
    rows = papers.join(plan.where("fingerprint IS NOT NULL").select(key), key, "left_semi").drop("fingerprint")
    for name, make in stages:
        done = stored(spark, place(name)) if taken_up else None
        if done is None:
            make(rows).write.mode("overwrite").parquet(place(name))
        rows = spark.read.parquet(place(name))
        report.append((number, name, rows.select(key).distinct().count(), rows.count(), done is not None))
    plan.write.mode("overwrite").parquet(place(MANIFEST))
    return spark.createDataFrame(report, "run int, step string, n_papers bigint, n_rows bigint, reused boolean")


def two_sources(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Papers of two sources under one key, rows of the left one first: what an ingest starts from."""
    return merge_sources(left, right, key)
