"""Evaluation runs as tables: one row per question, and every report as an aggregation over them.

A run table has ``run_id, query_id, topic, query_type, difficulty, expected_deflection, deflected, latency_ms`` and the
measures of ``MEANS``. A measure that was not taken is null (no expected papers, a deflected question, an error) and
counts in no mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measures of a summary and the digits a report shows.
MEANS = {
    "mrr": 4, "precision": 4, "recall": 4, "ndcg": 4, "hit_rate": 4, "faithfulness": 2, "relevance": 2,
    "citation_precision": 4, "citation_recall": 4, "citation_density": 2, "completeness": 4,
}
SPLITS = ["topic", "query_type", "difficulty"]


def mean(value: Column) -> Column:
    """Mean of what is there, 0 where nothing is."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def summary(runs: DataFrame, splits: list[str] = SPLITS) -> DataFrame:
    """Per run, and per run and value of each split: number of questions, all means, deflection accuracy, latency.

    One pass over grouping sets, so rows are read and shuffled once however many splits there are. Means leave out
    questions that should be deflected; accuracy covers questions with an outcome, latency those that took time.
    """
    answerable = ~F.coalesce("expected_deflection", F.lit(False))
    sets = [["run_id"], *(["run_id", s] for s in splits)]
    right = F.count_if(F.col("deflected") == F.coalesce("expected_deflection", F.lit(False)))
    return runs.groupingSets([[F.col(c) for c in s] for s in sets], "run_id", *splits).agg(
        F.grouping_id("run_id", *splits).alias("level"),
        F.count("*").alias("total_queries"),
        *(mean(F.when(answerable, F.col(m))).alias(m) for m in MEANS),
        share(right, F.count("deflected")).alias("deflection_accuracy"),
        mean(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("avg_latency_ms"),
    )


def shown(summaries: DataFrame) -> DataFrame:
    """A summary with the digits of a report."""
    digits = MEANS | {"deflection_accuracy": 4, "avg_latency_ms": 1}
    return summaries.withColumns({name: F.round(name, n) for name, n in digits.items()})


def citation_splits(rows: DataFrame, splits: list[str] = SPLITS) -> DataFrame:
    """Citation results over all questions, by class of failure and by each split, in one pass.

    ``rows(query_id, class, precision, recall, *splits)``, one per answerable question. ``level`` tells the grouping;
    a result is perfect at 1, zero at 0 and partial between.
    """
    keys = ["class", *splits]
    kinds = []
    for name in ("precision", "recall"):
        value = F.col(name)
        kinds += [F.count_if(value == 1).alias(f"{name}_perfect"), F.count_if(value == 0).alias(f"{name}_zero"), F.count_if((value != 0) & (value != 1)).alias(f"{name}_partial")]
    sets = [[], *([F.col(k)] for k in keys)]
    return rows.groupingSets(sets, *keys).agg(
        F.grouping_id(*keys).alias("level"), F.count("*").alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), *kinds
    )


def root_causes(rows: DataFrame) -> DataFrame:
    """``class, n, share, failure_share`` of citation results; a correct one is no failure."""
    counts = rows.groupBy("class").agg(F.count("*").alias("n"))
    total, failed = (counts.agg(F.sum(F.when(F.lit(True) if every else F.col("class") != "correct", F.col("n"))).alias("s")).select("s").scalar() for every in (True, False))
    return counts.select("class", "n", (F.col("n") / total).alias("share"), F.when(F.col("class") != "correct", F.col("n") / failed).alias("failure_share"))


def grounded_summary(rows: DataFrame, tag: str = "tag") -> DataFrame:
    """Answered grounded questions in all and by tag: ``tag`` (null for all, 'unknown' for none), ``n`` and the means.

    ``rows(query_id, tag, raf, uraf, attribution_precision, attribution_recall, attribution_f1, latency_ms)``, answered
    questions only.
    """
    named = rows.withColumn(tag, F.coalesce(F.nullif(F.col(tag), F.lit("")), F.lit("unknown")))
    measures = ("raf", "uraf", "attribution_precision", "attribution_recall", "attribution_f1")
    return named.rollup(tag).agg(F.count("*").alias("n"), *(mean(F.col(m)).alias(m) for m in measures), mean(F.col("latency_ms")).alias("avg_latency_ms"))


def annotated_summary(rows: DataFrame) -> DataFrame:
    """Case-level confusion, both rates, mean span F1 and latency of ``rows(gold, predicted, span_f1, latency_ms)``."""
    from quarrylight.operators.evaluate import confusion

    rates = confusion(rows, F.col("gold"), F.col("predicted"))
    more = rows.agg(
        F.count("*").alias("total"),
        mean(F.col("predicted").cast("double")).alias("predicted_rate"),
        mean(F.col("gold").cast("double")).alias("gold_rate"),
        mean(F.col("span_f1")).alias("mean_span_f1"),
        mean(F.col("latency_ms")).alias("avg_latency_ms"),
    )
    for name in more.columns:
        rates = rates.withColumn(name, more.select(name).scalar())
    return rates
