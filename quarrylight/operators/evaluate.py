"""Evaluation: retrieval, citation and answer metrics per query, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.ranking import ranked
from quarrylight.session import settle


def first_occurrence(results: DataFrame, paper: str = "paper") -> DataFrame:
    """Distinct papers per query in rank order, ranked anew: ``query_id, <paper>, place``."""
    first = results.where(F.col(paper) != "").groupBy("query_id", paper).agg(F.min("rank").alias("rank"))
    return ranked(first, "query_id", [F.col("rank")], "place").select("query_id", paper, "place")


def retrieval_metrics(
    results: DataFrame, expected: DataFrame, queries: DataFrame, k: int, acceptable: DataFrame | None = None
) -> DataFrame:
    """Precision, recall, MRR, NDCG and hit rate at ``k`` per query.

    ``results(query_id, paper, rank)``, ``expected(query_id, paper)``; ``acceptable`` is a wider
    set used for everything but recall. Recall and NDCG are 1 when nothing is expected.
    """
    # Both are read several times and are small next to what they come from.
    papers = settle(first_occurrence(results), "ranking")
    expected = settle(expected.select("query_id", "paper").distinct(), "truth")
    wide = expected if acceptable is None else settle(acceptable.select("query_id", "paper").distinct(), "acceptable")

    def against(truth: DataFrame, prefix: str) -> DataFrame:
        hits = papers.join(truth, ["query_id", "paper"])
        inside = F.col("place") <= k
        return hits.groupBy("query_id").agg(
            F.count_if(inside).alias(f"{prefix}_hits"),
            F.min("place").alias(f"{prefix}_first"),
            F.sum(F.when(inside, 1.0 / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias(f"{prefix}_dcg"),
        )

    def size(truth: DataFrame, name: str) -> DataFrame:
        return truth.groupBy("query_id").agg(F.count("*").alias(name))

    base = queries.select("query_id")
    for frame in (against(wide, "w"), size(wide, "w_n"), against(expected, "e").select("query_id", "e_hits"), size(expected, "e_n")):
        base = base.join(frame, "query_id", "left")
    filled = base.fillna(0, ["w_hits", "w_n", "e_hits", "e_n"]).fillna(0.0, ["w_dcg"])
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("w_n"), F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda s, i: s + 1.0 / F.log2(i + 1.0),
    )
    return filled.select(
        "query_id",
        (F.col("w_hits") / k).alias("precision"),
        F.when(F.col("e_n") == 0, 1.0).otherwise(F.col("e_hits") / F.greatest("e_n", F.lit(1))).alias("recall"),
        F.coalesce(1.0 / F.col("w_first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("w_n") == 0, 1.0).otherwise(F.col("w_dcg") / ideal).alias("ndcg"),
        (F.col("w_hits") > 0).cast("double").alias("hit_rate"),
        (F.col("e_n") == 0).alias("should_deflect"),
    )


def citation_metrics(answers: DataFrame, sources: DataFrame, expected: DataFrame, acceptable: DataFrame | None = None) -> DataFrame:
    """Citation precision, recall and coverage, with density and unsupported claims.

    ``acceptable`` is a wider set of papers that count as right for precision only.

    ``answers(query_id, answer)``, ``sources(query_id, source_number, paper)``,
    ``expected(query_id, paper)``.
    """
    truth = settle(expected.select("query_id", "paper").distinct(), "truth")
    answers = settle(answers.select("query_id", "answer"), "answers")
    sources = settle(sources.select("query_id", "source_number", "paper"), "cited-sources")
    cited = answers.select("query_id", F.explode(T.cited_numbers(F.col("answer"))).alias("source_number"))
    named = cited.join(sources.select("query_id", F.col("source_number").cast("bigint"), "paper"), ["query_id", "source_number"])
    right = named.join(truth, ["query_id", "paper"], "left_semi")
    n_cited = cited.groupBy("query_id").agg(F.count("*").alias("n_cited"))
    wide = truth if acceptable is None else truth.unionByName(acceptable.select("query_id", "paper")).distinct()
    fine = named.join(wide, ["query_id", "paper"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_right"))
    found = right.groupBy("query_id").agg(F.count_distinct("paper").alias("n_papers"))
    n_right = fine.join(found, "query_id", "left")
    n_truth = truth.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    n_sources = sources.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    out = answers.select(
        "query_id",
        T.citation_density(F.col("answer")).alias("density"),
        T.unsupported_claims(F.col("answer")).alias("unsupported_claims"),
    )
    for frame in (n_cited, n_right, n_truth, n_sources):
        out = out.join(frame, "query_id", "left")
    out = out.fillna(0, ["n_cited", "n_right", "n_papers", "n_truth", "n_sources"])

    def ratio(a: str, b: str, empty: float) -> Column:
        return F.when(F.col(b) == 0, F.lit(empty)).otherwise(F.col(a) / F.greatest(b, F.lit(1)))

    return out.select(
        "query_id",
        ratio("n_right", "n_cited", 0.0).alias("precision"),
        ratio("n_papers", "n_truth", 1.0).alias("recall"),
        ratio("n_cited", "n_sources", 0.0).alias("coverage"),
        "density",
        F.col("unsupported_claims").cast("bigint").alias("unsupported_claims"),
        F.col("n_cited").alias("citations"),
    )


def confusion(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Counts, accuracy, precision (PPV), recall (TPR), F1 and FPR of a yes/no prediction."""
    counted = df.agg(
        F.count_if(gold & predicted).alias("tp"),
        F.count_if(~gold & predicted).alias("fp"),
        F.count_if(~gold & ~predicted).alias("tn"),
        F.count_if(gold & ~predicted).alias("fn"),
    )

    def safe(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counted.select(
        "tp", "fp", "tn", "fn",
        safe(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"),
        safe(fp, fp + tn).alias("fpr"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r).otherwise(1.0)).otherwise(0.0))


def grouped_means(df: DataFrame, groups: list[str], metrics: list[str], deflection: str = "deflection_correct") -> DataFrame:
    """Means over all rows and by each group column, in one pass over grouping sets.

    Metric means skip rows that should deflect; deflection accuracy covers all rows.
    """
    cols = [F.col(g) for g in groups]
    sets = [[]] + [[c] for c in cols]
    answerable = ~F.col("should_deflect")
    return df.groupingSets(sets, *cols).agg(
        F.count("*").alias("total_queries"),
        *[F.coalesce(F.avg(F.when(answerable, F.col(m))), F.lit(0.0)).alias(m) for m in metrics],
        F.avg(F.col(deflection).cast("double")).alias("deflection_accuracy"),
    )


def diagnosis_class(expected: Column, found: Column, precision: Column, recall: Column) -> Column:
    """Failure class of a citation result; ``found`` of ``expected`` papers were retrieved."""
    missing = expected > found
    return (
        F.when(missing & (found == 0), "retrieval_miss")
        .when((recall == 0) & (found > 0), "not_cited")
        .when((precision == 1) & (recall == 1), "correct")
        .when((recall > 0) & (precision < 1), "over_citation")
        .when((recall == 0) & ~missing, "wrong_source_num")
        .when(recall == 0, "not_cited")
        .otherwise("over_citation")
    )


def run_deltas(runs: DataFrame, metric: str = "metric", value: str = "value", run: str = "run_id") -> DataFrame:
    """Difference of every metric to the previous run."""
    before = F.lag(value).over(Window.partitionBy(metric).orderBy(run))
    return runs.withColumn("delta", F.round(F.col(value) - before, 4))
