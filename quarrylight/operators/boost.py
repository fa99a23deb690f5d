"""Boosting landmark papers, age factors, diversification. All frames are keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.ranking import ranked
from quarrylight.operators.sizing import broadcast_if_small


def landmark_table(spark: SparkSession) -> DataFrame:
    """The fixed table of landmark papers: ``paper_key, title, boost, year``."""
    return spark.createDataFrame(V.LANDMARK_PAPERS, "paper_key string, title string, boost double, year int")


def topic_papers(queries: DataFrame) -> DataFrame:
    """Landmark ids whose topics the question mentions; none when it asks for recent work.

    The topic table is a constant of some fifty entries, so the substring match is a projection.
    """
    lowered = F.lower(F.col("question"))
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.contains(lowered, F.lit(topic)), F.array(*[F.lit(i) for i in ids]))
                for topic, ids in V.TOPIC_PAPERS.items()
            ]
        )
    )
    asked = queries.where(T.query_intent(F.col("question")) != "recent")
    return asked.select("query_id", F.explode(F.array_sort(F.array_distinct(F.flatten(hits)))).alias("paper_key"))


def age_factor(year: Column, intent: Column) -> Column:
    old, even = (F.coalesce(*[F.when(year <= until, f) for until, f in V.AGE_FACTORS[kind]], F.lit(1.0)) for kind in ("foundational", "balanced"))
    new = F.coalesce(*[F.when(year >= since, f) for since, f in V.RECENT_FACTORS], F.lit(V.RECENT_REST))
    by_intent = F.when(intent == "foundational", old).when(intent == "recent", new).otherwise(even)
    return F.when(year.isNull(), 1.0).otherwise(by_intent)


def boost_results(results: DataFrame, intents: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Scale scores by landmark and age factors and re-rank.

    ``results(query_id, chunk_id, score, paper_key, year)``, ``intents(query_id, intent)``,
    ``landmarks(paper_key, boost)``. For foundational questions landmark rows are raised to the
    75 % point of the boosted scores.
    """
    factors = broadcast_if_small(landmarks.select("paper_key", "boost"), landmarks)
    joined = results.join(intents, "query_id", "left").join(factors, "paper_key", "left")
    intent = F.coalesce("intent", F.lit("balanced"))
    boosted = joined.select(
        *results.columns,
        intent.alias("intent"),
        F.coalesce("boost", F.lit(1.0)).alias("landmark_factor"),
        age_factor(F.col("year"), intent).alias("age_factor"),
    ).withColumn("boosted", F.round(F.col("score") * F.col("landmark_factor") * F.col("age_factor"), 10))
    whole = Window.partitionBy("query_id")
    nth = F.row_number().over(whole.orderBy(F.col("boosted").desc()))
    size = F.count("*").over(whole)
    pick = F.when(F.col("n") >= 4, F.floor(F.col("n") / 4) + 1).otherwise(F.col("n"))
    floor = F.max(F.when(F.col("nth") == pick, F.col("boosted"))).over(whole)
    lifted = boosted.withColumn("nth", nth).withColumn("n", size).withColumn("floor", floor)
    needs = (F.col("intent") == "foundational") & (F.col("landmark_factor") > 1.0)
    final = F.when(needs, F.greatest("boosted", "floor")).otherwise(F.col("boosted"))
    rest = [c for c in results.columns if c not in ("score", "rank")]
    out = lifted.select(
        *rest, F.col("score").alias("original_score"), final.alias("score"), "landmark_factor", "age_factor"
    )
    return ranked(out, "query_id", [F.col("score").desc(), F.col("chunk_id")])


def diversify(results: DataFrame, k: int = 5, per_paper: int = 2, landmarks: DataFrame | None = None) -> DataFrame:
    """At most ``per_paper`` rows of a paper, then the best ``k``; keeps one landmark row.

    ``results(query_id, chunk_id, paper_id, score, rank)`` (and ``paper_key`` with ``landmarks``).
    When no selected row is a landmark but some result is, the best such row takes the last place,
    or is appended when there is room.
    """
    seat = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("rank"))
    capped = results.withColumn("seat", seat).where(F.col("seat") <= per_paper).drop("seat")
    chosen = ranked(capped, "query_id", [F.col("rank")], "place").where(F.col("place") <= k)
    if landmarks is None:
        return chosen
    marks = broadcast_if_small(landmarks.select("paper_key", F.lit(True).alias("mark")), landmarks)
    flagged = chosen.join(marks, "paper_key", "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    state = flagged.groupBy("query_id").agg(F.max("mark").alias("has_mark"), F.count("*").alias("n_chosen"))
    total = results.groupBy("query_id").agg(F.count("*").alias("n_all"))
    best_mark = ranked(results.join(marks, "paper_key", "left_semi"), "query_id", [F.col("rank")], "nth").where("nth = 1")
    needs = state.join(total, "query_id").where(~F.col("has_mark") & (F.col("n_all") > F.col("n_chosen")))
    extra = (
        best_mark.drop("nth")
        .join(needs, "query_id")
        .withColumn("place", F.least(F.col("n_chosen") + 1, F.lit(k)).cast("int"))
        .select(*chosen.columns)
    )
    replaced = chosen.join(extra.select("query_id", "place"), ["query_id", "place"], "left_anti").select(*chosen.columns)
    return replaced.unionByName(extra)
