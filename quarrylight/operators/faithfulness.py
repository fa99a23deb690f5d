"""How well an answer is backed by its context. Token sets are arrays per row: no pairs are built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets given as arrays of distinct tokens; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def detect_unsupported(pairs: DataFrame, limit: float = 0.20, name: str = "spans") -> DataFrame:
    """``pairs(query_id, answer, context)`` with the flagged sentences as an array column.

    Sentences are exploded so that the context word set is computed once per row, not once per
    sentence.
    """
    known = pairs.select("query_id", "answer", "context", T.drop_words(T.word_set(F.col("context")), V.DETECTOR_STOP).alias("known"))
    split = known.select("query_id", "context", "known", F.posexplode_outer(T.sentences(F.col("answer"))).alias("pos", "sentence"))
    words = split.withColumn("words", T.drop_words(T.word_set(F.col("sentence")), V.DETECTOR_STOP))
    n = F.size("words")
    bad = (F.length("context") > 0) & (n >= 3) & (F.size(F.array_intersect("words", "known")) < limit * n)
    marked = words.select("query_id", "pos", F.when(bad, F.col("sentence")).alias("sentence"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("pos", "sentence"))))
    return marked.groupBy("query_id").agg(F.transform(ordered, lambda p: p["sentence"]).alias(name))


def span_f1(predicted: Column, gold: Column) -> list[Column]:
    """Precision, recall and F1 of two span lists by their token sets."""
    p = F.array_distinct(F.flatten(F.transform(predicted, T.word_list)))
    g = F.array_distinct(F.flatten(F.transform(gold, T.word_list)))
    common = F.size(F.array_intersect(p, g))
    no_p, no_g = F.size(predicted) == 0, F.size(gold) == 0
    both = (no_p & no_g) | (~no_p & ~no_g & (F.size(p) == 0) & (F.size(g) == 0))
    precision = F.when(both, 1.0).when(no_p | no_g, 0.0).otherwise(T.share(F.array_intersect(p, g), p))
    recall = F.when(both, 1.0).when(no_p, 0.0).when(no_g, 1.0).otherwise(T.share(F.array_intersect(p, g), g))
    f1 = F.when(both, 1.0).when(common > 0, 2.0 * common / (F.size(p) + F.size(g))).otherwise(0.0)
    return [precision.alias("span_precision"), recall.alias("span_recall"), f1.alias("span_f1")]


def span_offset(text: Column, span: Column) -> Column:
    """0-based position of a span in a text, ignoring case; null when absent or empty."""
    needle = F.lower(T.strip(span))
    at = F.instr(F.lower(text), needle)
    return F.when((F.length(needle) > 0) & (at > 0), at - 1)


def faithfulness(pairs: DataFrame) -> DataFrame:
    """Score 1..5 from content-word overlap of answer sentences with the context."""
    rows = pairs.select("query_id", T.answer_body(F.col("answer")).alias("body"), T.content_words(F.col("context")).alias("known"))
    pieces = F.filter(
        F.transform(F.split("body", r"[.!?]+"), T.strip), lambda s: F.length(s) > 15
    )
    split = rows.select("query_id", "known", F.explode_outer(pieces).alias("sentence"))
    words = split.withColumn("words", T.content_words(F.col("sentence")))
    counted = (F.size("words") >= 4) & (F.size("known") > 0)
    overlap = F.when(counted, F.size(F.array_intersect("words", "known")) / F.size("words"))
    return words.groupBy("query_id").agg(F.coalesce(1.0 + 4.0 * F.avg(overlap), F.lit(1.0)).alias("faithfulness"))


def judge_fallback(pairs: DataFrame) -> DataFrame:
    """Score 1..5 from overlap of white-space words, every non-empty sentence counting."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0))
    rows = pairs.select("query_id", "answer", words(F.col("context")).alias("known"))
    pieces = F.filter(F.transform(F.split("answer", r"[.!?]+"), T.strip), lambda s: F.length(s) > 0)
    split = rows.select("query_id", "known", F.explode_outer(pieces).alias("sentence")).withColumn("words", words(F.col("sentence")))
    overlap = F.size(F.array_intersect("words", "known")) / F.size("words")
    score = F.coalesce(1.0 + 4.0 * F.avg(F.when(F.col("sentence").isNotNull(), overlap)), F.lit(1.0))
    return split.groupBy("query_id").agg(F.least(F.lit(5.0), F.greatest(F.lit(1.0), score)).alias("score"))


def relevance_aware_factuality(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Factuality of answers against relevant and irrelevant passages, weighted and unweighted.

    ``answers(query_id, answer, gold)``, ``passages(query_id, is_relevant, text)``. Tokens are
    joined, not passages: an answer token is relevant when a relevant passage has it, irrelevant
    when only other passages do.
    """
    tokens = answers.select("query_id", T.unnest(T.word_set(F.col("answer"))).alias("token")).where("token IS NOT NULL")
    known = (
        passages.select("query_id", "is_relevant", T.unnest(T.word_set(F.col("text"))).alias("token"))
        .where("token IS NOT NULL")
        .groupBy("query_id", "token")
        .agg(F.max("is_relevant").alias("relevant"))
    )
    shares = (
        tokens.join(known, ["query_id", "token"], "left")
        .groupBy("query_id")
        .agg(
            (F.count_if(F.col("relevant")) / F.count("*")).alias("relevant_overlap"),
            (F.count_if(~F.col("relevant")) / F.count("*")).alias("irrelevant_overlap"),
            (F.count("relevant") / F.count("*")).alias("passage_overlap"),
        )
    )
    gold = answers.select(
        "query_id",
        (F.length("gold") > 0).alias("has_gold"),
        token_f1(T.word_set(F.col("answer")), T.word_set(F.col("gold"))).alias("gold_f1"),
    )
    joined = gold.join(shares, "query_id", "left").fillna(0.0, ["relevant_overlap", "irrelevant_overlap", "passage_overlap"])
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("relevant_overlap") - F.col("irrelevant_overlap")))

    def blend(score: Column) -> Column:
        return F.when(F.col("has_gold"), 0.7 * score + 0.3 * F.col("gold_f1")).otherwise(score)

    return joined.select(
        "query_id", blend(clipped).alias("raf"), blend(F.col("passage_overlap")).alias("uraf"),
        "relevant_overlap", "irrelevant_overlap", "passage_overlap",
    )


def attribution(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Are the cited passages the relevant ones? ``passages(query_id, passage_no, is_relevant)``."""
    number = r"\[(?:Source\s+)?(\d+)\]"
    cited = answers.select("query_id", F.explode(T.find_all(F.col("answer"), number, 1)).alias("n")).select(
        "query_id", F.col("n").cast("bigint").alias("passage_no")
    ).distinct()
    state = passages.select("query_id", F.col("passage_no").cast("bigint"), "is_relevant").join(
        cited.withColumn("cited", F.lit(True)), ["query_id", "passage_no"], "left"
    )
    sums = state.groupBy("query_id").agg(
        F.count_if(F.col("cited")).alias("n_cited"),
        F.count_if(F.col("is_relevant")).alias("n_relevant"),
        F.count_if(F.col("cited") & F.col("is_relevant")).alias("n_both"),
    )
    c, r, b = F.col("n_cited"), F.col("n_relevant"), F.col("n_both")
    neither = (c == 0) & (r == 0)
    precision = F.when(neither, 1.0).when(c == 0, 0.0).otherwise(b / F.greatest(c, F.lit(1)))
    recall = F.when(r == 0, 1.0).otherwise(b / F.greatest(r, F.lit(1)))
    rated = sums.select("query_id", precision.alias("precision"), recall.alias("recall"))
    p, q = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + q > 0, 2 * p * q / F.when(p + q > 0, p + q).otherwise(1.0)).otherwise(0.0))


def normal_type(name: Column) -> Column:
    """One of five span types, whatever the spelling."""
    t = F.lower(T.strip(name))
    evident, subtle = F.contains(t, F.lit("evident")), F.contains(t, F.lit("subtle"))
    conflict, baseless = F.contains(t, F.lit("conflict")), F.contains(t, F.lit("baseless"))
    return (
        F.when(evident & conflict, "Evident Conflict")
        .when(subtle & conflict, "Subtle Conflict")
        .when(evident & baseless, "Evident Baseless")
        .when(subtle & baseless, "Subtle Baseless")
        .when(conflict, "Evident Conflict")
        .when(baseless, "Evident Baseless")
        .otherwise("Other")
    )


def spans_by_type(spans: DataFrame) -> DataFrame:
    """``spans(side, span_type)`` with side gold or predicted: counts and share of gold per type."""
    counts = spans.groupBy(normal_type(F.col("span_type")).alias("span_type")).agg(
        F.count_if(F.col("side") == "gold").alias("gold_count"),
        F.count_if(F.col("side") == "predicted").alias("predicted_count"),
    )
    total = counts.agg(F.sum("gold_count").alias("t")).select("t").scalar()
    return counts.withColumn("gold_rate", F.when(total > 0, F.col("gold_count") / total).otherwise(F.lit(0.0)))
