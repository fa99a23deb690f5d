"""Benchmark runs that answer from given context and measure the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import faithfulness as Q
from quarrylight.plans.answering import answer_from_context
from quarrylight.session import settle

#: Score a given passage counts with, as nothing retrieved it.
GIVEN = 0.9


def given(entries: DataFrame, passages: str) -> DataFrame:
    """``query_id, rank, title, section, text, score`` of the passages of ``entries(query_id, <passages>)`` in their order."""
    rows = entries.select("query_id", F.posexplode(passages).alias("at", "p"))
    number = F.col("at") + 1
    return rows.select("query_id", number.alias("rank"), F.concat(F.lit("Passage "), number.cast("string")).alias("title"), F.lit("body").alias("section"), F.col("p.text").alias("text"), F.lit(GIVEN).alias("score"))


def grounded_run(entries: DataFrame) -> DataFrame:
    """Answer grounded questions from their passages and measure what was answered.

    ``entries(query_id, question, gold, tag, should_deflect, passages)`` with ``passages`` an array of ``text, is_relevant``.
    One row per entry: the answer, whether it was deflected, and null measures where it was.
    """
    entries = settle(entries.select("query_id", "question", "gold", "tag", "should_deflect", "passages"), "entries")
    out = settle(answer_from_context(entries.select("query_id", "question"), given(entries, "passages")).select("query_id", "answer", "deflected"), "answers")
    answered = out.where(~F.col("deflected")).join(entries.select("query_id", "gold"), "query_id").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("gold", F.lit("")).alias("gold"))
    passages = entries.select("query_id", F.posexplode("passages").alias("at", "p")).select("query_id", (F.col("at") + 1).alias("passage_no"), F.col("p.text").alias("text"), F.coalesce("p.is_relevant", F.lit(False)).alias("is_relevant"))
    facts = Q.relevance_aware_factuality(answered, passages).select("query_id", "raf", "uraf")
    cited = Q.attribution(answered, passages.join(answered.select("query_id"), "query_id", "left_semi")).select("query_id", *(F.col(c).alias(f"attribution_{c}") for c in ("precision", "recall", "f1")))
    rows = entries.select("query_id", "tag", "should_deflect").join(out, "query_id").join(facts, "query_id", "left").join(cited, "query_id", "left")
    return rows.withColumn("latency_ms", F.lit(None).cast("double"))


def annotated_run(entries: DataFrame, limit: float = 0.20) -> DataFrame:
    """Answer annotated prompts from their source text and look for unsupported sentences.

    ``entries(query_id, prompt, source_info, spans)`` with ``spans`` an array of ``text, type``. Gold spans are those of the
    reference reply; a deflected prompt has an empty answer and so nothing unsupported.
    """
    entries = settle(entries.select("query_id", "prompt", F.coalesce("source_info", F.lit("")).alias("source_info"), "spans"), "entries")
    context = entries.select("query_id", F.array(F.struct(F.col("source_info").alias("text"))).alias("passages"))
    out = answer_from_context(entries.select("query_id", F.col("prompt").alias("question")), given(context, "passages"))
    # The list of sources behind an answer states nothing.
    answers = settle(out.select("query_id", T.answer_body(F.coalesce("answer", F.lit(""))).alias("answer"), "deflected"), "answers")
    pairs = answers.join(entries.select("query_id", F.col("source_info").alias("context")), "query_id")
    found = Q.detect_unsupported(pairs.select("query_id", "answer", "context"), limit, "predicted_spans")
    rows = answers.join(found, "query_id").join(entries.select("query_id", "spans"), "query_id")
    gold = F.transform("spans", lambda s: s["text"])
    measured = rows.select("*", *Q.span_f1(F.col("predicted_spans"), gold))
    return measured.withColumns({"gold": F.size("spans") > 0, "predicted": F.size("predicted_spans") > 0, "latency_ms": F.lit(None).cast("double")})
