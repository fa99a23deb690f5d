"""Answers built from ranked sources, and the citation bookkeeping around them.

A query has at most a handful of sources, so per-query lists here are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V

# Replies when there is nothing to build an answer from.
NO_SOURCES = "I could not find relevant information to answer this question."
NO_DETAIL = "The retrieved sources do not contain sufficient detail to answer this question precisely."


def in_order(order: str, value: Column | str) -> Column:
    """Aggregate: values of a group as an array, by ``order``."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def template_answer(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """First three sentences of every source with its number: ``query_id, question, answer``.

    ``sources(query_id, source_number, text)``.
    """
    text = T.strip(F.col("text"))
    excerpt = F.array_join(F.slice(T.sentences(text), 1, 3), " ")
    usable = (F.length(text) > 20) & (F.length(excerpt) > 0)
    part = F.concat(excerpt, F.lit(" [Source "), F.col("source_number").cast("string"), F.lit("]."))
    parts = sources.select("query_id", "source_number", F.when(usable, part).alias("part"))
    built = parts.groupBy("query_id").agg(F.array_join(in_order("source_number", "part"), "\n\n").alias("answer"))
    answer = (
        F.when(F.col("answer").isNull(), NO_SOURCES).when(F.col("answer") == "", NO_DETAIL).otherwise(F.col("answer"))
    )
    return queries.join(built, "query_id", "left").select("query_id", "question", answer.alias("answer"))


def source_blocks(sources: DataFrame) -> DataFrame:
    """Numbered source blocks of the prompt: ``query_id, block``; texts are cleaned."""
    title = F.concat(F.lit("[Source "), F.col("source_number").cast("string"), F.lit("] "), F.col("paper_id"))
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")))
    section = F.when(F.col("section") != "", F.concat(F.lit(" — "), F.col("section")))
    head = F.concat(title, F.coalesce(year, F.lit("")), F.coalesce(section, F.lit("")))
    block = F.concat(head, F.lit("\n"), T.clean_math_artifacts(F.col("text")))
    return sources.groupBy("query_id").agg(F.array_join(in_order("source_number", block), "\n\n").alias("block"))


def citation_lines(sources: DataFrame) -> DataFrame:
    line = F.concat(
        F.lit("[Source "), F.col("source_number").cast("string"), F.lit("] "), F.col("paper_id"), F.lit(" — "), F.col("section")
    )
    return sources.groupBy("query_id").agg(in_order("source_number", line).alias("citations"))


def cite_words(text: Column) -> Column:
    """Distinct lower-case words of three or more ASCII letters that stand alone."""
    words = T.find_all(F.lower(text), T.WORD)
    return F.array_distinct(T.drop_words(F.filter(words, lambda w: F.rlike(w, F.lit("^[a-z]{3,}$"))), V.CITATION_STOP))


def inject_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``[Source n]`` to uncited sentences that overlap a source by 30 % or more.

    Only sentences of 30+ characters with three or more words qualify; the source with the
    largest overlap wins, the lower number on a tie.
    """
    split = answers.select("query_id", F.posexplode(T.sentences(F.col("answer"))).alias("pos", "sentence"))
    marked = split.withColumn("words", cite_words(F.col("sentence"))).withColumn(
        "open",
        (F.length("sentence") >= 30) & ~F.rlike("sentence", F.lit(r"\[Source\s+\d+\]")) & (F.size("words") >= 3),
    )
    vocab = sources.select("query_id", "source_number", cite_words(F.col("text")).alias("source_words"))
    overlap = F.size(F.array_intersect("words", "source_words")) / F.size("words")
    best = (
        marked.where("open")
        .join(vocab, "query_id")
        .groupBy("query_id", "pos")
        .agg(F.max(F.struct(overlap.alias("overlap"), (-F.col("source_number")).alias("n"))).alias("best"))
        .where(F.col("best.overlap") >= 0.3)
        .select("query_id", "pos", (-F.col("best.n")).alias("source_number"))
    )
    tag = F.concat(F.lit(" [Source "), F.col("source_number").cast("string"), F.lit("]"))
    stop = F.rlike("sentence", F.lit(r"[.!?]$"))
    body = F.substring(F.col("sentence"), F.lit(1), F.length("sentence") - 1)
    cited = F.when(stop, F.concat(body, tag, F.substring(F.col("sentence"), -1, 1))).otherwise(F.concat("sentence", tag))
    out = marked.join(best, ["query_id", "pos"], "left").withColumn(
        "sentence", F.when(F.col("source_number").isNotNull(), cited).otherwise(F.col("sentence"))
    )
    return out.groupBy("query_id").agg(F.array_join(in_order("pos", "sentence"), " ").alias("answer"))


def renumber_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop sources that are not cited and number the rest from 1 in text and list.

    Returns ``query_id, answer, kept`` with ``kept`` the old numbers in their new order. Answers
    that cite nothing, or everything, stay as they are.
    """
    sizes = sources.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    base = answers.join(sizes, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cited = F.array_distinct(F.transform(T.find_all(F.col("answer"), V.CITE_NAMED, 1), lambda d: d.cast("bigint").cast("int")))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(every, lambda i: F.array_contains(F.col("cited"), i))
    numbered = base.withColumn("cited", cited).withColumn("every", every).withColumn("kept", kept)
    moved = F.aggregate(
        F.col("kept"),
        F.col("answer"),
        lambda acc, old: F.replace(
            acc,
            F.concat(F.lit("[Source "), old.cast("string"), F.lit("]")),
            F.concat(F.lit("[__SRC_"), F.array_position(F.col("kept"), old).cast("string"), F.lit("__]")),
        ),
    )
    renamed = F.regexp_replace(moved, r"\[__SRC_(\d+)__\]", "[Source $1]")
    same = (F.size("cited") == 0) | (F.size("kept") == F.col("n"))
    return numbered.select(
        "query_id",
        F.when(same, F.col("answer")).otherwise(renamed).alias("answer"),
        F.when(same, F.col("every")).otherwise(F.col("kept")).alias("kept"),
    )


def per_source_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """How often every source is cited: inline, or once when only the trailing block lists it."""
    body, footer = T.answer_body(F.col("answer")), T.answer_footer(F.col("answer"))
    number = r"\[(?:Source\s+)?(\d+)\]"
    marks = answers.select(
        "query_id",
        F.transform(T.find_all(body, number, 1), lambda d: d.cast("bigint")).alias("inline"),
        F.transform(T.find_all(footer, number, 1), lambda d: d.cast("bigint")).alias("listed"),
    )
    n = F.col("source_number").cast("bigint")
    inline = F.size(F.filter("inline", lambda d: d == n))
    footer_only = (inline == 0) & F.array_contains("listed", n)
    return sources.join(marks, "query_id").select(
        "query_id",
        "source_number",
        (inline + footer_only.cast("int")).cast("bigint").alias("citation_count"),
        footer_only.alias("footer_only"),
    )
