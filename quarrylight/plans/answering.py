"""Full answers: retrieve, boost, diversify, gate, write, cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import gatetext
from quarrylight.functions import text as T
from quarrylight.operators import answers as A
from quarrylight.operators import boost, fusion, gates, routing
from quarrylight.operators.corpus import preferred_chunks
from quarrylight.operators.ranking import ranked
from quarrylight.plans.hybrid import hybrid_search
from quarrylight.session import settle

# Fixed value: chunks of a topic paper that may be injected.
INJECTED = 5


def text_gates(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entity and premise verdicts per question: ``query_id, entity_reason, premise_reason``.

    Each check reads as many of the best results as it is stated for; a question has ten at most.
    """
    top = results.where(F.col("rank") <= gates.PAPER_RESULTS).select("query_id", "chunk_id", "rank")
    rows = chunks.select("chunk_id", F.col("paper_id").cast("string").alias("title"), "text").join(top, "chunk_id")
    read = lambda most, value: F.when(F.col("rank") <= most, value)
    evidence = rows.groupBy("query_id").agg(
        F.lower(F.array_join(A.in_order("rank", read(gates.ENTITY_RESULTS, F.col("text"))), " ")).alias("body"),
        F.lower(F.array_join(F.array_distinct(A.in_order("rank", read(gates.ENTITY_RESULTS, F.col("title")))), " ")).alias("heads"),
        F.lower(F.array_join(A.in_order("rank", read(gates.PREMISE_RESULTS, F.col("text"))), " ")).alias("top"),
        A.in_order("rank", F.struct("title", "text")).alias("papers"),
    )
    evidence = settle(evidence, "evidence")
    asked = queries.select("query_id", "question")
    found = gates.entity_verdicts(asked, evidence).join(gates.premise_verdicts(asked, evidence), "query_id")
    return found.select("query_id", "entity_reason", "premise_reason")


def early_reason(queries: DataFrame) -> DataFrame:
    """``query_id, reason`` before anything is searched: off topic, an opinion, or ''."""
    q = F.col("question")
    return queries.select("query_id", F.when(~T.is_on_topic(q), "off_topic").when(T.is_opinion(q), "opinion").otherwise("").alias("reason"))


def gate_reason(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """First reason not to answer from these results, checked in a fixed order; '' when it may be answered."""
    texts = chunks.select("chunk_id", "text")
    score = routing.gate(results, queries).select("query_id", F.col("reason").alias("score_reason"))
    overlap = routing.overlap_gate(results, queries, texts).select("query_id", F.col("deflect").alias("low_overlap"))
    focal = routing.focal_gate(results, queries, texts).select("query_id", F.col("deflect").alias("focal"))
    joined = score.join(overlap, "query_id", "left").join(text_gates(results, queries, chunks), "query_id").join(focal, "query_id")
    reason = F.coalesce(
        F.nullif("score_reason", F.lit("")),
        F.when(F.col("low_overlap"), "low_overlap"),
        F.nullif("entity_reason", F.lit("")),
        F.nullif("premise_reason", F.lit("")),
        F.when(F.col("focal"), "focal_term"),
        F.lit(""),
    )
    return joined.select("query_id", reason.alias("reason"))


def with_topic_paper(chosen: DataFrame, pool: DataFrame, topics: DataFrame) -> DataFrame:
    """Selections that hold no paper of the question's topics take in the best one of the pool.

    It gets place 2 and the last row gives way. ``chosen`` has ``place``, ``pool`` its ``rank``.
    """
    keys = ["query_id", "paper_key"]
    covered = chosen.join(topics, keys, "left_semi").select("query_id").distinct()
    best = ranked(pool.join(topics, keys, "left_semi"), "query_id", [F.col("rank")], "nth").where("nth = 1").drop("nth")
    best = best.join(covered, "query_id", "left_anti")
    last = chosen.groupBy("query_id").agg(F.max("place").alias("last"))
    moved = chosen.join(last, "query_id").join(best.select("query_id", F.lit(True).alias("moves")), "query_id", "left")
    stays = moved.where(F.col("moves").isNull() | (F.col("place") < F.col("last")))
    place = F.col("place") + F.when(F.col("moves") & (F.col("place") >= 2), 1).otherwise(0)
    kept = stays.withColumn("place", place.cast("int")).select(chosen.columns)
    added = best.join(last, "query_id").withColumn("place", F.least(F.lit(2), F.col("last")).cast("int")).select(chosen.columns)
    return kept.unionByName(added)


def with_landmark(picked: DataFrame, results: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Sources that lost their landmark paper to the filter get the best one back in the last place."""
    marks = landmarks.select("paper_key").distinct()
    covered = picked.join(marks, "paper_key", "left_semi").select("query_id").distinct()
    best = ranked(results.join(marks, "paper_key", "left_semi"), "query_id", [F.col("rank")], "nth").where("nth = 1").drop("nth")
    last = picked.groupBy("query_id").agg(F.max("source_number").alias("source_number"))
    added = best.join(covered, "query_id", "left_anti").join(last, "query_id").select(picked.columns)
    return picked.join(added.select("query_id", "source_number"), ["query_id", "source_number"], "left_anti").select(picked.columns).unionByName(added)


def selected(queries: DataFrame, chunks: DataFrame, landmarks: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """The ``k`` results an answer is written from: retrieved with injections, boosted, one per paper.

    Five times as many candidates are searched, fifty at most.
    """
    meta = chunks.select("chunk_id", "paper_id", "section", "year", "paper_key")
    asked = topics.join(queries.select("query_id"), "query_id", "left_semi")
    papers = chunks.drop("paper_id").withColumnRenamed("paper_key", "paper_id")
    wanted = preferred_chunks(papers, asked.select(F.col("paper_key").alias("paper_id")).distinct(), INJECTED)
    wanted = wanted.select(F.col("paper_id").alias("paper_key"), "chunk_id", F.col("nth").alias("inject_rank"))
    found = hybrid_search(queries, chunks, min(5 * k, 50), injections=asked.join(wanted, "paper_key").select("query_id", "chunk_id", "inject_rank"))
    intents = queries.select("query_id", T.query_intent(F.col("question")).alias("intent"))
    pool = settle(boost.boost_results(meta.join(found, "chunk_id").drop("rank", "injected"), intents, landmarks), "boosted")
    chosen = settle(boost.diversify(pool, k, 1, landmarks), "chosen")
    return with_topic_paper(chosen, pool, asked)


def answer_questions(queries: DataFrame, chunks: DataFrame, landmarks: DataFrame, topics: DataFrame | None = None, k: int = 5) -> DataFrame:
    """``query_id, answer, citations, deflected, reason``.

    ``chunks`` may name the paper landmarks and topics are about in ``paper_key`` (the chunk itself
    by default); ``topics(query_id, paper_key)`` defaults to the fixed topics a question mentions.
    Questions that are off topic or ask for an opinion are not searched. Questions over several
    documents use five results more. Landmark papers are boosted and keep a place; papers of the
    question's topics are injected and get a place; one chunk per paper is used.
    """
    chunks = chunks if "paper_key" in chunks.columns else chunks.withColumn("paper_key", F.col("chunk_id"))
    kind = chunks.schema["paper_key"].dataType
    topics = boost.topic_papers(queries) if topics is None else topics
    topics = settle(topics.select("query_id", F.col("paper_key").try_cast(kind).alias("paper_key")).where("paper_key is not null").distinct(), "topics")
    early = early_reason(queries)
    asked = settle(queries.join(early.where("reason = ''").select("query_id"), "query_id", "left_semi"), "asked")
    several = T.is_multi_document(F.col("question"))
    one = selected(asked.where(~several), chunks, landmarks, topics, k)
    wide = selected(asked.where(several), chunks, landmarks, topics, max(k, min(15, k + 5)))
    results = settle(one.unionByName(wide).withColumn("rank", F.col("place")).select("query_id", "chunk_id", "paper_id", "paper_key", "section", "score", "rank"), "results")
    reasons = settle(early.where("reason <> ''").unionByName(gate_reason(results, asked, chunks)), "reasons")
    open_ = queries.join(reasons.where("reason = ''").select("query_id"), "query_id", "left_semi")
    allowed = results.join(open_.select("query_id"), "query_id", "left_semi")
    picked = with_landmark(fusion.filter_sources(allowed), allowed, landmarks)
    sources = settle(chunks.select("chunk_id", "text").join(picked, "chunk_id"), "sources")
    return written_answers(queries, open_, sources, reasons)


def answer_from_context(queries: DataFrame, context: DataFrame) -> DataFrame:
    """Answers from results that are given, as ``answer_questions`` writes them: no search, no boosting.

    ``context(query_id, rank, title, section, text, score)``: passages in order, titles as papers.
    A question without passages is deflected by the gate.
    """
    rows = context.withColumn("chunk_id", F.xxhash64("query_id", "rank"))
    chunks = rows.select("chunk_id", F.col("title").alias("paper_id"), "text")
    results = settle(rows.select("query_id", "chunk_id", F.col("title").alias("paper_id"), "section", "score", "rank"), "given")
    early = early_reason(queries)
    asked = settle(queries.join(early.where("reason = ''").select("query_id"), "query_id", "left_semi"), "asked")
    reasons = settle(early.where("reason <> ''").unionByName(gate_reason(results, asked, chunks)), "reasons")
    open_ = queries.join(reasons.where("reason = ''").select("query_id"), "query_id", "left_semi")
    picked = fusion.filter_sources(results.join(open_.select("query_id"), "query_id", "left_semi"))
    return written_answers(queries, open_, settle(chunks.select("chunk_id", "text").join(picked, "chunk_id"), "sources"), reasons)


def written_answers(queries: DataFrame, open_: DataFrame, sources: DataFrame, reasons: DataFrame) -> DataFrame:
    """Write, cite, renumber and check the answers of the open questions; the others keep their reason."""
    written = A.template_answer(open_, sources).select("query_id", gatetext.promote_equations(gatetext.postprocess_math(F.col("answer"))).alias("answer"))
    cited = settle(A.inject_citations(written, sources), "cited")
    renumbered = A.renumber_citations(cited, sources)
    kept = renumbered.select("query_id", F.posexplode("kept").alias("pos", "source_number"))
    lines = sources.join(kept, ["query_id", "source_number"]).select(
        "query_id",
        "pos",
        F.concat(F.lit("[Source "), (F.col("pos") + 1).cast("string"), F.lit("] "), "paper_id", F.lit(" — "), "section").alias("line"),
    )
    citations = lines.groupBy("query_id").agg(A.in_order("pos", "line").alias("citations"))
    full = queries.join(reasons, "query_id").join(renumbered, "query_id", "left").join(citations, "query_id", "left")
    off = F.col("answer").isNotNull() & T.misses_focus(F.col("question"), F.col("answer"))
    reason = F.when(off, "tangential").otherwise(F.col("reason"))
    closed = reason != ""
    body = F.concat(T.strip(F.col("answer")), F.lit("\n\nSources:\n"), F.array_join("citations", "\n"))
    return full.select(
        "query_id",
        F.when(closed, F.lit(None)).otherwise(F.coalesce(body, F.col("answer"))).alias("answer"),
        F.when(closed, F.array().cast("array<string>")).otherwise(F.coalesce("citations", F.array().cast("array<string>"))).alias("citations"),
        closed.alias("deflected"),
        reason.alias("reason"),
    )


