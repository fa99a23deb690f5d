"""The agent loop with plans as tables: a variable number of search steps per question, one search per round.

Every question is searched as it is. Those whose context is not sufficient get a plan by their kind: parts of
a question with several hops, the question and its graph expansion where it names several entities, the
question itself otherwise. All steps of all pending questions are one batch for one hybrid search. What they
find joins the context under the step that found it first; questions that still lack context get another
plan, by graph expansion or else by parts, as long as it holds a question that was not just asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators import graph, routing
from quarrylight.operators.ranking import ranked
from quarrylight.plans.hybrid import hybrid_search
from quarrylight.session import settle

#: A model that takes ``query_id, question`` and gives ``query_id, reply``: a JSON array of questions, or anything else.
Decomposer = Callable[[DataFrame], DataFrame]
FEWEST_PARTS, MOST_PARTS = 2, 4
STEP_COLUMNS = ["query_id", "step", "question", "rationale", "query_type"]


def string_array(reply: Column) -> Column:
    """The JSON array in a reply, the whole of it or else its first ``[...]``; null unless all items are strings."""

    def strings(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        kind = F.schema_of_variant(parsed)
        items = F.from_json(text, "array<string>")
        return F.when((kind == "ARRAY<STRING>") & F.forall(items, lambda x: x.isNotNull()), items).when(kind == "ARRAY<VOID>", F.when(F.rlike(text, F.lit(r"^\s*\[\s*\]\s*$")), F.array().cast("array<string>")))

    inner = F.regexp_extract(reply, r"(?s)\[.*?\]", 0)
    return F.coalesce(strings(reply), strings(inner))


def sentence_parts(queries: DataFrame) -> DataFrame:
    """Offline stand-in for a model: the sentences of the question."""
    return queries.select("query_id", F.to_json(T.sentences(F.col("question"))).alias("reply"))


def parts_of(queries: DataFrame, decompose: Decomposer) -> DataFrame:
    """``query_id, nth, part`` of the replies that hold two to four questions."""
    read = decompose(queries).select("query_id", string_array(F.col("reply")).alias("parts"))
    usable = read.where((F.size("parts") >= FEWEST_PARTS) & (F.size("parts") <= MOST_PARTS))
    return usable.select("query_id", F.posexplode("parts").alias("nth", "part"))


def kinds_of(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, question, query_type, expanded``; ``expanded`` is null where the graph adds nothing."""
    matched = graph.match_entities(queries, graph.entity_index(graph.nodes_of(edges))).groupBy("query_id").agg(F.count("*").alias("n"))
    wider = graph.expand_queries(queries, edges).select("query_id", F.col("question").alias("wider"))
    rows = queries.select("query_id", "question").join(matched, "query_id", "left").join(wider, "query_id", "left")
    kind = T.query_type(F.col("question"), F.coalesce("n", F.lit(0)))
    return rows.select("query_id", "question", kind.alias("query_type"), F.when(F.col("wider") != F.col("question"), F.col("wider")).alias("expanded"))


def step(rows: DataFrame, number: Column, question: str, rationale: str, kind: Column | None = None) -> DataFrame:
    named = rows.select("query_id", number.cast("int").alias("step"), F.col(question).alias("question"), F.lit(rationale).alias("rationale"), (kind if kind is not None else F.col("query_type")).alias("query_type"))
    return named.select(*STEP_COLUMNS)


def first_plan(kinds: DataFrame, parts: DataFrame) -> DataFrame:
    """Steps of every question of ``kinds``: ``query_id, step, question, rationale, query_type``."""
    split = kinds.where("query_type = 'multi_hop'").join(parts, "query_id")
    whole = kinds.join(split.select("query_id").distinct(), "query_id", "left_anti")
    wider = whole.where("query_type = 'entity_heavy' AND expanded IS NOT NULL")
    return (
        step(split, F.col("nth"), "part", "part of the question")
        .unionByName(step(whole, F.lit(0), "question", "the question itself"))
        .unionByName(step(wider, F.lit(1), "expanded", "related entities"))
    )


def next_plan(kinds: DataFrame, parts: DataFrame, before: DataFrame) -> DataFrame:
    """Another plan after the steps ``before`` (those of one plan); questions without a new step are left out."""
    asked = before.select("query_id", F.col("question").alias("was"))
    kept = kinds.drop("query_type").join(before.select("query_id", "query_type").distinct(), "query_id")

    def unasked(rows: DataFrame, question: str) -> DataFrame:
        return rows.join(asked.withColumnRenamed("was", question), ["query_id", question], "left_anti")

    wider = unasked(kept.where("expanded IS NOT NULL"), "expanded")
    rest = kept.where("query_type <> 'multi_hop'").join(wider.select("query_id"), "query_id", "left_anti")
    split = unasked(rest.join(parts, "query_id"), "part")
    return step(wider, F.lit(0), "expanded", "related entities").unionByName(step(split, F.col("nth"), "part", "part of the question", F.lit("multi_hop")))


def run_steps(steps: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """What each step finds: ``query_id, step, chunk_id, score, rank``. All steps are one batch of questions."""
    keyed = settle(steps.withColumn("step_id", F.xxhash64("query_id", "step")), "steps")
    found = hybrid_search(keyed.select(F.col("step_id").alias("query_id"), "question"), chunks, k)
    found = found.select(F.col("query_id").alias("step_id"), "chunk_id", "score", "rank")
    return found.join(keyed.select("step_id", "query_id", "step"), "step_id").drop("step_id")


def merged(context: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Add what a round found and the context lacks, each chunk with the score of the first step that found it."""
    first = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("step", "round", "score")).alias("f"))
    fresh = first.join(context.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", "f.score", "f.round", "f.step")
    rows = context.select("query_id", "chunk_id", "score", "round", "step").unionByName(fresh)
    return ranked(rows, "query_id", [F.col("score").desc(), F.col("chunk_id")]).where(F.col("rank") <= k)


def agent_run(queries: DataFrame, chunks: DataFrame, edges: DataFrame, decompose: Decomposer = sentence_parts, k: int = V.TOP_K, max_rounds: int = 3) -> DataFrame:
    """``query_id, chunk_id, score, rank, round, step, rounds``: the context, where each row comes from, and how many rounds were run.

    A round is skipped when no question is pending, so the number of searches is that of the neediest question.
    A question nothing is found for has no rows.
    """
    queries = settle(queries.select("query_id", "question"), "questions")
    base = step(queries.withColumn("query_type", F.lit("")), F.lit(0), "question", "the question itself")
    context = settle(run_steps(base, chunks, k).withColumn("round", F.lit(0)), "context")
    rounds = queries.select("query_id", F.lit(1).alias("rounds"))
    pending = queries.join(routing.sufficiency(context).where("sufficient"), "query_id", "left_anti")
    plan = kinds = parts = None
    for n in range(1, max_rounds):
        pending = settle(pending, "pending")
        if pending.isEmpty():
            break
        if kinds is None:
            kinds, parts = settle(kinds_of(pending, edges), "kinds"), settle(parts_of(pending, decompose), "parts")
            plan = first_plan(kinds, parts)
        else:
            plan = next_plan(kinds.join(pending.select("query_id"), "query_id", "left_semi"), parts, plan)
        plan = settle(plan, "plan")
        ids = plan.select("query_id").distinct()
        if plan.isEmpty():
            break
        found = settle(run_steps(plan, chunks, k).withColumn("round", F.lit(n)), "found")
        wider = merged(context.join(ids, "query_id", "left_semi"), found, k)
        context = settle(context.join(ids, "query_id", "left_anti").select(*wider.columns).unionByName(wider), "context")
        rounds = settle(rounds.join(ids.withColumn("more", F.lit(n + 1)), "query_id", "left").select("query_id", F.coalesce("more", "rounds").alias("rounds")), "rounds")
        pending = ids.join(queries, "query_id").join(routing.sufficiency(context).where("sufficient"), "query_id", "left_anti")
        plan = plan.join(pending.select("query_id"), "query_id", "left_semi")
    return context.join(rounds, "query_id").select("query_id", "chunk_id", "score", "rank", "round", "step", "rounds")
