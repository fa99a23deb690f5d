"""Boosting, diversification, confidence, gating and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import BASE, HYBRID
from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators import boost, routing, sparse
from quarrylight.operators.dense import hashed_search
from quarrylight.plans import hybrid

# BM25 results in the place of reranked ones, for operators that only look at ranked scores.
SPARSE20 = f"{P.INDEX}, {P.BM25}, {P.top('hybrid', 'bm25', 20, where='score > 0')}"
LANDMARKS = "landmarks AS (SELECT doc_id AS paper_key, 1.3 + 0.2 * toxic AS boost FROM labels WHERE quality = 1)"


def sparse20(t):
    return sparse.bm25_search(t.questions(), sparse.build_index(t.chunks()), 20)


def reranked(t):
    return hybrid.hybrid_search(t.questions(), t.chunks())


def landmarks(t):
    return t.labels.where("quality = 1").select(
        F.col("doc_id").alias("paper_key"), (1.3 + 0.2 * F.col("toxic")).alias("boost")
    )


def with_meta(t, results):
    meta = t.chunks().select("chunk_id", "paper_id", "section", "year", F.col("chunk_id").alias("paper_key"))
    return results.join(meta, "chunk_id")


def big(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


INTENT = (
    f"CASE WHEN {P.count_of('question', V.FOUNDATIONAL_PHRASES)} > {P.count_of('question', V.RECENT_PHRASES)} THEN 'foundational' "
    f"WHEN {P.count_of('question', V.RECENT_PHRASES)} > {P.count_of('question', V.FOUNDATIONAL_PHRASES)} THEN 'recent' ELSE 'balanced' END"
)
MULTI_HOP = f"regexp_matches(lower(question), {P.lit('|'.join(V.MULTI_HOP_PATTERNS))})"
MULTI_DOC = (
    f"({P.any_of('question', V.MULTI_DOC_WORDS)} OR regexp_matches(question, '[\\p{{L}}\\p{{N}}_],\\s*[\\p{{L}}\\p{{N}}_]') "
    "OR (contains(lower(question), ' and ') AND NOT starts_with(lower(question), 'what is')))"
)
# Openings that bring about every class before whole turns; greetings alone are rows beside them.
LEADS = [
    "", "What is the transformer? ", "latest state of the art ", "Compare BERT and GPT: ", V.OPINION_PHRASES[0] + " about ", V.REFUSAL_PHRASES[0] + " ",
    V.ABSTRACT_WORDS[0] + " ", "What is attention, latest? ",
]
GREETING, GREETED = "Hello!", 9
USER_TURNS = f"""turns AS (SELECT conv_id, turn, role, {P.led_sql('(conv_id + turn)', LEADS, 'text')} AS question, false AS greeting FROM conversations
    UNION ALL SELECT conv_id, turn, role, {P.lit(GREETING)}, true FROM conversations WHERE (conv_id + turn) % {GREETED} = 0)"""


def user_turns(t):
    """Every turn whole behind one of the openings, and a bare greeting for one turn in nine."""
    key = F.col("conv_id") + F.col("turn")
    turns = t.conversations
    whole = turns.select("conv_id", "turn", P.led(key, LEADS, F.col("text")).alias("question"), F.lit(False).alias("greeting"))
    return whole.unionByName(turns.where(key % GREETED == 0).select("conv_id", "turn", F.lit(GREETING).alias("question"), F.lit(True).alias("greeting")))


@query(
    "query_predicates",
    f"""WITH {USER_TURNS} SELECT conv_id, turn, greeting, {INTENT} AS intent,
    CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type,
    {MULTI_DOC} AS multi_document, {P.any_of('question', V.ABSTRACT_WORDS)} AS abstract_analysis,
    {P.any_of('question', V.DOMAIN_TERMS)} AS on_topic, {P.any_of('question', V.OPINION_PHRASES)} AS opinion,
    {P.any_of('question', V.REFUSAL_PHRASES)} AS refusal,
    list_contains({P.words(V.CASUAL_MESSAGES)}, regexp_replace(lower({P.strip('question')}), '[!?.,]+$', ''))
      OR length(regexp_replace(lower({P.strip('question')}), '[!?.,]+$', '')) < 3 AS casual FROM turns""",
)
def query_predicates(t):
    q = F.col("question")
    return user_turns(t).select(
        "conv_id",
        "turn",
        "greeting",
        T.query_intent(q).alias("intent"),
        T.query_type(q).alias("query_type"),
        T.is_multi_document(q).alias("multi_document"),
        T.is_abstract_analysis(q).alias("abstract_analysis"),
        T.is_on_topic(q).alias("on_topic"),
        T.is_opinion(q).alias("opinion"),
        T.is_refusal(q).alias("refusal"),
        T.is_casual(q).alias("casual"),
    )


TOPICS = ", ".join(f"({P.lit(k)}, {P.lit(i)})" for k, ids in V.TOPIC_PAPERS.items() for i in ids)


@query(
    "topic_landmark_papers",
    f"""WITH {P.CHUNKS}, docs AS (SELECT chunk_id AS query_id, text AS question FROM chunks),
    topics(topic, paper_key) AS (VALUES {TOPICS})
    SELECT DISTINCT query_id, paper_key FROM docs JOIN topics ON contains(lower(question), topic) WHERE {INTENT} <> 'recent'""",
)
def topic_landmark_papers(t):
    return boost.topic_papers(t.chunks().select(F.col("chunk_id").alias("query_id"), F.col("text").alias("question")))


AGE = """CASE WHEN year IS NULL THEN 1.0 WHEN intent = 'foundational' THEN CASE WHEN year <= 2017 THEN 1.8 WHEN year <= 2020 THEN 1.5 WHEN year <= 2022 THEN 1.2 ELSE 1.0 END
 WHEN intent = 'recent' THEN CASE WHEN year >= 2023 THEN 1.3 WHEN year >= 2021 THEN 1.1 ELSE 0.9 END
 ELSE CASE WHEN year <= 2018 THEN 1.2 WHEN year <= 2021 THEN 1.1 ELSE 1.0 END END"""

BOOSTED = f"""{LANDMARKS}, intents AS (SELECT query_id, {INTENT} AS intent FROM questions),
factors AS (SELECT h.query_id, h.chunk_id, h.score, paper_id, c.chunk_id AS paper_key, intent, coalesce(boost, 1.0)::DOUBLE AS landmark_factor,
  ({AGE})::DOUBLE AS age_factor FROM hybrid h JOIN chunks c USING (chunk_id) JOIN intents USING (query_id)
  LEFT JOIN landmarks l ON l.paper_key = c.chunk_id),
scaled AS (SELECT *, round(score * landmark_factor * age_factor, 10) AS b FROM factors),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC) AS nth, count(*) OVER (PARTITION BY query_id) AS n FROM scaled),
floored AS (SELECT *, max(CASE WHEN nth = CASE WHEN n >= 4 THEN n // 4 + 1 ELSE n END THEN b END) OVER (PARTITION BY query_id) AS lift FROM placed),
boosted AS (SELECT query_id, chunk_id, paper_id, paper_key, score AS original_score, landmark_factor, age_factor,
  CASE WHEN intent = 'foundational' AND landmark_factor > 1.0 THEN greatest(b, lift) ELSE b END AS score FROM floored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM boosted)"""


def boosted(t):
    intents = t.questions().select("query_id", T.query_intent(F.col("question")).alias("intent"))
    return boost.boost_results(with_meta(t, sparse20(t)), intents, landmarks(t))


@query(
    "boost_scores",
    f"{BASE}, {SPARSE20}, {BOOSTED} SELECT query_id, chunk_id, original_score, score, landmark_factor, age_factor, rank FROM ranked",
)
def boost_scores(t):
    return big(boosted(t), "rank").select(
        "query_id", "chunk_id", "original_score", "score", "landmark_factor", "age_factor", "rank"
    )


CAPPED = """capped AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank) AS seat FROM ranked) WHERE seat <= 2),
chosen AS (SELECT query_id, chunk_id, paper_id, paper_key, score, place FROM capped WHERE place <= 5)"""


@query(
    "diversify_per_paper",
    f"{BASE}, {SPARSE20}, {BOOSTED}, {CAPPED} SELECT query_id, chunk_id, paper_id, score, place FROM chosen",
)
def diversify_per_paper(t):
    out = boost.diversify(boosted(t), 5, 2)
    return big(out, "place").select("query_id", "chunk_id", "paper_id", "score", "place")


@query(
    "diversify_with_landmark",
    f"""{BASE}, {SPARSE20}, {BOOSTED}, {CAPPED},
    state AS (SELECT query_id, bool_or(paper_key IN (SELECT paper_key FROM landmarks)) AS has_mark, count(*) AS n_chosen FROM chosen GROUP BY query_id),
    totals AS (SELECT query_id, count(*) AS n_all FROM ranked GROUP BY query_id),
    marks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM ranked
      WHERE paper_key IN (SELECT paper_key FROM landmarks)) WHERE nth = 1),
    extra AS (SELECT m.query_id, m.chunk_id, m.paper_id, m.score, least(n_chosen + 1, 5) AS place FROM marks m JOIN state USING (query_id)
      JOIN totals USING (query_id) WHERE NOT has_mark AND n_all > n_chosen)
    SELECT query_id, chunk_id, paper_id, score, place FROM chosen c WHERE NOT EXISTS
      (SELECT 1 FROM extra e WHERE e.query_id = c.query_id AND e.place = c.place)
    UNION ALL SELECT * FROM extra""",
)
def diversify_with_landmark(t):
    out = boost.diversify(boosted(t), 5, 2, landmarks(t))
    return big(out, "place").select("query_id", "chunk_id", "paper_id", "score", "place")


# --------------------------------------------------------------- confidence

PROFILE = """profile AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN score END) AS top,
  max(CASE WHEN rank = 2 THEN score END) AS second, avg(CASE WHEN rank <= 3 THEN score END) AS mean3,
  min(score) AS low, max(score) AS high, avg(score) AS mean, stddev_pop(score) AS std FROM hybrid GROUP BY query_id)"""
CRAG = """crag AS (SELECT query_id, n, top, CASE WHEN n = 0 THEN 'unknown'
  WHEN top >= 0.9 AND NOT (n >= 3 AND top - mean3 < 0.005 AND top < 0.95) THEN 'correct'
  WHEN top >= 0.7 THEN 'ambiguous' ELSE 'incorrect' END AS confidence FROM profile)"""
ACTION = "CASE WHEN confidence IN ('correct', 'unknown') THEN 'pass_through' WHEN confidence = 'ambiguous' THEN 'refine_only' ELSE 'hyde_rewrite' END"


@query("crag_confidence", f"{BASE}, {HYBRID}, {PROFILE}, {CRAG} SELECT query_id, confidence, {ACTION} AS action, top FROM crag")
def crag_confidence(t):
    return routing.crag_confidence(reranked(t))


@query(
    "crag_refine",
    f"{BASE}, {HYBRID} SELECT query_id, chunk_id, score, rank FROM hybrid WHERE score >= 0.3 OR rank = 1",
)
def crag_refine(t):
    return big(routing.refine(reranked(t)), "rank").select("query_id", "chunk_id", "score", "rank")


@query(
    "crag_decision_rates",
    f"{BASE}, {HYBRID}, {PROFILE}, {CRAG} SELECT count(*) AS total_queries, "
    + ", ".join(f"round(count_if(confidence = '{c}') / greatest(count(*), 1), 8) AS {c}_pct" for c in ("correct", "ambiguous", "incorrect"))
    + " FROM crag",
)
def crag_decision_rates(t):
    out = routing.rates(routing.crag_confidence(reranked(t)), "confidence", ["correct", "ambiguous", "incorrect"])
    return out.select("total_queries", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query(
    "agent_decision_rates",
    f"""WITH {USER_TURNS}, kinds AS (SELECT CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type FROM turns)
    SELECT count(*) AS total_queries, round(count_if(query_type = 'simple') / greatest(count(*), 1), 8) AS simple_pct,
    round(count_if(query_type = 'multi_hop') / greatest(count(*), 1), 8) AS multi_hop_pct FROM kinds""",
)
def agent_decision_rates(t):
    kinds = user_turns(t).select(T.query_type(F.col("question")).alias("query_type"))
    out = routing.rates(kinds, "query_type", ["simple", "multi_hop"])
    return out.select("total_queries", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query(
    "agent_sufficiency",
    f"{BASE}, {HYBRID} SELECT query_id, count_if(score >= 0.85)::BIGINT AS good, count_if(score >= 0.85) >= 2 AS sufficient FROM hybrid GROUP BY query_id",
)
def agent_sufficiency(t):
    return routing.sufficiency(reranked(t))


MERGE_BASE = f"{P.INDEX}, {P.BM25}, {P.HASHED}, {P.top('a', 'bm25', 10, where='score > 0')}, {P.top('b', 'dense', 10)}"


@query(
    "merge_dedupe_topk",
    f"""{BASE}, {MERGE_BASE}, u AS (SELECT query_id, chunk_id, score, 0 AS origin FROM a UNION ALL SELECT query_id, chunk_id, score, 1 FROM b),
    d AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, origin) AS nth FROM u) WHERE nth = 1),
    {P.top('best', 'd', 12)} SELECT query_id, chunk_id, score, origin, rank FROM best""",
)
def merge_dedupe_topk(t):
    a = sparse.bm25_search(t.questions(), sparse.build_index(t.chunks()), 10)
    b = hashed_search(t.questions(), t.chunks(), 10)
    return big(routing.merge_results(a, b, 12), "rank")


@query(
    "merge_context_topk",
    f"""{BASE}, {MERGE_BASE}, u AS (SELECT query_id, chunk_id, score FROM b UNION ALL SELECT query_id, chunk_id, score FROM a
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = a.query_id AND b.chunk_id = a.chunk_id)),
    {P.top('best', 'u', 12)} SELECT query_id, chunk_id, score, rank FROM best""",
)
def merge_context_topk(t):
    a = sparse.bm25_search(t.questions(), sparse.build_index(t.chunks()), 10)
    b = hashed_search(t.questions(), t.chunks(), 10)
    return big(routing.merge_context(b, a, 12), "rank")


CONF = """CASE WHEN top > 2.0 THEN CASE WHEN top > 3.0 AND lead >= 1.8 THEN 'high' WHEN lead >= 1.3 THEN 'medium' ELSE 'low' END
  ELSE CASE WHEN top > 0.65 AND lead >= 1.5 THEN 'high' WHEN top > 0.4 AND lead >= 1.2 THEN 'medium' ELSE 'low' END END"""


@query(
    "retrieval_confidence",
    f"{BASE}, {SPARSE20}, {PROFILE} SELECT query_id, {CONF} AS confidence FROM "
    "(SELECT *, CASE WHEN second > 0 THEN top / second ELSE 'inf'::DOUBLE END AS lead FROM profile)",
)
def retrieval_confidence(t):
    profile = routing.score_profile(sparse20(t))
    return profile.select("query_id", routing.retrieval_confidence(profile).alias("confidence"))


@query(
    "score_spread",
    f"""{BASE}, {SPARSE20}, {PROFILE} SELECT query_id, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean,
    round(std, 6) AS std, round(CASE WHEN second > 0 THEN top / second ELSE 0.0 END, 6) AS gap_ratio FROM profile""",
)
def score_spread(t):
    profile = routing.score_profile(sparse20(t))
    return profile.select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "std")], F.round(routing.gap_ratio(profile), 6).alias("gap_ratio")
    )


@query(
    "source_tiers",
    f"""{BASE}, {HYBRID} SELECT query_id, chunk_id, rank, CASE WHEN top > 2.0 THEN CASE WHEN score >= 3.0 THEN 'high' WHEN score >= 1.0 THEN 'medium' ELSE 'low' END
      ELSE CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END END AS tier
    FROM (SELECT *, first(score) OVER (PARTITION BY query_id ORDER BY rank) AS top FROM hybrid)""",
)
def source_tiers(t):
    return big(routing.tiers(reranked(t)), "rank").select("query_id", "chunk_id", "rank", "tier")


@query(
    "source_diversity",
    f"""{BASE}, {SPARSE20} SELECT query_id, count(DISTINCT nullif(paper_id, '')) AS unique_papers,
    count(DISTINCT nullif(section, '')) AS unique_sections,
    array_to_string(list_sort(list(DISTINCT nullif(paper_id, ''))), ',') AS papers FROM hybrid JOIN chunks USING (chunk_id) GROUP BY query_id""",
)
def source_diversity(t):
    return routing.source_diversity(with_meta(t, sparse20(t))).withColumn("papers", F.array_join("papers", ","))


@query(
    "counts_by_retriever",
    f"""{BASE}, {P.INDEX}, {P.BM25}, {P.HASHED}, {P.top('sparse_top', 'bm25', 50, where='score > 0')}, {P.top('dense_top', 'dense', 50)}
    SELECT query_id, retriever, count(*) AS n FROM (SELECT query_id, 'bm25' AS retriever FROM sparse_top UNION ALL SELECT query_id, 'dense' FROM dense_top)
    GROUP BY query_id, retriever""",
)
def counts_by_retriever(t):
    fused = hybrid.first_stage(t.questions(), t.chunks(), 50)
    return fused.select("query_id", F.explode("sources").alias("retriever")).groupBy("query_id", "retriever").agg(F.count("*").alias("n"))


GATE = f"""asked AS (SELECT query_id, {MULTI_DOC} AS multi, {P.any_of('question', V.ABSTRACT_WORDS)} AS abstract,
  {P.any_of('question', V.NEEDS_TWO_SOURCES_WORDS)} AS needs_two FROM questions),
papers AS (SELECT query_id, count(DISTINCT nullif(paper_id, '')) AS papers FROM hybrid JOIN chunks USING (chunk_id) WHERE rank <= 10 GROUP BY query_id),
limits AS (SELECT *, CASE WHEN abstract THEN greatest(0.3, t * 0.4) WHEN multi THEN greatest(0.5, t * 0.6) ELSE t END AS threshold
  FROM (SELECT *, (CASE WHEN top > 2.0 THEN 0.5 WHEN top > 0.05 THEN 0.3 ELSE 0.3 END)::DOUBLE AS t FROM asked LEFT JOIN profile USING (query_id) LEFT JOIN papers USING (query_id))),
enough AS (SELECT query_id, count_if(score >= threshold) AS good FROM hybrid JOIN limits USING (query_id) GROUP BY query_id),
gated AS (SELECT query_id, threshold, CASE WHEN n IS NULL THEN 'no_results' WHEN top < threshold THEN 'low_score'
  WHEN multi AND NOT abstract AND needs_two AND papers < 2 THEN 'single_source' WHEN good < 1 THEN 'too_few' ELSE '' END AS reason
  FROM limits LEFT JOIN enough USING (query_id))"""


@query(
    "deflection_gate",
    f"{BASE}, {HYBRID}, {PROFILE}, {GATE} SELECT query_id, reason <> '' AS deflect, reason, round(threshold, 6) AS threshold FROM gated",
)
def deflection_gate(t):
    out = routing.gate(with_meta(t, reranked(t)), t.questions())
    return out.withColumn("threshold", F.round("threshold", 6))


TOP_TEXT = """passages AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS passage FROM hybrid JOIN chunks USING (chunk_id)
  WHERE rank <= {n} GROUP BY query_id)"""


@query(
    "keyword_overlap_gate",
    f"""{BASE}, {SPARSE20}, {TOP_TEXT.format(n=3)},
    sets AS (SELECT query_id, question, list_filter({P.ascii_words('question')}, lambda w: length(w) > 1 AND NOT list_contains({P.words(V.OVERLAP_STOP)}, w)) AS q,
      {P.ascii_words('passage')} AS p FROM questions JOIN passages USING (query_id)),
    stems AS (SELECT *, list_distinct(list_transform(q, lambda w: {P.stem('w')})) AS qs, list_distinct(list_transform(p, lambda w: {P.stem('w')})) AS ps FROM sets),
    o AS (SELECT query_id, question, CASE WHEN len(q) = 0 THEN 1.0 ELSE least(1.0, (len(list_intersect(q, p)) +
      len(list_intersect(list_filter(qs, lambda s: NOT list_contains(q, s)), ps))) / len(q)) END AS overlap FROM stems)
    SELECT query_id, round(overlap, 6) AS overlap, overlap < CASE WHEN {MULTI_DOC} THEN 0.15 ELSE 0.25 END AS deflect FROM o""",
)
def keyword_overlap_gate(t):
    out = routing.overlap_gate(sparse20(t), t.questions(), t.chunks().select("chunk_id", "text"))
    return out.withColumn("overlap", F.round("overlap", 6))


@query(
    "routing_trace",
    f"""{BASE}, {HYBRID}, {PROFILE}, {CRAG}, kept AS (SELECT query_id, count_if(score >= 0.3) AS refined_count FROM hybrid GROUP BY query_id)
    SELECT query_id, CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type, coalesce(confidence, 'unknown') AS confidence,
    CASE WHEN confidence IS NULL THEN 'hyde_rewrite' ELSE {ACTION} END AS action, coalesce(refined_count, 0)::BIGINT AS refined_count
    FROM questions LEFT JOIN crag USING (query_id) LEFT JOIN kept USING (query_id)""",
)
def routing_trace(t):
    return routing.routing_trace(reranked(t), t.questions())
