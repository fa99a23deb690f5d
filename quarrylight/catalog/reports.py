"""Filters over the question set, smoke test, quality bundle, stage events, grounded report."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import answers as C
from quarrylight.catalog import parts as P
from quarrylight.catalog.graph import EDGES, NODES, edges, regions
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import BASE, HYBRID
from quarrylight.catalog.routing import ACTION, CONF, CRAG, INTENT, MULTI_HOP, PROFILE, reranked
from quarrylight.functions import text as T
from quarrylight.operators import evaluate as E
from quarrylight.operators import faithfulness as Q
from quarrylight.operators import graph as G
from quarrylight.operators import routing


@query(
    "benchmark_filters",
    f"WITH {P.QUESTIONS} SELECT query_id, {C.DIFFICULTY} AS difficulty, CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type FROM questions WHERE {C.DIFFICULTY} IN ('easy', 'medium') AND {INTENT} <> 'recent'",
)
def benchmark_filters(t):
    q = F.col("question")
    rows = t.questions().select("query_id", F.expr(C.DIFFICULTY).alias("difficulty"), T.query_type(q).alias("query_type"), T.query_intent(q).alias("topic"))
    return rows.where(F.col("difficulty").isin("easy", "medium") & (F.col("topic") != "recent")).drop("topic")


@query(
    "primary_sources",
    f"WITH {P.CHUNKS}, {P.QUESTIONS}, {P.RELEVANT} SELECT DISTINCT paper_id FROM relevant JOIN chunks USING (chunk_id)",
)
def primary_sources(t):
    return t.chunks().select("chunk_id", "paper_id").join(t.relevant(), "chunk_id", "left_semi").select("paper_id").distinct()


@query(
    "chunks_by_id",
    f"WITH {P.CHUNKS} SELECT chunk_id, paper_id, section, md5(text) AS digest FROM chunks WHERE chunk_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND section = 'en'",
)
def chunks_by_id(t):
    wanted = t.labels.where("toxic = 0").select(F.col("doc_id").alias("chunk_id"))
    rows = t.chunks().where("section = 'en'").join(wanted, "chunk_id", "left_semi")
    return rows.select("chunk_id", "paper_id", "section", F.md5("text").alias("digest"))


@query(
    "smoke_test_summary",
    f"""{BASE}, {HYBRID}, {P.RELEVANT}, s AS (SELECT query_id, max(score) AS top_score FROM hybrid GROUP BY query_id)
    SELECT query_id, top_score, top_score >= 0.3 AS is_relevant, (top_score >= 0.3) <> (query_id NOT IN (SELECT query_id FROM relevant)) AS passed FROM s""",
)
def smoke_test_summary(t):
    best = reranked(t).groupBy("query_id").agg(F.max("score").alias("top_score"))
    has = t.relevant().select("query_id", F.lit(True).alias("has")).distinct()
    rows = best.join(has, "query_id", "left")
    flag = F.col("top_score") >= 0.3
    return rows.select("query_id", "top_score", flag.alias("is_relevant"), (flag != F.col("has").isNull()).alias("passed"))


@query(
    "quality_bundle",
    f"""{BASE}, {C.CITE}, {PROFILE},
    ctx AS (SELECT query_id, string_agg(text, ' ' ORDER BY source_number) AS context FROM src GROUP BY query_id),
    div AS (SELECT query_id, count(DISTINCT paper_id) AS unique_papers, count(DISTINCT section) AS unique_sections FROM src GROUP BY query_id)
    SELECT cite.query_id, round(coverage, 6) AS coverage, round(density, 6) AS density, unsupported_claims, citations, unique_papers, unique_sections, {CONF} AS confidence, round(top, 6) AS top_score
    FROM cite JOIN div USING (query_id) JOIN (SELECT *, CASE WHEN second > 0 THEN top / second ELSE 'inf'::DOUBLE END AS lead FROM profile) USING (query_id)""",
)
def quality_bundle(t):
    cited = C.cited_metrics(t).select("query_id", F.round("coverage", 6).alias("coverage"), F.round("density", 6).alias("density"), "unsupported_claims", "citations")
    spread = routing.source_diversity(C.sources(t)).select("query_id", "unique_papers", "unique_sections")
    profile = routing.score_profile(C.sparse10(t))
    conf = profile.select("query_id", routing.retrieval_confidence(profile).alias("confidence"), F.round("top", 6).alias("top_score"))
    return cited.join(spread, "query_id").join(conf, "query_id")


@query(
    "answer_faithfulness",
    f"""{BASE}, {C.ANSWERS}, pairs AS (SELECT query_id, answer, string_agg(text, ' ' ORDER BY source_number) AS context FROM answers JOIN src USING (query_id) GROUP BY query_id, answer),
    p AS (SELECT query_id, {P.content_words("context")} AS known, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda s: {P.strip("s")}), lambda s: length(s) > 15) AS sents FROM pairs),
    w AS (SELECT query_id, known, {P.content_words("s")} AS words FROM (SELECT query_id, known, unnest(sents) AS s FROM p)),
    o AS (SELECT query_id, avg(len(list_intersect(words, known)) / len(words)) AS o FROM w WHERE len(words) >= 4 AND len(known) > 0 GROUP BY query_id)
    SELECT query_id, round(coalesce(1.0 + 4.0 * o, 1.0), 6) AS faithfulness FROM pairs LEFT JOIN o USING (query_id)""",
)
def answer_faithfulness(t):
    from quarrylight.operators.answers import in_order

    src = C.sources(t)
    context = src.groupBy("query_id").agg(F.array_join(in_order("source_number", "text"), " ").alias("context"))
    pairs = C.answered(t, src).join(context, "query_id").select("query_id", "answer", "context")
    return Q.faithfulness(pairs).withColumn("faithfulness", F.round("faithfulness", 6))


@query(
    "stage_events",
    f"""{BASE}, {HYBRID}, {PROFILE}, {CRAG}, n AS (SELECT query_id, count(*) AS n, count_if(score >= 0.3) AS kept FROM hybrid GROUP BY query_id),
    rows AS (SELECT query_id, CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type, coalesce(confidence, 'unknown') AS confidence, {ACTION} AS action, n.n, n.kept
      FROM questions JOIN crag USING (query_id) JOIN n USING (query_id))
    SELECT query_id, 1 AS ord, 'classify' AS stage, query_type AS detail FROM rows UNION ALL SELECT query_id, 2, 'retrieval', n || ' results' FROM rows
    UNION ALL SELECT query_id, 3, 'crag', confidence FROM rows UNION ALL SELECT query_id, 4, 'action', action FROM rows UNION ALL SELECT query_id, 5, 'refinement', kept || ' kept' FROM rows""",
)
def stage_events(t):
    results = reranked(t)
    trace = routing.routing_trace(results, t.questions()).join(results.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    stages = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("classify").alias("stage"), F.col("query_type").alias("detail")),
        F.struct(F.lit(2).alias("ord"), F.lit("retrieval").alias("stage"), F.concat(F.col("n").cast("string"), F.lit(" results")).alias("detail")),
        F.struct(F.lit(3).alias("ord"), F.lit("crag").alias("stage"), F.col("confidence").alias("detail")),
        F.struct(F.lit(4).alias("ord"), F.lit("action").alias("stage"), F.col("action").alias("detail")),
        F.struct(F.lit(5).alias("ord"), F.lit("refinement").alias("stage"), F.concat(F.col("refined_count").cast("string"), F.lit(" kept")).alias("detail")),
    )
    return trace.select("query_id", F.explode(stages).alias("s")).select("query_id", "s.ord", "s.stage", "s.detail")


@query(
    "grounded_report",
    f"""{BASE}, {C.RAF_BASE}, {C.ANSWERS.replace(C.SPARSE10 + ', ', '')},
    cited AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[(?:Source\\s+)?(\\d+)\\]', 1))::BIGINT AS passage_no FROM answers),
    st AS (SELECT query_id, count(c.passage_no) AS c, count_if(is_relevant) AS r, count_if(is_relevant AND c.passage_no IS NOT NULL) AS b FROM passages LEFT JOIN cited c USING (query_id, passage_no) GROUP BY query_id),
    pr AS (SELECT query_id, CASE WHEN c = 0 AND r = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE b / c END AS p, CASE WHEN r = 0 THEN 1.0 ELSE b / r END AS q FROM st)
    SELECT coalesce(nullif({C.DIFFICULTY}, ''), 'unknown') AS tag, count(*) AS n, round(avg(p), 6) AS precision, round(avg(q), 6) AS recall,
      round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END), 6) AS f1 FROM pr JOIN questions USING (query_id) GROUP BY 1""",
)
def grounded_report(t):
    rows = Q.attribution(C.answered(t), C.passages(t)).join(t.questions().select("query_id", F.expr(C.DIFFICULTY).alias("tag")), "query_id")
    tag = F.coalesce(F.nullif("tag", F.lit("")), F.lit("unknown")).alias("tag")
    return rows.groupBy(tag).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "community_writeback",
    f"""WITH {EDGES}, {NODES}, m AS (SELECT lower(n_name) AS node, r_name AS community FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT key, entity_type, coalesce(community, '') AS community FROM nodes LEFT JOIN m ON m.node = key""",
)
def community_writeback(t):
    rows = G.nodes_of(edges(t)).join(regions(t).withColumnRenamed("node", "key"), "key", "left")
    return rows.select("key", "entity_type", F.coalesce("community", F.lit("")).alias("community"))


@query("clean_math_texts", f"WITH {P.CHUNKS} SELECT chunk_id, md5({C.CLEAN}) AS digest FROM chunks")
def clean_math_texts(t):
    return t.chunks().select("chunk_id", F.md5(T.clean_math_artifacts(F.col("text"))).alias("digest"))


@query(
    "scorecard",
    f"""{BASE}, {HYBRID}, {P.RELEVANT}, {C.metrics_sql('hybrid')} SELECT count(*) AS questions, round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr,
    count_if(mrr = 1.0)::BIGINT AS first_place, round(avg(recall), 6) AS recall FROM metrics WHERE NOT should_deflect""",
)
def scorecard(t):
    rows = E.retrieval_metrics(C.as_papers(reranked(t)), C.expected(t), t.questions(), 10).where(~F.col("should_deflect"))
    return rows.agg(
        F.count("*").alias("questions"), F.round(F.avg("hit_rate"), 6).alias("hit_rate"), F.round(F.avg("mrr"), 6).alias("mrr"),
        F.count_if(F.col("mrr") == 1.0).alias("first_place"), F.round(F.avg("recall"), 6).alias("recall"),
    )
