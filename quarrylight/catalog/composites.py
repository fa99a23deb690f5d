"""Loops and full answers, evaluation sets, experiment runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.answers import CONFUSION, DETECT, flagged
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import HYBRID
from quarrylight.catalog.routing import CRAG, PROFILE, SPARSE20, TOP_TEXT, landmarks, sparse20
from quarrylight.functions import vocab as V
from quarrylight.operators import evaluate as E
from quarrylight.operators import faithfulness as Q
from quarrylight.operators import routing, sparse
from quarrylight.operators import runs as runs_of
from quarrylight.plans import answering, corrective
from quarrylight.sources import evalsets, sinks


# Every question as it is and by its content words alone, searched side by side: odd ids are the rewritten ones.
TWICE = f"""{P.CHUNKS}, asked AS (SELECT item_id AS query_id, text AS question FROM benchmark),
  words AS (SELECT *, regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+') AS r FROM asked),
  questions AS (SELECT query_id * 2 AS query_id, question FROM asked
    UNION ALL SELECT query_id * 2 + 1, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i AND length(x) > 1 AND NOT list_contains({P.words(V.OVERLAP_STOP)}, x)), ' ') FROM words),
  {HYBRID}, told AS (SELECT query_id // 2 AS query_id, query_id % 2 = 1 AS again, chunk_id, score, rank FROM hybrid)"""


@query(
    "crag_retrieval",
    f"""WITH {TWICE}, {PROFILE}, {CRAG}, graded AS (SELECT query_id // 2 AS query_id, confidence FROM crag WHERE query_id % 2 = 0),
    marked AS (SELECT t.*, confidence FROM told t JOIN graded USING (query_id)),
    best AS (SELECT query_id, chunk_id, max(score) AS score FROM marked WHERE confidence = 'incorrect' GROUP BY query_id, chunk_id),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best) WHERE rank <= {V.TOP_K})
    SELECT query_id, chunk_id, score, rank FROM marked WHERE NOT again AND (confidence = 'correct' OR (confidence = 'ambiguous' AND (score >= 0.3 OR rank = 1)))
    UNION ALL SELECT query_id, chunk_id, score, rank FROM merged WHERE score >= 0.3 OR rank = 1""",
)
def crag_retrieval(t):
    out = corrective.corrective_search(t.questions(), t.chunks(), corrective.keyword_rewrite)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "agent_retrieval",
    f"""WITH {TWICE}, pending AS (SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM told WHERE NOT again AND score >= 0.85 GROUP BY query_id HAVING count(*) >= 2)),
    joined AS (SELECT query_id, chunk_id, score FROM told WHERE NOT again
      UNION ALL SELECT a.query_id, a.chunk_id, a.score FROM told a WHERE again AND query_id IN (SELECT query_id FROM pending) AND NOT EXISTS (SELECT 1 FROM told b WHERE NOT b.again AND b.query_id = a.query_id AND b.chunk_id = a.chunk_id)),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM joined) WHERE rank <= {V.TOP_K})
    SELECT query_id, chunk_id, score, rank, CASE WHEN query_id IN (SELECT query_id FROM pending) THEN 2 ELSE 1 END AS rounds FROM merged""",
)
def agent_retrieval(t):
    out = corrective.agent_search(t.questions(), t.chunks(), [corrective.keyword_rewrite])
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("full_answer")
def full_answer(t):
    # Every third question is about a paper of its own, whatever it is found with.
    topics = t.questions().where("query_id % 3 = 0").select("query_id", (F.col("query_id") * 3 + 1).alias("paper_key"))
    return answering.answer_questions(t.questions(), t.chunks(), landmarks(t), topics).withColumn("citations", F.array_join("citations", "\n"))


@query("text_gates")
def text_gates(t):
    return answering.text_gates(sparse20(t), t.questions(), t.chunks())


# Whole questions behind openings that ask for a detail: none, a specific thing, what something is used for.
FOCAL_LEADS = ["", "What specific ", "It is used to train "]
FOCAL_QUESTIONS = f"questions AS (SELECT item_id AS query_id, {P.led_sql('item_id', FOCAL_LEADS, 'text')} AS question FROM benchmark)"


def focal_count(pattern: str, least: int) -> str:
    focal = f"regexp_extract(q, {P.lit(pattern)}, 1)"
    times = [f"len(list_filter({tokens}, lambda w: w = {focal}))" for tokens in ("a", "b")]
    return f"(length({focal}) > 3 AND greatest({', '.join(times)}) < {least})"


@query(
    "focal_gate",
    rf"""WITH {P.CHUNKS}, {FOCAL_QUESTIONS}, {SPARSE20}, {TOP_TEXT.format(n=5)},
    f AS (SELECT query_id, lower(question) AS q, lower(coalesce(passage, '')) AS p FROM questions LEFT JOIN passages USING (query_id)),
    t AS (SELECT query_id, q, regexp_extract_all(p, '[\p{{L}}\p{{N}}_-]+') AS a, regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+') AS b FROM f)
    SELECT query_id, {" OR ".join(focal_count(pattern, least) for pattern, least in routing.FOCAL_SHAPES)} AS deflect FROM t""",
)
def focal_gate(t):
    asked = t.questions().select("query_id", P.led(F.col("query_id"), FOCAL_LEADS, F.col("question")).alias("question"))
    hits = sparse.bm25_search(asked, sparse.build_index(t.chunks()), 20)
    return routing.focal_gate(hits, asked, t.chunks().select("chunk_id", "text"))


RESPONSES = """sources AS (SELECT conv_id AS source_id, arg_max(text, turn) AS context FROM conversations WHERE role = 'user' GROUP BY conv_id),
responses AS (SELECT conv_id * 1000 + turn AS id, conv_id AS source_id, text AS response, turn FROM conversations WHERE role = 'assistant'),
loaded AS (SELECT id, source_id, coalesce(context, '') AS context, response, CASE turn % 3 WHEN 0 THEN 0 ELSE 1 END AS n_spans FROM responses LEFT JOIN sources USING (source_id))"""


def loaded(t):
    user = t.conversations.where("role = 'user'").select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("ord"), F.col("text").alias("source_info"), F.lit("QA").alias("task_type"), F.lit("").alias("prompt")
    )
    raw = F.when(F.col("turn") % 3 == 0, F.lit("[]")).when(
        F.col("turn") % 3 == 1, F.to_json(F.array(F.struct(F.col("text").alias("hallucinated_text"), F.lit("Subtle Conflict").alias("type"))))
    ).otherwise(F.to_json(F.array("text")))
    replies = t.conversations.where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("source_id"),
        F.col("text").alias("response"),
        F.lit("").alias("task_type"),
        F.lit("").alias("prompt"),
        evalsets.parse_spans(raw).alias("spans"),
    )
    return evalsets.annotated_responses(user, replies)


@query("annotated_responses", f"WITH {RESPONSES} SELECT id, source_id, md5(context) AS context, n_spans::INT AS n_spans, n_spans > 0 AS has_hallucination FROM loaded")
def annotated_responses(t):
    return loaded(t).select("id", "source_id", F.md5("context").alias("context"), F.size("spans").alias("n_spans"), "has_hallucination")


@query(
    "annotated_run_report",
    f"""WITH {RESPONSES}, pairs AS (SELECT id AS query_id, response AS answer, context FROM loaded), {DETECT}, {flagged(0.20, 'f')},
    s AS (SELECT l.id AS query_id, coalesce(f.spans, []) AS ps, CASE WHEN n_spans > 0 THEN [response] ELSE [] END AS gs FROM loaded l LEFT JOIN f ON f.query_id = l.id),
    k AS (SELECT *, list_distinct(flatten(list_transform(ps, lambda x: {P.word_list('x')}))) AS pw, list_distinct(flatten(list_transform(gs, lambda x: {P.word_list('x')}))) AS gw FROM s),
    b AS (SELECT len(gs) > 0 AS g, len(ps) > 0 AS p, len(list_intersect(pw, gw)) AS c, len(pw) AS np, len(gw) AS ng FROM k),
    m AS (SELECT count(*) AS total, round(avg(p::INT), 6) AS predicted_rate, round(avg(g::INT), 6) AS gold_rate,
      round(avg(CASE WHEN NOT g AND NOT p THEN 1.0 WHEN c > 0 THEN 2.0 * c / (np + ng) ELSE 0.0 END), 6) AS mean_span_f1 FROM b),
    {CONFUSION.replace(" FROM rates", ", total, predicted_rate, gold_rate, mean_span_f1 FROM rates, m")}""",
)
def annotated_run_report(t):
    rows = loaded(t)
    found = Q.detect_unsupported(rows.select(F.col("id").alias("query_id"), F.col("response").alias("answer"), "context"))
    both = rows.join(found.withColumnRenamed("query_id", "id").withColumnRenamed("spans", "predicted_spans"), "id")
    scored = both.select("*", *Q.span_f1(F.col("predicted_spans"), F.transform("spans", lambda s: s["text"])))
    judged = scored.select(F.col("has_hallucination").alias("gold"), (F.size("predicted_spans") > 0).alias("predicted"), "span_f1", F.lit(None).cast("double").alias("latency_ms"))
    told = runs_of.annotated_summary(judged).drop("avg_latency_ms")
    return told.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "fpr", "f1", "predicted_rate", "gold_rate", "mean_span_f1")})


@query(
    "grounded_questions",
    """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN TRUE ELSE quality = 0 OR toxic = 1 END AS should_deflect, 2 AS n_passages, (toxic + quality)::BIGINT AS n_relevant FROM labels""",
)
def grounded_questions(t):
    passages = F.to_json(
        F.array(
            F.struct(F.lit("a").alias("text"), (F.col("toxic") == 1).alias("is_relevant"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("boolean").alias("relevant")),
            F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("is_relevant"), F.lit("b").alias("content"), (F.col("quality") == 1).alias("relevant")),
        )
    )
    raw = t.labels.select(
        F.col("doc_id").alias("id"),
        F.lit("q").alias("question"),
        F.lit("a").alias("answer"),
        passages.alias("passages"),
        F.when(F.col("doc_id") % 4 == 0, "Unanswerable").otherwise("plain").alias("question_tag"),
        (F.col("toxic") == 1).alias("should_deflect"),
        (F.col("quality") == 1).alias("answerable"),
    )
    out = evalsets.grounded_questions(raw)
    relevant = F.size(F.filter("passages", lambda p: p["is_relevant"])).cast("bigint")
    return out.select("id", "should_deflect", F.size("passages").alias("n_passages"), relevant.alias("n_relevant"))


@query(
    "balanced_sample",
    "SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) AS nth FROM labels) WHERE nth <= 10",
)
def balanced_sample(t):
    return evalsets.seeded_sample(t.labels, "doc_id", 10, by="quality").select("doc_id", "quality")


@query("seeded_sample", "SELECT item_id FROM benchmark ORDER BY md5(item_id || ':42'), item_id LIMIT 20")
def seeded_sample(t):
    return evalsets.seeded_sample(t.benchmark, "item_id", 20).select("item_id")


RUNS = """runs AS (SELECT year(o_orderdate)::INT AS run_id, avg(o_totalprice) AS price, avg((o_orderstatus = 'F')::INT) AS filled FROM orders GROUP BY 1),
long AS (SELECT run_id, 'price' AS metric, round(price, 6) AS value FROM runs UNION ALL SELECT run_id, 'filled', round(filled, 6) FROM runs)"""


def runs(t):
    by_year = t.orders.groupBy(F.year("o_orderdate").alias("run_id")).agg(
        F.avg("o_totalprice").alias("price"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("filled")
    )
    return by_year.selectExpr("run_id", "stack(2, 'price', round(price, 6), 'filled', round(filled, 6)) AS (metric, value)")


@query(
    "experiment_deltas",
    f"WITH {RUNS} SELECT run_id, metric, value, round(value - lag(value) OVER (PARTITION BY metric ORDER BY run_id), 4) AS delta FROM long",
)
def experiment_deltas(t):
    return E.run_deltas(runs(t))


@query(
    "benchmark_trends",
    f"WITH {RUNS} SELECT run_id, coalesce(max(value) FILTER (WHERE metric = 'price'), 0.0) AS price, coalesce(max(value) FILTER (WHERE metric = 'filled'), 0.0) AS filled, 0.0::DOUBLE AS missing FROM long GROUP BY run_id",
)
def benchmark_trends(t):
    wide = runs(t).groupBy("run_id").pivot("metric", ["price", "filled", "missing"]).agg(F.max("value"))
    return wide.fillna(0.0)


@query(
    "report_markdown",
    "SELECT 3 AS line_no, '| ' || quality || ' | ' || toxic || ' | ' || count(*) || ' |' AS line FROM labels GROUP BY quality, toxic UNION ALL "
    "VALUES (0, '# Labels'), (1, '| quality | toxic | n |'), (2, '| --- | --- | --- |')",
)
def report_markdown(t):
    return sinks.markdown_report(t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n")), "Labels")


@query(
    "history_last_50",
    "SELECT day, n FROM (SELECT (floor(epoch(ts))::BIGINT // 21600) AS day, count(*) AS n FROM events GROUP BY 1) ORDER BY day DESC LIMIT 50",
)
def history_last_50(t):
    days = t.events.groupBy(F.floor(F.unix_timestamp("ts") / 21600).alias("day")).agg(F.count("*").alias("n"))
    return sinks.history(days, "day")


@query(
    "eval_query_shapes",
    """SELECT doc_id::VARCHAR AS id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source || ',' || lang ELSE '' END AS papers,
    CASE doc_id % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'a,b' ELSE '' END AS sections, doc_id % 4 = 2 AS should_deflect, CASE WHEN doc_id % 4 = 2 THEN 'none' END AS reason FROM documents""",
)
def eval_query_shapes(t):
    kind = F.col("doc_id") % 4
    shaped = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("id"),
            F.when(kind == 0, F.col("source")).alias("relevant_doc"),
            F.when(kind == 1, F.array("source", "lang")).alias("relevant_docs"),
            F.when(kind == 0, "abstract").alias("expected_section"),
            F.when(kind == 1, F.array(F.lit("a"), F.lit("b"))).alias("expected_sections"),
            F.when(kind == 2, True).alias("should_deflect"),
            F.when(kind == 2, "none").alias("reason"),
        )
    )
    rows = evalsets.eval_queries(t.documents.select(F.from_json(shaped, evalsets.EVAL_QUERY).alias("q")).select("q.*"))
    return rows.select("id", F.array_join("papers", ",").alias("papers"), F.array_join("sections", ",").alias("sections"), "should_deflect", "reason")


@query(
    "judge_quoted_spans",
    """WITH r AS (SELECT doc_id, text, 'It says ' || array_to_string(list_transform(string_split(text, chr(10)), lambda l: '"' || replace(l, '"', chr(39)) || '"'), ' and ')
      || ' and "' || replace(substr(text, 5, 15), 'e', 'E') || '" and "short" and "never in this answer".' AS reasoning FROM documents)
    SELECT doc_id, array_to_string(list_filter(regexp_extract_all(reasoning, '"([^"]{10,})"', 1), lambda q: contains(lower(text), lower(q))), '|') AS spans FROM r""",
)
def judge_quoted_spans(t):
    """Every line of every text is quoted (with its own quotes changed), and what the text does not say besides."""
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.concat(F.lit('"'), F.replace(line, F.lit('"'), F.lit("'")), F.lit('"')))
    reasoning = F.concat(
        F.lit("It says "), F.array_join(lines, " and "), F.lit(' and "'), F.replace(F.substring("text", 5, 15), F.lit("e"), F.lit("E")), F.lit('" and "short" and "never in this answer".')
    )
    return t.documents.select("doc_id", F.array_join(evalsets.quoted_spans(reasoning, F.col("text")), "|").alias("spans"))


@query(
    "plan_step_union",
    f"""WITH {P.CHUNKS}, {P.QUESTIONS}, {P.RELEVANT}, {P.INDEX}, {P.BM25}, {P.top('best', 'bm25', 5, where='score > 0')}
    SELECT query_id, chunk_id, 0.5::DOUBLE AS score, 0 AS step FROM relevant UNION ALL SELECT query_id, chunk_id, score, 1 FROM best""",
)
def plan_step_union(t):
    """What holds the question, which brings no score, and a search as the second step."""
    return routing.union_steps([t.relevant(), sparse.bm25_search(t.questions(), sparse.build_index(t.chunks()), 5)])


@query("context_answers")
def context_answers(t):
    """Every exchange answered from its whole question as the only passage, and once more from nothing (negative ids)."""
    asked = t.exchanges().select("query_id", F.concat(F.lit("How does this model learn: "), "question", F.lit("?")).alias("question"), F.col("question").alias("text"))
    context = asked.select("query_id", F.lit(1).alias("rank"), F.lit("given").alias("title"), F.lit("body").alias("section"), "text", F.lit(0.9).alias("score"))
    bare = asked.select((-F.col("query_id") - 1).alias("query_id"), "question")
    out = answering.answer_from_context(asked.select("query_id", "question").unionByName(bare), context)
    return out.withColumn("citations", F.array_join("citations", "\n"))
