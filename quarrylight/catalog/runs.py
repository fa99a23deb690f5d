"""Reports over evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import answers as C
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import BASE
from quarrylight.catalog.routing import INTENT, MULTI_HOP
from quarrylight.functions import text as T
from quarrylight.operators import faithfulness as Q
from quarrylight.operators import runs as R

# Orders as questions of yearly runs: every measure has gaps, some questions have no outcome, some took no time.
MEASURES = {name: f"CASE WHEN (o_orderkey + {i}) % 7 = 0 THEN NULL ELSE ((o_custkey * {i + 3} + o_orderkey) % 11) / 10.0 END" for i, name in enumerate(R.MEANS)}
COLUMNS = {
    "topic": "o_orderpriority",
    "query_type": "o_orderstatus",
    "difficulty": "CASE o_orderkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END",
    "expected_deflection": "o_orderkey % 5 = 0",
    "deflected": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey % 4 = 0 END",
    "latency_ms": "CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE o_totalprice / 100.0 END",
}


def run_table(t):
    made = {name: F.expr(sql) for name, sql in COLUMNS.items()} | {name: F.expr(sql).cast("double") for name, sql in MEASURES.items()}
    return t.orders.select(F.year("o_orderdate").alias("run_id"), F.col("o_orderkey").alias("query_id"), *(c.alias(n) for n, c in made.items()))


RUN_SQL = "runs AS (SELECT year(o_orderdate)::INT AS run_id, o_orderkey AS query_id, " + ", ".join(f"{sql} AS {name}" for name, sql in (COLUMNS | MEASURES).items()) + " FROM orders)"


@query(
    "evaluation_summary",
    f"WITH {RUN_SQL} SELECT run_id, topic, query_type, difficulty, grouping(run_id, topic, query_type, difficulty)::BIGINT AS level, count(*) AS total_queries, "
    + ", ".join(f"round(coalesce(avg({m}) FILTER (WHERE NOT expected_deflection), 0.0), 6) AS {m}" for m in R.MEANS)
    + """, round(CASE WHEN count(deflected) > 0 THEN count_if(deflected = expected_deflection) / count(deflected) ELSE 0.0 END, 6) AS deflection_accuracy,
    round(coalesce(avg(latency_ms) FILTER (WHERE latency_ms > 0), 0.0), 6) AS avg_latency_ms
    FROM runs GROUP BY GROUPING SETS ((run_id), (run_id, topic), (run_id, query_type), (run_id, difficulty))""",
)
def evaluation_summary(t):
    out = R.summary(run_table(t))
    return out.withColumns({name: F.round(name, 6) for name in [*R.MEANS, "deflection_accuracy", "avg_latency_ms"]})


GROUPS = f"{INTENT} AS topic, CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type, {C.DIFFICULTY} AS difficulty"
CLASSED = C.DIAG.replace("SELECT query_id, citations, CASE WHEN n_truth > f", "SELECT query_id, citations, precision, recall, CASE WHEN n_truth > f")
KINDS = ", ".join(f"count_if({m} = 1)::BIGINT AS {m}_perfect, count_if({m} = 0)::BIGINT AS {m}_zero, count_if({m} <> 0 AND {m} <> 1)::BIGINT AS {m}_partial" for m in ("precision", "recall"))


def classed(t):
    q = F.col("question")
    groups = t.questions().select("query_id", T.query_intent(q).alias("topic"), T.query_type(q).alias("query_type"), F.expr(C.DIFFICULTY).alias("difficulty"))
    return C.diagnosed(t).join(groups, "query_id")


@query(
    "citation_splits",
    f"""{BASE}, {CLASSED}, told AS (SELECT class, precision, recall, {GROUPS} FROM classed JOIN questions USING (query_id))
    SELECT class, topic, query_type, difficulty, grouping(class, topic, query_type, difficulty)::BIGINT AS level, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, {KINDS}
    FROM told GROUP BY GROUPING SETS ((), (class), (topic), (query_type), (difficulty))""",
)
def citation_splits(t):
    return R.citation_splits(classed(t)).withColumns({m: F.round(m, 6) for m in ("precision", "recall")})


@query(
    "citation_root_causes",
    f"""{BASE}, {CLASSED}, c AS (SELECT class, count(*) AS n FROM classed GROUP BY class)
    SELECT class, n, round(n / sum(n) OVER (), 6) AS share, round(CASE WHEN class <> 'correct' THEN n / sum(n) FILTER (WHERE class <> 'correct') OVER () END, 6) AS failure_share FROM c""",
)
def citation_root_causes(t):
    return R.root_causes(classed(t)).withColumns({m: F.round(m, 6) for m in ("share", "failure_share")})


@query(
    "grounded_run_summary",
    f"""{BASE}, {C.RAF_BASE}, {C.ANSWERS.replace(C.SPARSE10 + ', ', '')},
    tok AS (SELECT query_id, unnest(list_distinct({C.P.word_list('answer')})) AS token FROM answers),
    known AS (SELECT query_id, token, bool_or(is_relevant) AS rel FROM (SELECT query_id, is_relevant, unnest(list_distinct({C.P.word_list('text')})) AS token FROM passages) GROUP BY query_id, token),
    sh AS (SELECT query_id, count_if(rel) / count(*) AS r, count_if(NOT rel) / count(*) AS i, count(rel) / count(*) AS p FROM tok LEFT JOIN known USING (query_id, token) GROUP BY query_id),
    f AS (SELECT query_id, len(list_intersect(a, g)) AS c, len(a) + len(g) AS s FROM (SELECT query_id, list_distinct({C.P.word_list('answer')}) AS a, list_distinct({C.P.word_list('question')}) AS g FROM answers)),
    facts AS (SELECT query_id, 0.7 * greatest(0.0, least(1.0, r - i)) + 0.3 * CASE WHEN c > 0 THEN 2.0 * c / s ELSE 0.0 END AS raf, 0.7 * p + 0.3 * CASE WHEN c > 0 THEN 2.0 * c / s ELSE 0.0 END AS uraf FROM f JOIN sh USING (query_id)),
    cited AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[(?:Source\\s+)?(\\d+)\\]', 1))::BIGINT AS passage_no FROM answers),
    st AS (SELECT query_id, count(c.passage_no) AS c, count_if(is_relevant) AS r, count_if(is_relevant AND c.passage_no IS NOT NULL) AS b FROM passages LEFT JOIN cited c USING (query_id, passage_no) GROUP BY query_id),
    pr AS (SELECT query_id, CASE WHEN c = 0 AND r = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE b / c END AS p, CASE WHEN r = 0 THEN 1.0 ELSE b / r END AS q FROM st),
    told AS (SELECT {C.DIFFICULTY} AS tag, raf, uraf, p, q, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END AS f1 FROM facts JOIN pr USING (query_id) JOIN questions USING (query_id))
    SELECT tag, count(*) AS n, round(avg(raf), 6) AS raf, round(avg(uraf), 6) AS uraf, round(avg(p), 6) AS attribution_precision, round(avg(q), 6) AS attribution_recall, round(avg(f1), 6) AS attribution_f1
    FROM told GROUP BY ROLLUP (tag)""",
)
def grounded_run_summary(t):
    answers, passages = C.answered(t).withColumn("gold", F.col("question")), C.passages(t)
    facts = Q.relevance_aware_factuality(answers, passages).select("query_id", "raf", "uraf")
    cited = Q.attribution(answers, passages).select("query_id", *(F.col(c).alias(f"attribution_{c}") for c in ("precision", "recall", "f1")))
    tags = t.questions().select("query_id", F.expr(C.DIFFICULTY).alias("tag"), F.lit(None).cast("double").alias("latency_ms"))
    out = R.grounded_summary(facts.join(cited, "query_id").join(tags, "query_id")).drop("avg_latency_ms")
    return out.select("tag", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))
