"""The agent loop over questions of every kind, with its plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.graph import ASKED, BOTH, MATCH, NODES, PLACES, places
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import HYBRID
from quarrylight.catalog.routing import MULTI_HOP
from quarrylight.functions import vocab as V
from quarrylight.plans import stepped
from quarrylight.session import settle

# Whole questions behind openings that bring about every kind: none, a comparison, two entities, one entity.
QUESTIONS = """asked AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Compare these: ' WHEN 2 THEN a.n_name || ' and ' || b.n_name || ': ' ELSE a.n_name || ': ' END || text AS question
    FROM benchmark JOIN nation a ON a.n_nationkey = item_id % 25 JOIN nation b ON b.n_nationkey = (item_id + 7) % 25)"""
GRAPH = f"{PLACES}, edges AS (SELECT *, s_key AS s_name, o_key AS o_name FROM places), {NODES}, {QUESTIONS}{MATCH.removeprefix(ASKED)}, {BOTH}"
PLANS = f"""near AS (SELECT key, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, neighbour, predicate, direction) AS place FROM both_ways) WHERE place <= 50),
  names AS (SELECT key AS neighbour, arg_min(name, (entity_type, name)) AS other FROM nodes GROUP BY key),
  fresh AS (SELECT DISTINCT m.query_id, other FROM matched m JOIN near USING (key) JOIN names USING (neighbour) JOIN asked a ON a.query_id = m.query_id WHERE NOT contains(lower(question), lower(other))),
  hints AS (SELECT query_id, string_agg(other, ' ' ORDER BY place) AS hint FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY other) AS place FROM fresh) WHERE place <= 8 GROUP BY query_id),
  kinds AS (SELECT query_id, question, question || ' [Related: ' || hint || ']' AS expanded, CASE WHEN {MULTI_HOP} THEN 'multi_hop' WHEN coalesce(n, 0) >= 2 THEN 'entity_heavy' ELSE 'simple' END AS query_type
    FROM asked LEFT JOIN hints USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM matched GROUP BY query_id) USING (query_id)),
  split_up AS (SELECT query_id, {P.sentences('question')} AS s FROM asked),
  pieces AS (SELECT query_id, unnest(range(0, len(s)))::INT AS nth, unnest(s) AS part FROM split_up WHERE len(s) BETWEEN 2 AND 4),
  plan1 AS (SELECT query_id, nth AS step, part AS question, 'part of the question' AS rationale, query_type FROM kinds JOIN pieces USING (query_id) WHERE query_type = 'multi_hop'
    UNION ALL SELECT query_id, 0, question, 'the question itself', query_type FROM kinds WHERE query_type <> 'multi_hop' OR query_id NOT IN (SELECT query_id FROM pieces)
    UNION ALL SELECT query_id, 1, expanded, 'related entities', query_type FROM kinds WHERE query_type = 'entity_heavy' AND expanded IS NOT NULL),
  wider AS (SELECT query_id, expanded FROM kinds k WHERE expanded IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plan1 p WHERE p.query_id = k.query_id AND p.question = expanded)),
  plan2 AS (SELECT query_id, 0 AS step, expanded AS question, 'related entities' AS rationale, query_type FROM wider JOIN kinds USING (query_id, expanded)
    UNION ALL SELECT query_id, nth, part, 'part of the question', 'multi_hop' FROM kinds k JOIN pieces USING (query_id) WHERE query_type <> 'multi_hop' AND query_id NOT IN (SELECT query_id FROM wider)
      AND NOT EXISTS (SELECT 1 FROM plan1 p WHERE p.query_id = k.query_id AND p.question = part))"""
RUN = f"""{P.CHUNKS}, {GRAPH}, {PLANS},
  every AS (SELECT query_id AS q, 0 AS round, 0 AS step, question FROM asked UNION ALL SELECT query_id, 1, step, question FROM plan1 UNION ALL SELECT query_id, 2, step, question FROM plan2),
  questions AS (SELECT q * 100 + round * 10 + step AS query_id, question FROM every), {HYBRID},
  told AS (SELECT query_id // 100 AS query_id, (query_id // 10 % 10)::INT AS round, (query_id % 10)::INT AS step, chunk_id, score FROM hybrid),
  c0 AS (SELECT * FROM told WHERE round = 0),
  need1 AS (SELECT query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM c0 WHERE score >= 0.85 GROUP BY query_id HAVING count(*) >= 2)),
  f1 AS (SELECT query_id, chunk_id, min(step) AS step, 1 AS round, arg_min(score, step) AS score FROM told WHERE round = 1 AND query_id IN (SELECT query_id FROM need1) GROUP BY query_id, chunk_id),
  u1 AS (SELECT query_id, chunk_id, score, round, step FROM c0 UNION ALL SELECT query_id, chunk_id, score, round, step FROM f1 WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM c0)),
  c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM u1) WHERE rank <= {V.TOP_K}),
  need2 AS (SELECT query_id FROM need1 WHERE query_id NOT IN (SELECT query_id FROM c1 WHERE score >= 0.85 GROUP BY query_id HAVING count(*) >= 2) AND query_id IN (SELECT query_id FROM plan2)),
  f2 AS (SELECT query_id, chunk_id, min(step) AS step, 2 AS round, arg_min(score, step) AS score FROM told WHERE round = 2 AND query_id IN (SELECT query_id FROM need2) GROUP BY query_id, chunk_id),
  u2 AS (SELECT query_id, chunk_id, score, round, step FROM c1 UNION ALL SELECT query_id, chunk_id, score, round, step FROM f2 WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM c1)),
  c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM u2) WHERE rank <= {V.TOP_K})"""


def asked(t):
    nation = t.nation.select("n_nationkey", "n_name")
    a, b = (nation.select(F.col("n_nationkey").alias(f"k{s}"), F.col("n_name").alias(s)) for s in "ab")
    items = t.benchmark.join(a, F.col("ka") == F.col("item_id") % 25).join(b, F.col("kb") == (F.col("item_id") + 7) % 25)
    kind = F.col("item_id") % 4
    lead = F.when(kind == 0, "").when(kind == 1, "Compare these: ").when(kind == 2, F.concat("a", F.lit(" and "), "b", F.lit(": "))).otherwise(F.concat("a", F.lit(": ")))
    return items.select(F.col("item_id").alias("query_id"), F.concat(lead, "text").alias("question"))


def knowledge(t):
    return places(t).withColumns({"s_name": F.col("s_key"), "o_name": F.col("o_key")})


def plans(t):
    questions, edges = asked(t), knowledge(t)
    kinds, parts = settle(stepped.kinds_of(questions, edges), "kinds"), stepped.parts_of(questions, stepped.sentence_parts)
    first = settle(stepped.first_plan(kinds, parts), "plan")
    return first, stepped.next_plan(kinds, parts, first)


@query("agent_plans", f"WITH {GRAPH}, {PLANS} SELECT 1 AS round, query_id, step, md5(question) AS question, rationale, query_type FROM plan1 UNION ALL SELECT 2, query_id, step, md5(question), rationale, query_type FROM plan2")
def agent_plans(t):
    """Both plans of every question, as if none were sufficient before."""
    both = [plan.withColumn("round", F.lit(n)) for n, plan in enumerate(plans(t), 1)]
    return both[0].unionByName(both[1]).withColumn("question", F.md5("question"))


@query(
    "agent_loop",
    f"""WITH {RUN} SELECT query_id, chunk_id, score, rank, round, step,
    CASE WHEN query_id IN (SELECT query_id FROM need2) THEN 3 WHEN query_id IN (SELECT query_id FROM need1) THEN 2 ELSE 1 END AS rounds FROM c2""",
)
def agent_loop(t):
    out = stepped.agent_run(asked(t), t.chunks(), knowledge(t))
    return out.withColumn("rank", F.col("rank").cast("bigint"))
