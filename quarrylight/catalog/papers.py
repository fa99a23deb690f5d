"""Papers by title, contexts under a token budget, stage times."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog.corpus import SECTIONS, sections
from quarrylight.catalog.registry import query
from quarrylight.functions import vocab as V
from quarrylight.operators import corpus as C
from quarrylight.operators import telemetry as M

TOKENS = 1_000


@query(
    "paper_list",
    """WITH chunks AS (SELECT doc_id AS chunk_id, source AS paper_id, nullif(split_part(text, ' ', 1), '') AS title, CASE WHEN doc_id % 3 > 0 THEN (2012 + doc_id % 14)::INT END AS year, CASE WHEN doc_id % 5 > 0 THEN source || '/' || lang END AS arxiv_id, lang FROM documents),
    p AS (SELECT paper_id, arg_min((title, year, arxiv_id), chunk_id) AS f, count(*) AS chunk_count, array_to_string(list_sort(list(DISTINCT nullif(lang, ''))), ',') AS sections FROM chunks WHERE coalesce(paper_id, '') <> '' GROUP BY paper_id)
    SELECT paper_id, coalesce(f[1], 'Unknown') AS title, coalesce(f[2], 0)::INT AS year, coalesce(f[3], '') AS arxiv_id, chunk_count, sections FROM p ORDER BY title, paper_id""",
)
def paper_list(t):
    chunks = t.documents.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.nullif(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("")).alias("title"),
        F.when(F.col("doc_id") % 3 > 0, (2012 + F.col("doc_id") % 14).cast("int")).alias("year"),
        F.when(F.col("doc_id") % 5 > 0, F.concat("source", F.lit("/"), "lang")).alias("arxiv_id"), F.col("lang").alias("section"),
    )
    return C.paper_list(chunks).withColumn("sections", F.array_join("sections", ","))


LABEL = "array_to_string(list_transform(string_split(replace(section, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(
    "document_context_texts",
    rf"""WITH {SECTIONS}, t AS (SELECT s.*, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, chr(10) || '## ' || {LABEL} || chr(10) AS head,
      CASE WHEN page_id % 4 > 0 THEN 'Authors: ' || array_to_string(list_transform(range(1, least(page_id % 9, 5) + 1), lambda i: 'Author ' || i), ', ') || chr(10) ELSE '' END AS names FROM sections s JOIN pages USING (page_id)),
    b AS (SELECT page_id, 'Title: ' || title || chr(10) || CASE WHEN page_id % 9 = 0 THEN '' ELSE names END AS lead, string_agg(head || text, chr(10) ORDER BY ord) AS whole,
      string_agg(head || CASE WHEN length(text) > 200 AND section <> 'abstract' THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '…' ELSE text END, chr(10) ORDER BY CASE WHEN section = 'abstract' THEN -1 ELSE ord END) AS less
      FROM t GROUP BY page_id, title, names),
    c AS (SELECT page_id, lead || whole AS whole, lead || less AS less FROM b)
    SELECT page_id, md5(CASE WHEN length(whole) <= {C.context_chars(TOKENS)} THEN whole WHEN length(less) > {C.context_chars(TOKENS)} THEN substr(less, 1, {C.context_chars(TOKENS)}) || chr(10) || '[truncated]' ELSE less END) AS context FROM c""",
)
def document_context_texts(t):
    """Contexts under a token budget, with up to five of each paper's authors."""
    names = F.transform(F.sequence(F.lit(1), F.col("page_id") % 9), lambda i: F.concat(F.lit("Author "), i.cast("string")))
    authors = F.when((F.col("page_id") % 4 > 0) & (F.col("page_id") % 9 > 0), names).otherwise(F.array().cast("array<string>"))
    rows = sections(t).withColumn("authors", authors)
    out = C.document_context(rows, "page_id", "title", C.context_chars(TOKENS), "authors")
    return out.select("page_id", F.md5("context").alias("context"))


@query(
    "stage_means",
    f"""WITH staged AS (SELECT event_type AS stage, value - 50 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age FROM events WHERE value - 50 > 0)
    SELECT stage, count(*) AS n, round(avg(ms), 6) AS mean FROM staged WHERE age <= {V.RING_REQUESTS} GROUP BY stage""",
)
def stage_means(t):
    timed = t.events.withColumn("ms", F.col("value") - 50)
    return M.stage_means(timed, "event_type", "ms", [F.col("ts").desc(), F.col("event_id").desc()]).withColumn("mean", F.round("mean", 6))
