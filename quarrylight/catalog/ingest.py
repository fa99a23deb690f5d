"""Two runs of an ingest from two sources: everything first, then what was revised, added or withdrawn."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog.chunking import OVERLAP, SIZE, chunks_sql
from quarrylight.catalog.registry import query
from quarrylight.functions import vocab as V
from quarrylight.operators.packing import recursive_chunks
from quarrylight.plans import ingest
from quarrylight.session import own_folder

# The left source has documents with even keys, the right one those divisible by 3 or not by 2, with another text ahead.
# In the second run every seventh left document is revised, every eleventh withdrawn from both, and every 13th is new.
SOURCES = """state AS (SELECT n, doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || CASE WHEN n = 1 AND doc_id % 7 = 0 THEN ' Revised.' ELSE '' END ELSE 'Second source. ' || coalesce(text, '') END AS text
    FROM documents, (VALUES (0), (1)) AS v(n) WHERE (n = 0 AND doc_id % 13 <> 0) OR (n = 1 AND doc_id % 11 <> 0))"""
TEXTS = f"{SOURCES}, texts AS (SELECT n || ':' || doc_id AS id, text AS body FROM state), {chunks_sql('texts', SIZE, OVERLAP, V.CHUNK_SEPARATORS)}"
CHANGED = """changed AS (SELECT s.n, s.doc_id FROM state s LEFT JOIN state b ON b.n = s.n - 1 AND b.doc_id = s.doc_id WHERE s.n = 0 OR b.doc_id IS NULL OR b.text <> s.text),
    gone AS (SELECT count(*) AS c FROM state b WHERE n = 0 AND NOT EXISTS (SELECT 1 FROM state s WHERE s.n = 1 AND s.doc_id = b.doc_id)),
    told AS (SELECT split_part(id, ':', 1)::INT AS n, split_part(id, ':', 2)::BIGINT AS doc_id, ord, chunk FROM chunks)"""


def source_rows(t, run: int):
    docs = t.documents.where("doc_id % 13 <> 0" if run == 0 else "doc_id % 11 <> 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    revised = F.when((F.col("doc_id") % 7 == 0) & F.lit(run == 1), " Revised.").otherwise("")
    left = docs.where("doc_id % 2 = 0").select("doc_id", F.concat("text", revised).alias("text"))
    right = docs.where("doc_id % 3 = 0 OR doc_id % 2 <> 0").select("doc_id", F.concat(F.lit("Second source. "), "text").alias("text"))
    return ingest.two_sources(left, right, "doc_id")


def chunked(rows):
    return recursive_chunks(rows.select("doc_id", "text"), "text", SIZE, OVERLAP, whole_equations=False)


def two_runs(t):
    folder = own_folder(t.spark, "ingest")
    reports = [ingest.ingest(source_rows(t, run), folder, "doc_id", [("papers", lambda rows: rows), ("chunks", chunked)]) for run in (0, 1)]
    return folder, reports[0].unionByName(reports[1])


@query(
    "ingested_chunks",
    f"WITH RECURSIVE {TEXTS}, {CHANGED} SELECT doc_id, ord, md5(chunk) AS chunk FROM told WHERE n = 1",
)
def ingested_chunks(t):
    """The chunks after both runs are those of the second state, most of them made in the first run."""
    folder, _ = two_runs(t)
    rows = ingest.current(t.spark, folder, "chunks", "doc_id")
    return rows.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.md5("chunk").alias("chunk"))


@query(
    "ingest_reports",
    f"""WITH RECURSIVE {TEXTS}, {CHANGED}, made AS (SELECT n, doc_id FROM told JOIN changed USING (n, doc_id))
    SELECT n AS run, 'plan' AS step, (SELECT count(*) FROM changed c WHERE c.n = s.n) AS n_papers, count(*) AS n_rows, false AS reused FROM state s GROUP BY n
    UNION ALL SELECT v.n, 'gone', CASE WHEN v.n = 1 THEN gone.c ELSE 0 END, 0, false FROM gone, (VALUES (0), (1)) AS v(n)
    UNION ALL SELECT n, 'papers', count(*), count(*), false FROM changed GROUP BY n
    UNION ALL SELECT n, 'chunks', count(DISTINCT doc_id), count(*), false FROM made GROUP BY n""",
)
def ingest_reports(t):
    """What each run did: the second one touches revised, new and withdrawn documents only."""
    return two_runs(t)[1]
