"""Shared SQL fragments for the check queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def any_of(text: str, needles: list[str]) -> str:
    """Does the lower-cased text hold any needle?"""
    return "(" + " OR ".join(f"contains(lower({text}), {lit(n)})" for n in needles) + ")"


def count_of(text: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), {lit(n)})::INT" for n in needles) + ")"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def index_tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), {lit(V.BM25_TOKEN)}), "
        f"lambda x: length(x) > 1 AND NOT list_contains({words(V.BM25_STOP)}, x))"
    )


def word_list(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+')"


def ascii_words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'))"


def content_words(text: str) -> str:
    return (
        rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), "
        rf"'[a-z][\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({words(V.CONTENT_STOP)}, x)))"
    )


def sentences(text: str) -> str:
    marked = rf"regexp_replace(coalesce({text}, ''), '([.!?])\s+', '\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), "
        "lambda s: length(s) > 0)"
    )


def split_ws(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: length(w) > 0)"


def hash_buckets(text: str) -> str:
    plain = rf"regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\s]', ' ', 'g')"
    return (
        f"list_transform(list_filter(regexp_split_to_array({plain}, '\\s+'), lambda w: length(w) > 1), "
        f"lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {V.HASH_DIM})::INT)"
    )


def stem(word: str) -> str:
    cases = " ".join(
        f"WHEN ends_with({word}, '{s}') AND length({word}) >= {len(s) + 3} "
        f"THEN substr({word}, 1, length({word}) - {len(s)})"
        for s in V.SUFFIXES
    )
    return f"CASE WHEN length({word}) <= 4 THEN {word} {cases} ELSE {word} END"


QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
CHUNKS = (
    "chunks AS (SELECT doc_id AS chunk_id, source AS paper_id, lang AS section, "
    "(2012 + doc_id % 14)::INT AS year, text FROM documents)"
)
RELEVANT = (
    "relevant AS (SELECT query_id, chunk_id FROM chunks, questions WHERE contains(chunks.text, question))"
)
EXCHANGES = (
    "exchanges AS (SELECT u.conv_id * 1000 + u.turn AS query_id, u.conv_id, u.turn, "
    "u.text AS question, a.text AS answer FROM conversations u JOIN conversations a "
    "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
)

INDEX = f"""
doc_tok AS (SELECT chunk_id, {index_tokens("text")} AS toks FROM chunks),
lengths AS (SELECT chunk_id, len(toks) AS dl FROM doc_tok),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
postings AS (SELECT chunk_id, term, least(count(*), {V.BM25_TF_CAP}) AS tf
    FROM (SELECT chunk_id, unnest(toks) AS term FROM doc_tok) GROUP BY chunk_id, term),
terms AS (SELECT term, df, ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) AS idf
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus)"""

BM25 = f"""
q_terms AS (SELECT query_id, term, count(*) AS qtf
    FROM (SELECT query_id, unnest({index_tokens("question")}) AS term FROM questions) GROUP BY query_id, term),
bm25 AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 8) AS score
    FROM q_terms JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (chunk_id), corpus
    GROUP BY query_id, chunk_id)"""

HASHED = f"""
doc_bucket AS (SELECT chunk_id, b, count(*) AS w
    FROM (SELECT chunk_id, unnest({hash_buckets("text")}) AS b FROM chunks) GROUP BY chunk_id, b),
doc_norm AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM doc_bucket GROUP BY chunk_id),
q_bucket AS (SELECT query_id, b, count(*) AS w
    FROM (SELECT query_id, unnest({hash_buckets("question")}) AS b FROM questions) GROUP BY query_id, b),
q_norm AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM q_bucket GROUP BY query_id),
dots AS (SELECT query_id, chunk_id, sum(d.w * q.w) AS dot
    FROM doc_bucket d JOIN q_bucket q USING (b) GROUP BY query_id, chunk_id),
dense AS (SELECT q.query_id, c.chunk_id, round(coalesce(dot / (q_norm.norm * doc_norm.norm), 0.0), 8) AS score
    FROM questions q CROSS JOIN chunks c
    LEFT JOIN dots ON dots.query_id = q.query_id AND dots.chunk_id = c.chunk_id
    LEFT JOIN q_norm ON q_norm.query_id = q.query_id
    LEFT JOIN doc_norm ON doc_norm.chunk_id = c.chunk_id)"""


def top(name: str, source: str, k: int, key: str = "chunk_id", where: str = "TRUE") -> str:
    """``name`` = best k rows per query of ``source`` with a rank."""
    return (
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
        f"ORDER BY score DESC, {key}) AS rank FROM {source} WHERE {where}) WHERE rank <= {k})"
    )


def led_sql(key: str, leads: list[str], text: str) -> str:
    """SQL: the text behind one of the leads, chosen by a key, so that every kind of text occurs."""
    return f"([{', '.join(map(lit, leads))}])[{key} % {len(leads)} + 1] || {text}"


def led(key: Column, leads: list[str], text: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, leads)), (F.pmod(key, F.lit(len(leads))) + 1).cast("int")), text)
