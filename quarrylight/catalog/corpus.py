"""Corpus preparation on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.chunking import HIDDEN, WHOLE, chunks_sql
from quarrylight.catalog.registry import query
from quarrylight.catalog.routing import big
from quarrylight.operators import splits as S
from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators import corpus as C
from quarrylight.operators import graph as G

# Two overlapping paper sources: documents under versioned ids, pages under prefixed ids.
LEFT = "scraped AS (SELECT regexp_replace('arxiv:' || doc_id || 'v2', '^arxiv:|v\\d+$', '', 'g') AS paper_key, source AS title, text AS full_text FROM documents)"
RIGHT = "hub AS (SELECT page_id::VARCHAR AS paper_key, url AS title, html AS full_text FROM pages WHERE length(html) >= 100)"


def scraped(t):
    raw = F.concat(F.lit("arxiv:"), F.col("doc_id").cast("string"), F.lit("v2"))
    return t.documents.select(T.merge_paper_id(raw).alias("paper_key"), F.col("source").alias("title"), F.col("text").alias("full_text"))


def hub(t):
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.col("html").alias("content"))
    papers = C.usable_papers(C.parse_papers(rows))
    return papers.select(T.merge_paper_id(F.col("arxiv_id")).alias("paper_key"), "title", "full_text")


MERGED = f"""{LEFT}, {RIGHT}, merged AS (SELECT paper_key, coalesce(s.title, h.title) AS title, md5(coalesce(s.full_text, h.full_text)) AS digest,
  CASE WHEN h.paper_key IS NULL THEN 'left_only' WHEN s.paper_key IS NULL THEN 'right_only' ELSE 'both_prefer_left' END AS origin
  FROM scraped s FULL OUTER JOIN hub h USING (paper_key))"""


@query("merge_full_outer", f"WITH {MERGED} SELECT paper_key, title, digest, origin FROM merged")
def merge_full_outer(t):
    out = C.merge_sources(scraped(t), hub(t), "paper_key")
    return out.select("paper_key", "title", F.md5("full_text").alias("digest"), "origin")


@query("merge_counters", f"WITH {MERGED} SELECT origin, count(*) AS n FROM merged GROUP BY origin")
def merge_counters(t):
    return C.merge_sources(scraped(t), hub(t), "paper_key").groupBy("origin").agg(F.count("*").alias("n"))


@query(
    "merge_prefer_right",
    f"""WITH {LEFT}, {RIGHT} SELECT paper_key, coalesce(h.title, s.title) AS title,
    CASE WHEN h.paper_key IS NULL THEN 'left_only' WHEN s.paper_key IS NULL THEN 'right_only' ELSE 'both_prefer_right' END AS origin FROM scraped s FULL OUTER JOIN hub h USING (paper_key)""",
)
def merge_prefer_right(t):
    return C.merge_sources(scraped(t), hub(t), "paper_key", prefer_left=False).select("paper_key", "title", "origin")


@query(
    "parse_papers",
    """WITH p AS (SELECT page_id::VARCHAR AS id, url, html, coalesce(nullif(regexp_extract(url, '(20\\d{2}|19\\d{2})', 1), ''), NULL) AS y FROM pages WHERE length(html) >= 100)
    SELECT 'arxiv_' || id AS doc_id, url AS title, y::INT AS year, id AS arxiv_id, md5(html) AS digest FROM p""",
)
def parse_papers(t):
    rows = t.pages.select(
        F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.col("url").alias("published"), F.col("html").alias("content")
    )
    out = C.usable_papers(C.parse_papers(rows))
    return out.select("doc_id", "title", "year", "arxiv_id", F.md5("full_text").alias("digest"))


@query(
    "publication_years",
    """SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN (1990 + doc_id % 40)::INT END, nullif(regexp_extract(text, '(20\\d{2}|19\\d{2})', 1), '')::INT,
      CASE WHEN (doc_id % 100) < 50 THEN 2000 + doc_id % 100 ELSE 1900 + doc_id % 100 END)::INT AS year FROM documents LEFT JOIN labels USING (doc_id)""",
)
def publication_years(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    direct = F.when(F.col("quality") == 1, 1990 + F.col("doc_id") % 40)
    paper_id = F.format_string("%02d01.12345", F.col("doc_id") % 100)
    return rows.select("doc_id", T.publication_year(direct, F.col("text"), paper_id).alias("year"))


@query("upsert_chunks", """SELECT d.doc_id AS chunk_id, coalesce(p.url, d.source) AS label, p.page_id IS NOT NULL AS replaced FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
    UNION ALL SELECT page_id, url, TRUE FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents)""")
def upsert_chunks(t):
    existing = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("label"), F.lit(False).alias("replaced"))
    incoming = t.pages.select(F.col("page_id").alias("chunk_id"), F.col("url").alias("label"), F.lit(True).alias("replaced"))
    return C.upsert(existing, incoming, "chunk_id")


@query("crawl_unseen", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def crawl_unseen(t):
    return C.unseen(t.documents.select("doc_id"), t.labels, "doc_id")


@query(
    "first_topic_wins",
    """SELECT doc_id, min(topic_no)::INT AS topic_no FROM (SELECT doc_id, 0 AS topic_no FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1
    UNION ALL SELECT doc_id, 2 FROM documents) GROUP BY doc_id""",
)
def first_topic_wins(t):
    topics = [t.labels.where("quality = 1").select("doc_id"), t.labels.where("toxic = 1").select("doc_id"), t.documents.select("doc_id")]
    return C.first_topic_wins(topics, "doc_id")


@query("last_row_per_id", "SELECT conv_id, arg_max(md5(text), turn) AS digest, max(turn) AS turn FROM conversations GROUP BY conv_id")
def last_row_per_id(t):
    rows = t.conversations.select("conv_id", "turn", F.md5("text").alias("digest"))
    return C.last_by_key(rows, "conv_id", F.col("turn")).select("conv_id", "digest", "turn")


@query("enrich_chunks", "SELECT d.doc_id AS chunk_id, coalesce(l.quality, -1)::INT AS quality, l.doc_id IS NOT NULL AS enriched FROM documents d LEFT JOIN labels l USING (doc_id)")
def enrich_chunks(t):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("chunk_id"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNotNull().alias("enriched"))


@query(
    "fingerprint_cache",
    """WITH cache AS (SELECT DISTINCT substr(sha256(text), 1, 16) AS fingerprint FROM conversations UNION SELECT DISTINCT substr(sha256(text), 1, 16) FROM documents WHERE lang = 'en')
    SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint, c.fingerprint IS NOT NULL AS hit FROM documents LEFT JOIN cache c ON c.fingerprint = substr(sha256(text), 1, 16)""",
)
def fingerprint_cache(t):
    seen = t.conversations.select("text").unionByName(t.documents.where("lang = 'en'").select("text"))
    cache = seen.select(T.fingerprint(F.col("text")).alias("fingerprint")).distinct().withColumn("cached", F.lit(1))
    return C.with_cache(t.documents, "text", cache).select("doc_id", "fingerprint", "hit")


@query(
    "corpus_stats",
    "SELECT count(*) AS total_chunks, count(DISTINCT source) AS papers, count(DISTINCT lang) AS sections, count(*) / count(DISTINCT source) AS chunks_per_paper FROM documents",
)
def corpus_stats(t):
    return C.corpus_stats(t.chunks())


@query(
    "paper_listing",
    f"""WITH {P.CHUNKS} SELECT paper_id, arg_min(year, chunk_id) AS year, count(*) AS chunk_count, array_to_string(list_sort(list(DISTINCT nullif(section, ''))), ',') AS sections FROM chunks GROUP BY paper_id""",
)
def paper_listing(t):
    return C.list_papers(t.chunks()).withColumn("sections", F.array_join("sections", ","))


@query("section_topk", "SELECT source AS section, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, section LIMIT 10")
def section_topk(t):
    counts = t.documents.groupBy(F.col("source").alias("section")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "section").limit(10)


@query("year_range", f"WITH {P.CHUNKS} SELECT min(year) AS min_year, max(year) AS max_year, count(DISTINCT coalesce(nullif(paper_id, ''), chunk_id::VARCHAR)) AS papers FROM chunks")
def year_range(t):
    key = F.coalesce(F.nullif("paper_id", F.lit("")), F.col("chunk_id").cast("string"))
    return t.chunks().agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.count_distinct(key).alias("papers"))


@query(
    "text_length_stats",
    "SELECT count(*) AS n, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len, round(avg(length(text)), 6) AS avg_len, list_sort(list(length(text)))[count(*) // 2 + 1]::INT AS median_len FROM documents",
)
def text_length_stats(t):
    return C.length_stats(t.documents).withColumn("avg_len", F.round("avg_len", 6))


@query(
    "paper_view_order",
    f"""WITH {P.CHUNKS}, c AS (SELECT paper_id, paper_id || '_' || section || '_' || printf('%03d', chunk_id) AS chunk_id, CASE section WHEN 'en' THEN 'abstract' WHEN 'fr' THEN 'method' WHEN 'de' THEN 'results' ELSE section END AS section, chunk_id AS n FROM chunks)
    SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY CASE section WHEN 'abstract' THEN 0 WHEN 'method' THEN 4 WHEN 'results' THEN 7 ELSE 5 END, n, chunk_id) AS position FROM c""",
)
def paper_view_order(t):
    name = F.when(F.col("section") == "en", "abstract").when(F.col("section") == "fr", "method").when(F.col("section") == "de", "results").otherwise(F.col("section"))
    rows = t.chunks().select("paper_id", F.format_string("%s_%s_%03d", "paper_id", "section", "chunk_id").alias("chunk_id"), name.alias("section"))
    return big(C.paper_view(rows), "position").select("paper_id", "chunk_id", "position")


@query(
    "preferred_paper_chunks",
    f"""WITH {P.CHUNKS}, wanted AS (SELECT DISTINCT source AS paper_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), c AS (SELECT *, CASE section WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 6 END AS o FROM chunks WHERE paper_id IN (SELECT paper_id FROM wanted))
    SELECT paper_id, chunk_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY o, chunk_id) AS nth FROM c) WHERE nth <= 3""",
)
def preferred_paper_chunks(t):
    name = F.when(F.col("section") == "fr", "abstract").when(F.col("section") == "en", "introduction").otherwise(F.col("section"))
    wanted = t.documents.join(t.labels.where("quality = 1"), "doc_id").select(F.col("source").alias("paper_id")).distinct()
    return big(C.preferred_chunks(t.chunks().withColumn("section", name), wanted), "nth").select("paper_id", "chunk_id", "nth")


# ---------------------------------------------------------- text functions


@query(
    "author_lines",
    r"""WITH a AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: length(w) > 0) AS w FROM part)
    SELECT p_partkey, CASE WHEN len(w) = 0 THEN 'Unknown' WHEN len(w) > 3 THEN w[1] || ' et al.' WHEN len(w) = 1 THEN w[1] WHEN len(w) = 2 THEN w[1] || ' and ' || w[2]
      ELSE w[1] || ', ' || w[2] || ', and ' || w[3] END AS authors FROM a""",
)
def author_lines(t):
    names = F.filter(F.split("p_name", r"\s+"), lambda w: F.length(w) > 0)
    return t.part.select("p_partkey", T.author_line(names).alias("authors"))


@query(
    "paper_id_forms",
    r"""SELECT doc_id, printf('%04d', doc_id % 10000) || '.' || printf('%05d', doc_id) AS metric_id, printf('%07d', doc_id)[1:4] || '.' || printf('%07d', doc_id)[5:] AS merge_id, doc_id::VARCHAR AS viewer_id FROM documents""",
)
def paper_id_forms(t):
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        T.metric_paper_id(F.format_string("ArXiv_%04d_%05d", d % 10000, d)).alias("metric_id"),
        T.merge_paper_id(F.format_string("arxiv:cs/%07dv3", d)).alias("merge_id"),
        T.viewer_paper_id(F.format_string(" arxiv_%dv12", d)).alias("viewer_id"),
    )


SECTION_NAME = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace({x}, '^[\d.]+\s*', ''), '^[IVXLC]+\.\s*', '')), '^\s+|\s+$', '', 'g')), '[:\-–—]+$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"""


@query(
    "section_names",
    f"""WITH h AS (SELECT page_id, (page_id % 9) || '.' || (page_id % 4) || ' ' || regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) || ': ' AS raw FROM pages)
    SELECT page_id, coalesce(nullif({SECTION_NAME.format(x='raw')}, ''), 'unnamed') AS section FROM h""",
)
def section_names(t):
    raw = F.concat(
        (F.col("page_id") % 9).cast("string"), F.lit("."), (F.col("page_id") % 4).cast("string"), F.lit(" "),
        F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), F.lit(": "),
    )
    return t.pages.select("page_id", T.section_name(raw).alias("section"))


# Pages as markdown: headings become header lines, other tags vanish.
MARKDOWN = r"""regexp_replace(regexp_replace(regexp_replace(html, '<h1>([^<]*)</h1>', chr(10) || '# \1' || chr(10), 'g'), '<title>([^<]*)</title>', chr(10) || '## \1' || chr(10), 'g'), '<[^>]*>', ' ', 'g')"""


def markdown(t):
    text = F.regexp_replace("html", "<h1>([^<]*)</h1>", "\n# $1\n")
    text = F.regexp_replace(text, "<title>([^<]*)</title>", "\n## $1\n")
    return t.pages.select("page_id", F.regexp_replace(text, "<[^>]*>", " ").alias("text"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


SECTIONS = rf"""md AS (SELECT page_id, {MARKDOWN} AS text FROM pages),
pieces AS (SELECT page_id, unnest(string_split(regexp_replace(text, '(?m)^([ \t]*#{{1,4}}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1))) AS piece,
  generate_subscripts(string_split(regexp_replace(text, '(?m)^([ \t]*#{{1,4}}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)), 1) AS ord FROM md),
named AS (SELECT page_id, ord, CASE WHEN regexp_matches(piece, '^[ \t]*#{{1,4}}[ \t]+([^\n]*)\S') THEN coalesce(nullif({SECTION_NAME.format(x=P.strip(r"regexp_extract(piece, '^[ \t]*#{1,4}[ \t]+([^\n]*)', 1)"))}, ''), 'unnamed') ELSE 'preamble' END AS section,
  {P.strip(r"CASE WHEN regexp_matches(piece, '^[ \t]*#{1,4}[ \t]+([^\n]*)\S') THEN regexp_replace(piece, '^[ \t]*#{1,4}[ \t]+([^\n]*)', '') ELSE piece END")} AS text FROM pieces),
sections AS (SELECT page_id, section, min(ord) AS ord, arg_max(text, ord) AS text FROM named WHERE length(text) > 0 GROUP BY page_id, section)"""


def sections(t):
    md = markdown(t)
    return C.markdown_sections(md, "page_id", "text").join(md.select("page_id", "title"), "page_id")


@query("markdown_sections", f"WITH {SECTIONS} SELECT page_id, section, md5(text) AS digest, length(text)::INT AS n_chars FROM sections")
def markdown_sections(t):
    return C.markdown_sections(markdown(t), "page_id", "text").select("page_id", "section", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


@query(
    "indexable_sections",
    f"WITH {SECTIONS} SELECT page_id, section FROM sections WHERE NOT list_contains({P.words(V.SECTION_BLOCKLIST)}, lower(section)) AND length({P.strip('text')}) >= 50",
)
def indexable_sections(t):
    return C.indexable_sections(sections(t)).select("page_id", "section")


TIDY = P.strip("array_to_string(list_transform(string_split(regexp_replace(chunk, chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda l: " + P.strip("l") + "), chr(10))")


@query(
    "chunk_recursive",
    f"""WITH RECURSIVE {SECTIONS}, plain AS (SELECT page_id || '/' || section AS id, text AS body FROM sections
      WHERE NOT list_contains({P.words(V.SECTION_BLOCKLIST)}, lower(section)) AND length({P.strip('text')}) >= {V.MIN_SECTION_CHARS}),
    {HIDDEN}, {chunks_sql('texts', V.CHUNK_CHARS, V.CHUNK_OVERLAP_CHARS, V.CHUNK_SEPARATORS)},
    restored AS (SELECT id, ord, {WHOLE} AS chunk FROM chunks JOIN found USING (id)),
    tidied AS (SELECT page_id, section, restored.ord AS ord, {TIDY} AS body, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
      array_to_string(list_transform(string_split(replace(section, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM restored JOIN sections ON id = page_id || '/' || section JOIN pages USING (page_id))
    SELECT format('{{}}_{{}}_{{:03d}}', page_id, section, ord) AS chunk_id, page_id, section, ord::INT AS ord, title || ' — ' || label || chr(10) || chr(10) || body AS text FROM tidied WHERE length(body) >= {V.MIN_CHUNK_CHARS}""",
)
def chunk_recursive(t):
    return C.chunk_sections(sections(t), "page_id", "title")


PAIR = r"'([A-Za-z][A-Za-z\s\-]{2,50})\s*\(([A-Z][A-Z0-9]{1,10})\)'"
SPELLED = "p.f || ' (' || p.a || ')'"


@query(
    "chunk_documents",
    rf"""WITH RECURSIVE sections AS (SELECT doc_id, source, text || ' Retrieval ' || upper(lang) || ' Index (R' || upper(lang) || ') and R' || upper(lang) || ' again.' AS text FROM documents),
    plain AS (SELECT doc_id AS id, text AS body FROM sections WHERE length({P.strip('text')}) >= {V.MIN_SECTION_CHARS}),
    {HIDDEN}, {chunks_sql('texts', V.CHUNK_CHARS, V.CHUNK_OVERLAP_CHARS, V.CHUNK_SEPARATORS)},
    named AS (SELECT doc_id, list_filter(list_transform(list_zip(regexp_extract_all(text, {PAIR}, 2), regexp_extract_all(text, {PAIR}, 1)), lambda z: {{'a': z[1], 'f': {P.strip('z[2]')}}}),
      lambda p: len(regexp_extract_all(p.f, '(?:^|\s)[A-Za-z]')) >= 2) AS every FROM sections),
    pairs AS (SELECT doc_id, list_transform(list_filter(every, lambda p, i: len(list_filter(every[i + 1:], lambda q: q.a = p.a)) = 0), lambda p: {{'a': p.a, 'f': p.f, 't': ''}}) AS pairs FROM named),
    restored AS (SELECT chunks.id AS doc_id, ord, {WHOLE} AS raw FROM chunks JOIN found ON found.id = chunks.id),
    spelled AS (SELECT doc_id, ord, list_reduce(list_prepend({{'a': '', 'f': '', 't': raw}}, pairs), lambda s, p: {{'a': '', 'f': '',
      't': CASE WHEN contains(s.t, {SPELLED}) THEN s.t ELSE regexp_replace(s.t, '\b' || p.a || '\b', {SPELLED}) END}}).t AS chunk FROM restored JOIN pairs USING (doc_id)),
    tidied AS (SELECT doc_id, ord, source AS title, {TIDY} AS body FROM spelled JOIN sections USING (doc_id))
    SELECT format('{{}}_full_text_{{:03d}}', doc_id, ord) AS chunk_id, doc_id, 'full_text' AS section, ord::INT AS ord, title || ' — Full Text' || chr(10) || chr(10) || body AS text FROM tidied WHERE length(body) >= {V.MIN_CHUNK_CHARS}""",
)
def chunk_documents(t):
    """Every document whole, with an acronym behind it that is spelled out where it comes up again."""
    tail = F.concat(F.lit(" Retrieval "), F.upper("lang"), F.lit(" Index (R"), F.upper("lang"), F.lit(") and R"), F.upper("lang"), F.lit(" again."))
    texts = t.documents.select("doc_id", F.lit("full_text").alias("section"), F.col("source").alias("title"), F.concat("text", tail).alias("text"))
    return C.chunk_sections(texts.withColumn("acronyms", T.acronym_pairs(F.col("text"))), "doc_id", "title", acronyms="acronyms")


@query("chunk_semantic")
def chunk_semantic(t):
    return S.semantic_chunks(t.documents, "doc_id", "text")


@query("pdf_sections")
def pdf_sections(t):
    rows = S.pdf_sections(t.documents, "doc_id", "text")
    named = rows.select("doc_id", "ord", F.when(F.col("header").isin("preamble", "full_text"), F.col("header")).otherwise(T.section_name(F.col("header"))).alias("section"), "text")
    return named.groupBy("doc_id", "section").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"))


@query("repaired_texts")
def repaired_texts(t):
    return S.strip_preambles(t.documents.select("doc_id", S.fix_encoding(F.col("text")).alias("text")), "doc_id", "text")


@query(
    "acronym_definitions",
    r"""WITH d AS (SELECT doc_id, text || ' Retrieval ' || upper(lang) || ' Index (R' || upper(lang) || ')' AS text FROM documents),
    p AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z\s\-]{2,50})\s*\(([A-Z][A-Z0-9]{1,10})\)', 2)) AS acronym, """
    + P.strip(r"unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z\s\-]{2,50})\s*\(([A-Z][A-Z0-9]{1,10})\)', 1))")
    + r""" AS full_form FROM d) SELECT doc_id, acronym, full_form FROM p WHERE len(regexp_extract_all(full_form, '(?:^|\s)[A-Za-z]')) >= 2""",
)
def acronym_definitions(t):
    text = F.concat("text", F.lit(" Retrieval "), F.upper("lang"), F.lit(" Index (R"), F.upper("lang"), F.lit(")"))
    rows = t.documents.select("doc_id", T.unnest(T.acronym_pairs(text)).alias("p"))
    return rows.where("p IS NOT NULL").select("doc_id", "p.acronym", "p.full_form")


@query("tidy_whitespace", f"""SELECT doc_id, md5({P.strip("array_to_string(list_transform(string_split(regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda l: " + P.strip('l') + "), chr(10))")}) AS digest FROM documents""")
def tidy_whitespace(t):
    return t.documents.select("doc_id", F.md5(T.tidy_whitespace(F.col("text"))).alias("digest"))


@query(
    "document_contexts",
    rf"""WITH {SECTIONS}, t AS (SELECT s.*, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, chr(10) || '## ' || section || chr(10) AS head FROM sections s JOIN pages USING (page_id)),
    b AS (SELECT page_id, 'Title: ' || title || chr(10) || string_agg(head || text, chr(10) ORDER BY ord) AS whole,
      'Title: ' || title || chr(10) || string_agg(head || CASE WHEN length(text) > 200 AND section <> 'abstract' THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '…' ELSE text END, chr(10) ORDER BY CASE WHEN section = 'abstract' THEN -1 ELSE ord END) AS less
      FROM t GROUP BY page_id, title)
    SELECT page_id, length(CASE WHEN length(whole) <= 2000 THEN whole WHEN length(less) > 2000 THEN substr(less, 1, 2000) || chr(10) || '[truncated]' ELSE less END)::INT AS n_chars,
      length(whole) <= 2000 AS complete FROM b""",
)
def document_contexts(t):
    out = C.document_context(sections(t), "page_id", "title", 2000)
    full = C.document_context(sections(t), "page_id", "title", 1 << 30).select("page_id", (F.length("context") <= 2000).alias("complete"))
    return out.join(full, "page_id").select("page_id", F.length("context").alias("n_chars"), "complete")


@query(
    "json_triples",
    """WITH r AS (SELECT p_partkey, p_name, p_brand, upper(trim(p_type)) AS predicate FROM part)
    SELECT p_partkey AS chunk_id, p_name AS s_name, 'MODEL' AS s_type, predicate, p_brand AS o_name, 'OTHER' AS o_type FROM r WHERE lower(p_name) <> lower(p_brand)""",
)
def json_triples(t):
    item = F.to_json(
        F.array(
            F.struct(
                F.concat(F.lit(" "), "p_name").alias("subject_name"), F.lit("model").alias("subject_type"),
                F.lower("p_type").alias("predicate"), F.col("p_brand").alias("object_name"),
            ),
            F.struct(F.lit("same").alias("subject_name"), F.lit("x").alias("subject_type"), F.lit("is").alias("predicate"), F.lit("Same").alias("object_name")),
        )
    )
    wrapped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), item, F.lit("\n```"))).otherwise(item)
    replies = t.part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("doc_id"), wrapped.alias("response"))
    return G.parse_triples(replies).select("chunk_id", "s_name", "s_type", "predicate", "o_name", "o_type")
