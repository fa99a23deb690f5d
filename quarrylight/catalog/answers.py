"""Answers, citations, and evaluation of both."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.registry import query
from quarrylight.catalog.retrieval import BASE, HYBRID, SOURCE_FILTER
from quarrylight.catalog.routing import GATE, INTENT, MULTI_HOP, PROFILE, big, reranked, with_meta
from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators import answers as A
from quarrylight.operators import evaluate as E
from quarrylight.operators import faithfulness as Q
from quarrylight.operators import fusion, routing, sparse
from quarrylight.operators.sizing import broadcast_if_small
from quarrylight.session import settle

SPARSE10 = f"{P.INDEX}, {P.BM25}, {P.top('hybrid', 'bm25', 10, where='score > 0')}"
TXT = P.strip("text")
ANSWERS = f"""{SPARSE10}, {SOURCE_FILTER},
src AS (SELECT query_id, source_number, chunk_id, paper_id, section, year, text, score FROM picked JOIN chunks USING (chunk_id)),
ex AS (SELECT query_id, source_number, {TXT} AS txt, array_to_string(list_slice({P.sentences(TXT)}, 1, 3), ' ') AS excerpt FROM src),
joined AS (SELECT query_id, string_agg(excerpt || ' [Source ' || source_number || '].', chr(10) || chr(10) ORDER BY source_number)
  FILTER (WHERE length(txt) > 20 AND length(excerpt) > 0) AS a, count(*) AS n FROM ex GROUP BY query_id),
answers AS (SELECT query_id, question, CASE WHEN n IS NULL THEN {P.lit(A.NO_SOURCES)} WHEN a IS NULL THEN {P.lit(A.NO_DETAIL)} ELSE a END AS answer
  FROM questions LEFT JOIN joined USING (query_id))"""


def sparse10(t):
    return sparse.bm25_search(t.questions(), sparse.build_index(t.chunks()), 10)


def sources(t):
    picked = fusion.filter_sources(sparse10(t)).select("query_id", "chunk_id", "score", "source_number")
    small = broadcast_if_small(picked, t.questions().select("query_id"), 64)
    return settle(t.chunks().join(small, "chunk_id"), "sources")


def answered(t, src=None):
    return A.template_answer(t.questions(), sources(t) if src is None else src)


@query("template_answer", f"{BASE}, {ANSWERS} SELECT query_id, answer FROM answers")
def template_answer(t):
    return answered(t).select("query_id", "answer")


@query(
    "citation_lines",
    f"""{BASE}, {ANSWERS} SELECT query_id, string_agg('[Source ' || source_number || '] ' || paper_id || ' — ' || section, chr(10) ORDER BY source_number) AS citations
    FROM src GROUP BY query_id""",
)
def citation_lines(t):
    return A.citation_lines(sources(t)).withColumn("citations", F.array_join("citations", "\n"))


CLEAN = "text"
for _pattern, _new in [
    ("​", ""), ("﻿", ""), (" ", " "), (r"∈\s*∈", "∈"), (r"×\s*×", "×"), (r"∀\s*∀", "∀"), (r"∃\s*∃", "∃"),
    (r"∇\s*∇", "∇"), (r"\s+([,;:])", r"\1"), (r"([,;:])\s+([^\s])", r"\1 \2"),
    (r"R([a-z])\s*×\s*×\s*([a-z])", r"R^{\1×\2}"), (r"R([a-z])\s*×\s*([a-z])", r"R^{\1×\2}"), (r"\s+", " "),
]:
    CLEAN = f"regexp_replace({CLEAN}, {P.lit(_pattern)}, {P.lit(_new)}, 'g')"
CLEAN = P.strip(CLEAN)


@query(
    "prompt_source_blocks",
    f"""{BASE}, {ANSWERS} SELECT query_id, string_agg('[Source ' || source_number || '] ' || paper_id || ' (' || year || ')' ||
      CASE WHEN section <> '' THEN ' — ' || section ELSE '' END || chr(10) || {CLEAN}, chr(10) || chr(10) ORDER BY source_number) AS block
    FROM src GROUP BY query_id""",
)
def prompt_source_blocks(t):
    return A.source_blocks(sources(t))


def cite_words(text):
    return (
        rf"list_distinct(list_filter({P.word_list(text)}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') "
        rf"AND NOT list_contains({P.words(V.CITATION_STOP)}, w)))"
    )


@query(
    "inject_missing_citations",
    f"""{BASE}, {ANSWERS},
    reply AS (SELECT query_id, question AS answer FROM questions),
    sents AS (SELECT query_id, pos, sentence FROM (SELECT query_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos
      FROM (SELECT query_id, {P.sentences("answer")} AS s FROM reply))),
    w AS (SELECT *, {cite_words("sentence")} AS words FROM sents),
    m AS (SELECT *, length(sentence) >= 30 AND NOT regexp_matches(sentence, '\\[Source\\s+\\d+\\]') AND len(words) >= 3 AS free FROM w),
    sw AS (SELECT query_id, source_number, {cite_words("text")} AS source_words FROM src),
    ov AS (SELECT m.query_id, pos, source_number, len(list_intersect(words, source_words)) / len(words) AS o FROM m JOIN sw USING (query_id) WHERE free),
    best AS (SELECT query_id, pos, source_number FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY o DESC, source_number) AS nth FROM ov)
      WHERE nth = 1 AND o >= 0.3),
    cited AS (SELECT query_id, pos, CASE WHEN source_number IS NULL THEN sentence
      WHEN regexp_matches(sentence, '[.!?]$') THEN substr(sentence, 1, length(sentence) - 1) || ' [Source ' || source_number || ']' || right(sentence, 1)
      ELSE sentence || ' [Source ' || source_number || ']' END AS sentence FROM m LEFT JOIN best USING (query_id, pos))
    SELECT query_id, string_agg(sentence, ' ' ORDER BY pos) AS answer FROM cited GROUP BY query_id""",
)
def inject_missing_citations(t):
    replies = t.questions().select("query_id", F.col("question").alias("answer"))
    return A.inject_citations(replies, sources(t))


# Answers in which only part of the sources is cited: every source whose number divides the
# length of the question is dropped from the text.
PARTIAL = """partial AS (SELECT query_id, 'See [Source ' || (1 + length(question) % 5) || '] and [Source ' || (1 + length(question) % 3) || '].' AS answer FROM questions)"""


def partial_answers(t):
    n = F.length("question")
    text = F.concat(
        F.lit("See [Source "), (1 + n % 5).cast("string"), F.lit("] and [Source "), (1 + n % 3).cast("string"), F.lit("].")
    )
    return t.questions().select("query_id", text.alias("answer"))


@query(
    "renumber_citations",
    f"""{BASE}, {ANSWERS}, {PARTIAL},
    nums AS (SELECT query_id, answer, (1 + length(question) % 5) AS x, (1 + length(question) % 3) AS y, (SELECT count(*) FROM src s WHERE s.query_id = q.query_id) AS n
      FROM partial JOIN questions q USING (query_id)),
    kept AS (SELECT *, list_filter(range(1, n + 1), lambda i: i = x OR i = y) AS kept FROM nums),
    named AS (SELECT *, CASE WHEN len(kept) = n THEN x WHEN list_contains(kept, x) THEN list_position(kept, x) ELSE x END AS x2,
      CASE WHEN len(kept) = n THEN y WHEN list_contains(kept, y) THEN list_position(kept, y) ELSE y END AS y2 FROM kept)
    SELECT query_id, 'See [Source ' || x2 || '] and [Source ' || y2 || '].' AS answer,
      array_to_string(CASE WHEN len(kept) = n THEN range(1, n + 1) ELSE kept END, ',') AS kept FROM named""",
)
def renumber_citations(t):
    out = A.renumber_citations(partial_answers(t), sources(t))
    return out.select("query_id", "answer", F.array_join(F.transform("kept", lambda k: k.cast("string")), ",").alias("kept"))


@query(
    "per_source_citations",
    f"""{BASE}, {ANSWERS}, {PARTIAL},
    full_text AS (SELECT query_id, answer || chr(10) || 'Sources: [1] a [Source 2] b' AS answer FROM partial),
    split AS (SELECT query_id, regexp_extract(answer, '^((?s).*?)(?:\\n\\s*(?:\\[Source[^\\]]*\\]:|Sources?:)|$)', 1) AS body, answer FROM full_text),
    marks AS (SELECT query_id, list_transform(regexp_extract_all(body, '\\[(?:Source\\s+)?(\\d+)\\]', 1), lambda d: d::BIGINT) AS inline, [1, 2] AS listed FROM split),
    c AS (SELECT query_id, source_number, len(list_filter(inline, lambda d: d = source_number)) AS n, list_contains(listed, source_number) AS l FROM src JOIN marks USING (query_id))
    SELECT query_id, source_number, (n + (n = 0 AND l)::INT)::BIGINT AS citation_count, n = 0 AND l AS footer_only FROM c""",
)
def per_source_citations(t):
    full = partial_answers(t).withColumn("answer", F.concat("answer", F.lit("\nSources: [1] a [Source 2] b")))
    return big(A.per_source_citations(full, sources(t)), "source_number")


@query(
    "citation_extract",
    rf"""{BASE}, {ANSWERS} SELECT query_id, array_to_string(list_sort(list_distinct(list_transform(
      regexp_extract_all(answer, '\[Source\s+(\d+)\]', 1), lambda d: d::BIGINT))), ',') AS cited FROM answers""",
)
def citation_extract(t):
    cited = F.transform(T.cited_numbers(F.col("answer")), lambda n: n.cast("string"))
    return answered(t).select("query_id", F.array_join(cited, ",").alias("cited"))


CLAIMS = (
    r"len(list_filter({s}, lambda s: length(s) >= 25 AND NOT regexp_matches(s, '\[Source\s+\d+\]|\[\d{{1,2}}\]') "
    r"AND regexp_matches(s, {number}) AND regexp_matches(s, {term})))"
)


# Openings with and without marks and claims, so that densities and counts differ.
TOLD = ["", "It holds [Source 1]. ", "The model has 12 layers in its architecture. ", "The model has 12 layers in its architecture [Source 2]. And [3] says so. "]


@query(
    "citation_density_claims",
    rf"""WITH {P.EXCHANGES}, told AS (SELECT query_id, {P.led_sql('query_id', TOLD, 'answer')} AS answer FROM exchanges) SELECT query_id,
      round(CASE WHEN len(s) > 0 THEN len(regexp_extract_all(answer, '\[Source\s+\d+\]|\[\d{{1,2}}\]')) / len(s) ELSE 0.0 END, 6) AS density,
      {CLAIMS.format(s='s', number=P.lit(V.CLAIM_NUMBER), term=P.lit(V.CLAIM_TERM))}::BIGINT AS unsupported_claims
    FROM (SELECT query_id, answer, {P.sentences("answer")} AS s FROM told)""",
)
def citation_density_claims(t):
    answer = P.led(F.col("query_id"), TOLD, F.col("answer"))
    return t.exchanges().select(
        "query_id", F.round(T.citation_density(answer), 6).alias("density"), T.unsupported_claims(answer).cast("bigint").alias("unsupported_claims")
    )


@query(
    "document_claims",
    f"""WITH {P.CHUNKS} SELECT chunk_id,
      {CLAIMS.format(s=P.sentences('text'), number=P.lit(V.CLAIM_NUMBER), term=P.lit(V.CLAIM_TERM))}::BIGINT AS unsupported_claims FROM chunks""",
)
def document_claims(t):
    return t.chunks().select("chunk_id", T.unsupported_claims(F.col("text")).cast("bigint").alias("unsupported_claims"))


@query(
    "keyword_completeness",
    f"""WITH {P.EXCHANGES}, k AS (SELECT query_id, answer, list_distinct({P.word_list("question")}) AS keys FROM exchanges),
    f AS (SELECT query_id, len(keys) AS total, len(list_filter(keys, lambda w: contains(lower(answer), w))) AS found FROM k)
    SELECT query_id, found::BIGINT AS found, total::BIGINT AS total, round(CASE WHEN total = 0 THEN 1.0 ELSE found / total END, 6) AS score FROM f""",
)
def keyword_completeness(t):
    rows = t.exchanges().select("query_id", "answer", T.word_set(F.col("question")).alias("keys"))
    found = F.size(T.terms_present(F.col("answer"), F.col("keys")))
    score = F.when(F.size("keys") == 0, 1.0).otherwise(found / F.greatest(F.size("keys"), F.lit(1)))
    return rows.select(
        "query_id", found.cast("bigint").alias("found"), F.size("keys").cast("bigint").alias("total"), F.round(score, 6).alias("score")
    )


@query(
    "exclusion_terms_found",
    f"""WITH {P.EXCHANGES}, k AS (SELECT query_id, answer, list_filter(list_distinct({P.word_list("question")}), lambda w: length(w) >= 6) AS terms FROM exchanges)
    SELECT query_id, array_to_string(list_sort(list_filter(terms, lambda w: contains(lower(answer), w))), ',') AS found FROM k""",
)
def exclusion_terms_found(t):
    terms = F.filter(T.word_set(F.col("question")), lambda w: F.length(w) >= 6)
    found = T.terms_present(F.col("answer"), F.col("terms"))
    return t.exchanges().select("query_id", "answer", terms.alias("terms")).select(
        "query_id", F.array_join(F.array_sort(found), ",").alias("found")
    )


@query(
    "judge_scores",
    r"""WITH replies AS (SELECT doc_id, CASE quality * 2 + toxic WHEN 0 THEN 'Score: ' || (doc_id % 8) || '/5 Reasoning: x' WHEN 1 THEN (doc_id % 7) || chr(10) || 'rest'
      WHEN 2 THEN '{"score": ' || (doc_id % 9) || '.5, "reasoning": "y"}' ELSE 'no verdict' END AS reply, quality * 2 + toxic AS kind FROM labels)
    SELECT doc_id, greatest(1.0, least(5.0, CASE kind WHEN 0 THEN doc_id % 8 WHEN 1 THEN doc_id % 7 WHEN 2 THEN doc_id % 9 + 0.5 ELSE 3.0 END))::DOUBLE AS score FROM replies""",
)
def judge_scores(t):
    d = lambda n: (F.col("doc_id") % n).cast("string")
    reply = (
        F.when(F.expr("quality * 2 + toxic = 0"), F.concat(F.lit("Score: "), d(8), F.lit("/5 Reasoning: x")))
        .when(F.expr("quality * 2 + toxic = 1"), F.concat(d(7), F.lit("\nrest")))
        .when(F.expr("quality * 2 + toxic = 2"), F.concat(F.lit('{"score": '), d(9), F.lit('.5, "reasoning": "y"}')))
        .otherwise("no verdict")
    )
    return t.labels.select("doc_id", T.judge_score(reply).alias("score"))


FOCUS = [
    rf"regexp_extract(lower(question), '{p}\s+([\p{{L}}\p{{N}}_]+)', 1)"
    for p in (r"what\s+(?:specific|particular|exact)", r"how\s+much", r"how\s+many")
]
SKIP = P.words(V.ALIGNMENT_SKIP)
# Questions with a focus, with one that does not count, and without; answers that meet it or not.
ASKED_FOR = ["", "What specific accuracy was reached? ", "How many layers are there? ", "How much data is it? "]
REPLIED = ["", "The accuracy is high. ", "It has a layer. "]


@query(
    "answer_alignment",
    f"""WITH {P.EXCHANGES}, led AS (SELECT query_id, {P.led_sql('query_id', ASKED_FOR, 'question')} AS question, {P.led_sql('query_id // 2', REPLIED, 'answer')} AS answer FROM exchanges),
    f AS (SELECT query_id, lower(answer) AS a, [{", ".join(FOCUS)}] AS words FROM led),
    u AS (SELECT query_id, a, list_filter(words, lambda w: w <> '' AND NOT list_contains({SKIP}, w)) AS words FROM f)
    SELECT query_id, words[1] AS focus, len(list_filter(words, lambda w: NOT contains(a, w) AND NOT contains(a, {P.stem("w")}))) > 0 AS tangential FROM u""",
)
def answer_alignment(t):
    question, answer = P.led(F.col("query_id"), ASKED_FOR, F.col("question")), P.led(F.floor(F.col("query_id") / 2), REPLIED, F.col("answer"))
    return t.exchanges().select("query_id", T.alignment_focus(question).alias("focus"), T.misses_focus(question, answer).alias("tangential"))


# -------------------------------------------------------------- faithfulness

PAIRS = "pairs AS (SELECT query_id, answer, question AS context FROM exchanges)"


def pairs(t):
    return t.exchanges().select("query_id", "answer", F.col("question").alias("context"))


@query(
    "faithfulness_heuristic",
    rf"""WITH {P.EXCHANGES}, {PAIRS},
    p AS (SELECT query_id, {P.content_words("context")} AS known, list_filter(list_transform(regexp_split_to_array(
       regexp_replace(answer, '\n\s*(?:\[Source[^\]]*\]:|Sources?:)(?s:.*)', ''), '[.!?]+'), lambda s: {P.strip("s")}), lambda s: length(s) > 15) AS sents FROM pairs),
    w AS (SELECT query_id, known, {P.content_words("s")} AS words FROM (SELECT query_id, known, unnest(sents) AS s FROM p)),
    o AS (SELECT query_id, avg(len(list_intersect(words, known)) / len(words)) AS o FROM w WHERE len(words) >= 4 AND len(known) > 0 GROUP BY query_id)
    SELECT query_id, round(coalesce(1.0 + 4.0 * o, 1.0), 6) AS faithfulness FROM pairs LEFT JOIN o USING (query_id)""",
)
def faithfulness_heuristic(t):
    return Q.faithfulness(pairs(t)).withColumn("faithfulness", F.round("faithfulness", 6))


@query(
    "judge_fallback_score",
    rf"""WITH {P.EXCHANGES}, {PAIRS},
    p AS (SELECT query_id, list_distinct({P.split_ws("lower(context)")}) AS known, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda s: {P.strip("s")}), lambda s: length(s) > 0) AS sents FROM pairs),
    w AS (SELECT query_id, known, list_distinct({P.split_ws("lower(s)")}) AS words FROM (SELECT query_id, known, unnest(sents) AS s FROM p)),
    o AS (SELECT query_id, avg(len(list_intersect(words, known)) / len(words)) AS o FROM w GROUP BY query_id)
    SELECT query_id, round(least(5.0, greatest(1.0, coalesce(1.0 + 4.0 * o, 1.0))), 6) AS score FROM pairs LEFT JOIN o USING (query_id)""",
)
def judge_fallback_score(t):
    return Q.judge_fallback(pairs(t)).withColumn("score", F.round("score", 6))


def detector_words(text):
    return f"list_filter(list_distinct({P.word_list(text)}), lambda w: NOT list_contains({P.words(V.DETECTOR_STOP)}, w))"


def flagged(limit, name):
    return f"""{name} AS (SELECT query_id, list(s ORDER BY pos) FILTER (WHERE len(words) >= 3 AND len(list_intersect(words, known)) < {limit} * len(words) AND length(context) > 0) AS spans FROM words GROUP BY query_id)"""


DETECT = f"""known AS (SELECT query_id, answer, context, {detector_words("context")} AS known, {P.sentences("answer")} AS sents FROM pairs),
words AS (SELECT query_id, context, known, s, pos, {detector_words("s")} AS words FROM (SELECT query_id, context, known, unnest(sents) AS s, generate_subscripts(sents, 1) AS pos FROM known))"""


@query(
    "hallucination_heuristic",
    f"""WITH {P.EXCHANGES}, {PAIRS}, {DETECT}, {flagged(0.20, 'f')}
    SELECT query_id, len(coalesce(spans, [])) > 0 AS has_hallucination, len(coalesce(spans, []))::BIGINT AS n_spans, coalesce(array_to_string(spans, '|'), '') AS spans
    FROM pairs LEFT JOIN f USING (query_id)""",
)
def hallucination_heuristic(t):
    out = Q.detect_unsupported(pairs(t))
    return out.select(
        "query_id",
        (F.size("spans") > 0).alias("has_hallucination"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.array_join("spans", "|").alias("spans"),
    )


@query(
    "span_f1",
    f"""WITH {P.EXCHANGES}, {PAIRS}, {DETECT}, {flagged(0.20, 'f')}, {flagged(0.05, 'g')},
    s AS (SELECT query_id, coalesce(f.spans, []) AS ps, coalesce(g.spans, []) AS gs FROM pairs LEFT JOIN f USING (query_id) LEFT JOIN g USING (query_id)),
    k AS (SELECT *, list_distinct(flatten(list_transform(ps, lambda x: {P.word_list('x')}))) AS p, list_distinct(flatten(list_transform(gs, lambda x: {P.word_list('x')}))) AS g FROM s),
    c AS (SELECT *, len(list_intersect(p, g)) AS c FROM k)
    SELECT query_id, round(CASE WHEN len(ps) = 0 AND len(gs) = 0 THEN 1.0 WHEN len(ps) = 0 OR len(gs) = 0 THEN 0.0 ELSE c / len(p) END, 6) AS span_precision,
      round(CASE WHEN len(ps) = 0 AND len(gs) = 0 THEN 1.0 WHEN len(ps) = 0 THEN 0.0 WHEN len(gs) = 0 THEN 1.0 ELSE c / len(g) END, 6) AS span_recall,
      round(CASE WHEN len(ps) = 0 AND len(gs) = 0 THEN 1.0 WHEN c > 0 THEN 2.0 * c / (len(p) + len(g)) ELSE 0.0 END, 6) AS span_f1 FROM c""",
)
def span_f1(t):
    both = Q.detect_unsupported(pairs(t), 0.20, "predicted").join(Q.detect_unsupported(pairs(t), 0.05, "gold"), "query_id")
    out = both.select("query_id", *Q.span_f1(F.col("predicted"), F.col("gold")))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("span_precision", "span_recall", "span_f1")])


@query(
    "span_offsets",
    f"""WITH {P.EXCHANGES}, {PAIRS}, {DETECT}, {flagged(0.20, 'f')},
    e AS (SELECT query_id, unnest(spans) AS span FROM f)
    SELECT query_id, span, (strpos(lower(answer), lower({P.strip('span')})) - 1)::INT AS start FROM e JOIN pairs USING (query_id)""",
)
def span_offsets(t):
    spans = Q.detect_unsupported(pairs(t)).select("query_id", F.explode("spans").alias("span"))
    return spans.join(pairs(t), "query_id").select(
        "query_id", "span", Q.span_offset(F.col("answer"), F.col("span")).cast("int").alias("start")
    )


RAF_BASE = f"{SPARSE10}, {P.RELEVANT}, passages AS (SELECT h.query_id, h.rank AS passage_no, h.chunk_id, text, r.chunk_id IS NOT NULL AS is_relevant FROM hybrid h JOIN chunks USING (chunk_id) LEFT JOIN relevant r ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id)"


def passages(t):
    hits = sparse10(t).join(t.relevant().withColumn("is_relevant", F.lit(True)), ["query_id", "chunk_id"], "left")
    small = broadcast_if_small(hits, t.questions().select("query_id"), 64)
    return t.chunks().select("chunk_id", "text").join(small, "chunk_id").select(
        "query_id", F.col("rank").alias("passage_no"), "text", F.coalesce("is_relevant", F.lit(False)).alias("is_relevant")
    )


@query(
    "raf_uraf",
    f"""{BASE}, {RAF_BASE}, {ANSWERS.replace(SPARSE10 + ', ', '')},
    tok AS (SELECT query_id, unnest(list_distinct({P.word_list('answer')})) AS token FROM answers),
    known AS (SELECT query_id, token, bool_or(is_relevant) AS rel FROM (SELECT query_id, is_relevant, unnest(list_distinct({P.word_list('text')})) AS token FROM passages) GROUP BY query_id, token),
    sh AS (SELECT query_id, count_if(rel) / count(*) AS r, count_if(NOT rel) / count(*) AS i, count(rel) / count(*) AS p FROM tok LEFT JOIN known USING (query_id, token) GROUP BY query_id),
    f AS (SELECT query_id, len(list_intersect(a, g)) AS c, len(a) + len(g) AS s FROM (SELECT query_id, list_distinct({P.word_list('answer')}) AS a, list_distinct({P.word_list('question')}) AS g FROM answers))
    SELECT query_id, round(0.7 * greatest(0.0, least(1.0, r - i)) + 0.3 * CASE WHEN c > 0 THEN 2.0 * c / s ELSE 0.0 END, 6) AS raf,
      round(0.7 * p + 0.3 * CASE WHEN c > 0 THEN 2.0 * c / s ELSE 0.0 END, 6) AS uraf, round(r, 6) AS relevant_overlap, round(i, 6) AS irrelevant_overlap, round(p, 6) AS passage_overlap
    FROM f JOIN sh USING (query_id)""",
)
def raf_uraf(t):
    answers = answered(t).withColumn("gold", F.col("question"))
    out = Q.relevance_aware_factuality(answers, passages(t))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "attribution_f1",
    f"""{BASE}, {RAF_BASE}, {ANSWERS.replace(SPARSE10 + ', ', '')},
    cited AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[(?:Source\\s+)?(\\d+)\\]', 1))::BIGINT AS passage_no FROM answers),
    st AS (SELECT query_id, count(c.passage_no) AS c, count_if(is_relevant) AS r, count_if(is_relevant AND c.passage_no IS NOT NULL) AS b
      FROM passages LEFT JOIN cited c USING (query_id, passage_no) GROUP BY query_id),
    pr AS (SELECT query_id, CASE WHEN c = 0 AND r = 0 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE b / c END AS precision, CASE WHEN r = 0 THEN 1.0 ELSE b / r END AS recall FROM st)
    SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM pr""",
)
def attribution_f1(t):
    out = Q.attribution(answered(t), passages(t))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


CONFUSION = """counts AS (SELECT count_if(g AND p) AS tp, count_if(NOT g AND p) AS fp, count_if(NOT g AND NOT p) AS tn, count_if(g AND NOT p) AS fn FROM b),
rates AS (SELECT *, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM counts)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM rates"""


def rounded_rates(df):
    return df.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "fpr", "f1")])


@query("confusion_matrix", f"WITH b AS (SELECT quality = 1 AS g, toxic = 1 AS p FROM labels), {CONFUSION}")
def confusion_matrix(t):
    return rounded_rates(E.confusion(t.labels, F.col("quality") == 1, F.col("toxic") == 1))


@query(
    "deflection_metrics",
    f"""{BASE}, {HYBRID}, {PROFILE}, {GATE}, {P.RELEVANT}, b AS (SELECT query_id NOT IN (SELECT query_id FROM relevant) AS g, reason <> '' AS p FROM gated), {CONFUSION}""",
)
def deflection_metrics(t):
    gate = routing.gate(with_meta(t, reranked(t)), t.questions())
    has = t.relevant().select("query_id", F.lit(False).alias("should")).distinct()
    both = gate.join(has, "query_id", "left").withColumn("should", F.coalesce("should", F.lit(True)))
    return rounded_rates(E.confusion(both, F.col("should"), F.col("deflect")))


@query(
    "hallucination_rate",
    f"""WITH {P.EXCHANGES}, {PAIRS}, {DETECT}, {flagged(0.20, 'f')}, {flagged(0.05, 'g')},
    s AS (SELECT len(coalesce(f.spans, [])) > 0 AS p, len(coalesce(g.spans, [])) > 0 AS g FROM pairs LEFT JOIN f USING (query_id) LEFT JOIN g USING (query_id))
    SELECT count(*) AS total, round(avg(p::INT), 6) AS predicted_rate, round(avg(g::INT), 6) AS gold_rate, count_if(p)::BIGINT AS predicted_count, count_if(g)::BIGINT AS gold_count FROM s""",
)
def hallucination_rate(t):
    both = Q.detect_unsupported(pairs(t), 0.20, "p").join(Q.detect_unsupported(pairs(t), 0.05, "g"), "query_id")
    p, g = F.size("p") > 0, F.size("g") > 0
    return both.agg(
        F.count("*").alias("total"),
        F.round(F.avg(p.cast("int")), 6).alias("predicted_rate"),
        F.round(F.avg(g.cast("int")), 6).alias("gold_rate"),
        F.count_if(p).alias("predicted_count"),
        F.count_if(g).alias("gold_count"),
    )


TYPES = """CASE WHEN contains(x, 'evident') AND contains(x, 'conflict') THEN 'Evident Conflict' WHEN contains(x, 'subtle') AND contains(x, 'conflict') THEN 'Subtle Conflict'
 WHEN contains(x, 'evident') AND contains(x, 'baseless') THEN 'Evident Baseless' WHEN contains(x, 'subtle') AND contains(x, 'baseless') THEN 'Subtle Baseless'
 WHEN contains(x, 'conflict') THEN 'Evident Conflict' WHEN contains(x, 'baseless') THEN 'Evident Baseless' ELSE 'Other' END"""


@query(
    "hallucination_by_type",
    f"""WITH spans AS (SELECT 'gold' AS side, CASE quality * 2 + toxic WHEN 0 THEN ' Evident Conflict' WHEN 1 THEN 'SUBTLE baseless info' WHEN 2 THEN 'conflict' ELSE 'odd' END AS x FROM labels
      UNION ALL SELECT 'predicted', CASE doc_id % 3 WHEN 0 THEN 'baseless' WHEN 1 THEN 'Subtle Conflict ' ELSE 'evident-baseless' END FROM labels),
    c AS (SELECT {TYPES.replace('x,', 'lower(x),')} AS span_type, count_if(side = 'gold') AS gold_count, count_if(side = 'predicted') AS predicted_count FROM spans GROUP BY 1)
    SELECT span_type, gold_count::BIGINT AS gold_count, predicted_count::BIGINT AS predicted_count, round(gold_count / (SELECT sum(gold_count) FROM c), 6) AS gold_rate FROM c""",
)
def hallucination_by_type(t):
    gold = F.expr(
        "CASE quality * 2 + toxic WHEN 0 THEN ' Evident Conflict' WHEN 1 THEN 'SUBTLE baseless info' WHEN 2 THEN 'conflict' ELSE 'odd' END"
    )
    guess = F.expr("CASE doc_id % 3 WHEN 0 THEN 'baseless' WHEN 1 THEN 'Subtle Conflict ' ELSE 'evident-baseless' END")
    spans = t.labels.select(F.lit("gold").alias("side"), gold.alias("span_type")).unionByName(
        t.labels.select(F.lit("predicted").alias("side"), guess.alias("span_type"))
    )
    return Q.spans_by_type(spans).withColumn("gold_rate", F.round("gold_rate", 6))


# ---------------------------------------------------------------- evaluation


def metrics_sql(results, k=10):
    """Metrics per query of ``results(query_id, chunk_id, rank)`` against ``relevant``."""
    return f"""hits AS (SELECT r.query_id, count_if(rank <= {k}) AS h, min(rank) AS f, sum(CASE WHEN rank <= {k} THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END) AS dcg
      FROM {results} r JOIN relevant USING (query_id, chunk_id) GROUP BY r.query_id),
    n_rel AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
    base AS (SELECT query_id, coalesce(h, 0) AS h, f, coalesce(dcg, 0.0) AS dcg, coalesce(n, 0) AS n FROM questions LEFT JOIN hits USING (query_id) LEFT JOIN n_rel USING (query_id)),
    metrics AS (SELECT query_id, h / {k} AS precision, CASE WHEN n = 0 THEN 1.0 ELSE h / n END AS recall, coalesce(1.0 / f, 0.0) AS mrr,
      CASE WHEN n = 0 THEN 1.0 ELSE dcg / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS ndcg,
      (h > 0)::INT::DOUBLE AS hit_rate, n = 0 AS should_deflect FROM base)"""


METRIC_NAMES = ["precision", "recall", "mrr", "ndcg", "hit_rate"]


def as_papers(results):
    return results.select("query_id", F.col("chunk_id").cast("string").alias("paper"), "rank")


def expected(t):
    return t.relevant().select("query_id", F.col("chunk_id").cast("string").alias("paper"))


@query(
    "retrieval_metrics",
    f"{BASE}, {HYBRID}, {P.RELEVANT}, {metrics_sql('hybrid')} SELECT query_id, "
    + ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES)
    + ", should_deflect FROM metrics",
)
def retrieval_metrics(t):
    out = E.retrieval_metrics(as_papers(reranked(t)), expected(t), t.questions(), 10)
    return out.select("query_id", *[F.round(m, 6).alias(m) for m in METRIC_NAMES], "should_deflect")


@query(
    "retrieval_metrics_acceptable",
    f"""{BASE}, {SPARSE10}, strict AS (SELECT query_id, chunk_id FROM chunks, questions WHERE contains(chunks.text, question)),
    wide_papers AS (SELECT DISTINCT query_id, paper_id FROM strict JOIN chunks USING (chunk_id)),
    relevant AS (SELECT query_id, chunk_id FROM wide_papers JOIN chunks USING (paper_id)), {metrics_sql('hybrid')},
    rec AS (SELECT query_id, count_if(rank <= 10) AS h FROM hybrid JOIN strict USING (query_id, chunk_id) GROUP BY query_id),
    tot AS (SELECT query_id, count(*) AS n FROM strict GROUP BY query_id)
    SELECT query_id, round(precision, 6) AS precision, round(coalesce(coalesce(rec.h, 0) / tot.n, 1.0), 6) AS recall, round(mrr, 6) AS mrr,
      round(ndcg, 6) AS ndcg, round(hit_rate, 6) AS hit_rate FROM metrics LEFT JOIN rec USING (query_id) LEFT JOIN tot USING (query_id)""",
)
def retrieval_metrics_acceptable(t):
    strict = t.relevant()
    places = t.chunks().select("chunk_id", "paper_id")
    wide = places.join(strict, "chunk_id").select("query_id", "paper_id").distinct().join(places, "paper_id")
    out = E.retrieval_metrics(
        as_papers(sparse10(t)), expected(t), t.questions(), 10, wide.select("query_id", F.col("chunk_id").cast("string").alias("paper"))
    )
    return out.select("query_id", *[F.round(m, 6).alias(m) for m in METRIC_NAMES])


DIFFICULTY = "CASE WHEN length(question) < 150 THEN 'easy' WHEN length(question) < 250 THEN 'medium' ELSE 'hard' END"


def graded(t):
    q = F.col("question")
    groups = t.questions().select(
        "query_id", T.query_intent(q).alias("topic"), T.query_type(q).alias("query_type"), F.expr(DIFFICULTY).alias("difficulty")
    )
    results = settle(reranked(t), "reranked")
    metrics = E.retrieval_metrics(as_papers(results), expected(t), t.questions(), 10)
    gate = routing.gate(with_meta(t, results), t.questions()).select("query_id", "deflect")
    return groups.join(metrics, "query_id").join(gate, "query_id").withColumn(
        "deflection_correct", F.col("deflect") == F.col("should_deflect")
    )


GRADED = f"""{HYBRID}, {P.RELEVANT}, {metrics_sql('hybrid')}, {PROFILE}, {GATE},
graded AS (SELECT m.*, {INTENT} AS topic, CASE WHEN {MULTI_HOP} THEN 'multi_hop' ELSE 'simple' END AS query_type, {DIFFICULTY} AS difficulty,
  (reason <> '') = should_deflect AS deflection_correct FROM metrics m JOIN questions USING (query_id) JOIN gated USING (query_id))"""


@query(
    "eval_grouping_sets",
    f"""{BASE}, {GRADED} SELECT topic, query_type, difficulty, count(*) AS total_queries, """
    + ", ".join(f"round(coalesce(avg({m}) FILTER (WHERE NOT should_deflect), 0.0), 6) AS {m}" for m in METRIC_NAMES)
    + ", round(avg(deflection_correct::INT), 6) AS deflection_accuracy FROM graded GROUP BY GROUPING SETS ((), (topic), (query_type), (difficulty))",
)
def eval_grouping_sets(t):
    out = E.grouped_means(graded(t), ["topic", "query_type", "difficulty"], METRIC_NAMES)
    return out.select(
        "topic", "query_type", "difficulty", "total_queries", *[F.round(m, 6).alias(m) for m in [*METRIC_NAMES, "deflection_accuracy"]]
    )


@query(
    "accuracy_by_difficulty",
    f"""{BASE}, {GRADED} SELECT coalesce(difficulty, 'all') AS difficulty, count(*) AS n, round(100.0 * avg(deflection_correct::INT), 6) AS accuracy
    FROM graded GROUP BY GROUPING SETS ((), (difficulty))""",
)
def accuracy_by_difficulty(t):
    out = graded(t).rollup("difficulty").agg(
        F.count("*").alias("n"), F.round(100.0 * F.avg(F.col("deflection_correct").cast("double")), 6).alias("accuracy")
    )
    return out.withColumn("difficulty", F.coalesce("difficulty", F.lit("all")))


CITE = f"""{ANSWERS}, {P.RELEVANT},
cited AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[Source\\s+(\\d+)\\]', 1))::BIGINT AS source_number FROM answers),
right_ones AS (SELECT c.query_id, count(*) AS n_right FROM cited c JOIN src USING (query_id, source_number) JOIN relevant USING (query_id, chunk_id) GROUP BY c.query_id),
tallies AS (SELECT query_id, answer, (SELECT count(*) FROM cited c WHERE c.query_id = a.query_id) AS n_cited, coalesce(n_right, 0) AS n_right,
  (SELECT count(*) FROM relevant r WHERE r.query_id = a.query_id) AS n_truth, (SELECT count(*) FROM src s WHERE s.query_id = a.query_id) AS n_sources,
  {P.sentences("answer")} AS sents FROM answers a LEFT JOIN right_ones USING (query_id)),
cite AS (SELECT query_id, n_cited AS citations, CASE WHEN n_cited = 0 THEN 0.0 ELSE n_right / n_cited END AS precision, CASE WHEN n_truth = 0 THEN 1.0 ELSE n_right / n_truth END AS recall,
  CASE WHEN n_sources = 0 THEN 0.0 ELSE n_cited / n_sources END AS coverage,
  CASE WHEN len(sents) > 0 THEN len(regexp_extract_all(answer, '\\[Source\\s+\\d+\\]|\\[\\d{{1,2}}\\]')) / len(sents) ELSE 0.0 END AS density,
  {CLAIMS.format(s='sents', number=P.lit(V.CLAIM_NUMBER), term=P.lit(V.CLAIM_TERM))}::BIGINT AS unsupported_claims, n_truth FROM tallies)"""


def cited_metrics(t):
    src = sources(t)
    named = src.select("query_id", "source_number", F.col("chunk_id").cast("string").alias("paper"))
    return E.citation_metrics(answered(t, src), named, expected(t))


@query(
    "citation_metrics",
    f"{BASE}, {CITE} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage, round(density, 6) AS density, unsupported_claims, citations FROM cite",
)
def citation_metrics(t):
    out = cited_metrics(t)
    return out.select(
        "query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "coverage", "density")], "unsupported_claims", "citations"
    )


DIAG = f"""{CITE}, found AS (SELECT query_id, count(*) AS n_found FROM hybrid JOIN relevant USING (query_id, chunk_id) GROUP BY query_id),
classed AS (SELECT query_id, citations, CASE WHEN n_truth > f AND f = 0 THEN 'retrieval_miss' WHEN recall = 0 AND f > 0 THEN 'not_cited' WHEN precision = 1 AND recall = 1 THEN 'correct'
  WHEN recall > 0 AND precision < 1 THEN 'over_citation' WHEN recall = 0 AND NOT n_truth > f THEN 'wrong_source_num' WHEN recall = 0 THEN 'not_cited' ELSE 'over_citation' END AS class
  FROM (SELECT *, coalesce(n_found, 0) AS f FROM cite LEFT JOIN found USING (query_id)) WHERE n_truth > 0)"""


def diagnosed(t):
    truth = expected(t).groupBy("query_id").agg(F.count("*").alias("n_truth"))
    found = as_papers(sparse10(t)).join(expected(t), ["query_id", "paper"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_found"))
    rows = cited_metrics(t).join(truth, "query_id").join(found, "query_id", "left").fillna(0, ["n_found"])
    kind = E.diagnosis_class(F.col("n_truth"), F.col("n_found"), F.col("precision"), F.col("recall"))
    return rows.withColumn("class", kind)


@query("diagnose_citations", f"{BASE}, {DIAG} SELECT class, count(*) AS n FROM classed GROUP BY class")
def diagnose_citations(t):
    return diagnosed(t).groupBy("class").agg(F.count("*").alias("n"))


@query("citations_per_answer", f"{BASE}, {CITE} SELECT citations, count(*) AS answers FROM cite GROUP BY citations")
def citations_per_answer(t):
    return cited_metrics(t).groupBy("citations").agg(F.count("*").alias("answers"))


@query(
    "position_citation_rate",
    f"""{BASE}, {CITE}, pos AS (SELECT r.query_id, r.chunk_id, h.rank, s.source_number FROM relevant r LEFT JOIN hybrid h USING (query_id, chunk_id) LEFT JOIN src s USING (query_id, chunk_id))
    SELECT coalesce(rank, 0)::BIGINT AS position, count(*) AS total, count(c.source_number) AS cited FROM pos LEFT JOIN cited c USING (query_id, source_number) GROUP BY 1""",
)
def position_citation_rate(t):
    src = sources(t)
    cited = answered(t, src).select("query_id", F.explode(T.cited_numbers(F.col("answer"))).alias("source_number"))
    named = cited.join(src.select("query_id", "chunk_id", F.col("source_number").cast("bigint")), ["query_id", "source_number"])
    rows = (
        t.relevant()
        .join(sparse10(t).select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
        .join(named.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    )
    return rows.groupBy(F.coalesce("rank", F.lit(0)).cast("bigint").alias("position")).agg(
        F.count("*").alias("total"), F.count("hit").alias("cited")
    )


@query(
    "source_number_histogram",
    f"{BASE}, {CITE} SELECT source_number, count(*) AS times_cited FROM cited GROUP BY source_number",
)
def source_number_histogram(t):
    cited = answered(t).select(F.explode(T.cited_numbers(F.col("answer"))).alias("source_number"))
    return cited.groupBy("source_number").agg(F.count("*").alias("times_cited"))
