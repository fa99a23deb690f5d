"""Equation lines in answers: every document whole, with lines behind it that bring about each case."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.registry import query
from quarrylight.functions import gatetext as G

LINES = [
    "Attention(Q, K) = softmax($q_%$)V [Source 3]",
    "  x_% = $a$ + 1 [Source 1][Source %]  ",
    "the value of $x$ is = to % and that is all of it",
    "# heading y = $x_%$",
    "- item y = $x_%$",
    "$$ y = x_% $$",
    "no math = %",
    "$x_%$ without equality",
    "argmax_% = sigmoid($b_%$) * gelu(c)",
]
INLINE = r"(^|[^$])\$((?:[^$\\]|\\.)+?)\$([^$]|$)"
UPRIGHT = "body"
for _name in G.UPRIGHT:
    UPRIGHT = f"regexp_replace({UPRIGHT}, '{_name}([^}}]|$)', '\\\\text{{{_name}}}\\1', 'g')"


@query(
    "promoted_equations",
    f"""WITH told AS (SELECT doc_id, coalesce(text, '') || list_reduce(list_prepend('', {P.words(LINES)}), lambda a, l: a || chr(10) || replace(l, '%', doc_id::VARCHAR)) AS text FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM told),
    bare AS (SELECT *, {P.strip('raw')} AS line FROM lines),
    judged AS (SELECT *, regexp_extract_all(regexp_replace(line, {P.lit(G.SOURCE_REF)}, '', 'g'), '[a-zA-Z]+') AS w, array_to_string(regexp_extract_all(line, {P.lit(G.SOURCE_REF)}), ' ') AS refs,
      regexp_replace({P.strip(f"regexp_replace(line, {P.lit(chr(92) + 's*' + G.SOURCE_REF)}, '', 'g')")}, {P.lit(INLINE)}, '\\1\\2\\3', 'g') AS body FROM bare),
    marked AS (SELECT *, contains(line, '=') AND regexp_matches(line, {P.lit(INLINE)}) AND length(line) <= {G.LONGEST_EQUATION} AND NOT regexp_matches(line, '^([$][$]|#|- |[*] )') AND len(w) > 0
      AND len(list_filter(w, lambda x: list_contains({P.words(G.PROSE_WORDS)}, lower(x)))) / greatest(len(w), 1) <= {G.PROSE_SHARE} AS promoted FROM judged)
    SELECT doc_id, count_if(promoted)::BIGINT AS n_promoted, md5(string_agg(CASE WHEN promoted THEN '$$' || {UPRIGHT} || '$$' || CASE WHEN refs <> '' THEN ' ' || refs ELSE '' END ELSE raw END, chr(10) ORDER BY nth)) AS digest
    FROM marked GROUP BY doc_id""",
)
def promoted_equations(t):
    extra = [F.replace(F.lit(line), F.lit("%"), F.col("doc_id").cast("string")) for line in LINES]
    texts = t.documents.select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), *extra).alias("text"))
    promoted = F.size(F.filter(F.split("text", "\n", -1), lambda raw: G.is_equation(G.strip(raw)))).cast("bigint")
    return texts.select("doc_id", promoted.alias("n_promoted"), F.md5(G.promote_equations(F.col("text"))).alias("digest"))
