"""The recursive splitter over whole documents, stated in SQL as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.registry import query
from quarrylight.functions import vocab as V
from quarrylight.functions.splitting import EQUATIONS
from quarrylight.operators import packing

SIZE, OVERLAP = 400, 60
EQUATION = "|".join(EQUATIONS)
#: ``plain(id, body)`` becomes ``texts(id, body)`` with a short token for every display equation; ``whole(chunk)`` puts them back.
HIDDEN = f"""found AS (SELECT id, body AS raw, regexp_extract_all(body, {P.lit(EQUATION)}, 0, 's') AS eqs FROM plain),
    texts AS (SELECT id, array_to_string(list_transform(regexp_split_to_array(raw, {P.lit(EQUATION)}, 's'), lambda p, k: CASE WHEN k <= len(eqs) THEN p || format('__EQ_{{:04d}}__', k - 1) ELSE p END), '') AS body FROM found)"""
WHOLE = "list_reduce(list_prepend(chunk, list_distinct(regexp_extract_all(chunk, '__EQ_(\\d{4,})__', 1))), lambda c, t: replace(c, '__EQ_' || t || '__', eqs[t::INT + 1]))"
WHITE = r"^[\s\x1C-\x1F\p{Z}\x{85}]+|[\s\x1C-\x1F\p{Z}\x{85}]+$"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if text.isprintable() else " || ".join(f"chr({ord(c)})" for c in text)


def stripped(text: str) -> str:
    return f"regexp_replace({text}, {P.lit(WHITE)}, '', 'g')"


def level_sql(state: str, level: int, separator: str, size: int, overlap: int) -> str:
    """One separator: long pieces that hold it become their parts."""
    parent = f"'{level}:' || i"
    if separator:
        sep = f"({literal(separator)})"
        parts = f"list_filter(list_transform(string_split(x.body, {sep}), lambda p, k: CASE WHEN k = 1 THEN p ELSE {sep} || p END), lambda p: length(p) > 0)"
        made = f"list_transform({parts}, lambda p: {{'body': p, 'parent': {parent}, 'kind': CASE WHEN length(p) <= {size} THEN 1 ELSE 0 END}})"
        here = f"x.kind = 0 AND contains(x.body, {sep})"
    else:
        step = size - overlap
        runs = f"list_transform(range(0, greatest(ceil((length(x.body) - {size}) / {step})::BIGINT, 0) + 1), lambda k: {stripped(f'substr(x.body, k * {step} + 1, {size})')})"
        made = f"list_transform(list_filter({runs}, lambda p: length(p) > 0), lambda p: {{'body': p, 'parent': {parent}, 'kind': 2}})"
        here = "x.kind = 0"
    return f"flatten(list_transform({state}, lambda x, i: CASE WHEN {here} THEN {made} ELSE [x] END))"


def chunks_sql(texts: str, size: int, overlap: int, separators: list[str]) -> str:
    """CTEs that end in ``chunks(id, ord, chunk)`` from ``texts(id, body)``."""
    levels, before = [], "[{'body': body, 'parent': '', 'kind': 0}]"
    for level, separator in enumerate(separators):
        levels.append(f"s{level} AS (SELECT id, {level_sql(before, level, separator, size, overlap)} AS s FROM {texts if level == 0 else f's{level - 1}'})")
        before = "s"
    return f"""{', '.join(levels)},
    atoms AS (SELECT id, unnest(range(0, len(s))) AS pos, unnest(s) AS a FROM s{len(separators) - 1}),
    split AS (SELECT id, pos, a.body AS body, a.kind AS kind, coalesce(a.kind = 2 OR lag(a.kind) OVER w = 2 OR lag(a.parent) OVER w <> a.parent, true) AS apart FROM atoms WINDOW w AS (PARTITION BY id ORDER BY pos)),
    runs AS (SELECT *, sum(apart::INT) OVER (PARTITION BY id ORDER BY pos) AS run FROM split),
    ends AS (SELECT *, row_number() OVER w - 1 AS idx, (sum(length(body)) OVER w)::BIGINT AS e, count(*) OVER (PARTITION BY id, run) AS n, (sum(length(body)) OVER (PARTITION BY id, run))::BIGINT AS total FROM runs
      WINDOW w AS (PARTITION BY id, run ORDER BY pos)),
    begun AS (SELECT *, e - length(body) AS b FROM ends),
    nexts AS (SELECT id, run, idx, body, kind, pos, n,
      CASE WHEN total <= b + {size} THEN n ELSE max(idx) OVER (PARTITION BY id, run ORDER BY b RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) END AS until,
      greatest(min(idx) OVER (PARTITION BY id, run ORDER BY b RANGE BETWEEN {overlap} PRECEDING AND CURRENT ROW),
        CASE WHEN e <= {size} THEN 0 ELSE min(idx) OVER (PARTITION BY id, run ORDER BY e RANGE BETWEEN {size} PRECEDING AND CURRENT ROW) + 1 END) AS start FROM begun),
    cuts(id, run, a, b) AS (SELECT id, run, 0::BIGINT, until FROM nexts WHERE idx = 0 AND kind < 2
      UNION ALL SELECT c.id, c.run, f.start, g.until FROM cuts c JOIN nexts f ON f.id = c.id AND f.run = c.run AND f.idx = c.b JOIN nexts g ON g.id = c.id AND g.run = c.run AND g.idx = f.start),
    packed AS (SELECT c.id, c.run, c.b, {stripped("string_agg(body, '' ORDER BY idx)")} AS chunk FROM cuts c JOIN nexts p ON p.id = c.id AND p.run = c.run AND p.idx >= c.a AND p.idx < c.b GROUP BY c.id, c.run, c.a, c.b),
    every AS (SELECT id, run, b, chunk FROM packed WHERE length(chunk) > 0 UNION ALL SELECT id, run, 0, body FROM nexts WHERE kind = 2),
    chunks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY run, b) - 1 AS ord, chunk FROM every)"""


@query(
    "chunk_pieces",
    f"""WITH RECURSIVE texts AS (SELECT doc_id AS id, coalesce(text, '') AS body FROM documents), {chunks_sql('texts', SIZE, OVERLAP, V.CHUNK_SEPARATORS)}
    SELECT id AS doc_id, ord, length(chunk) AS n_chars, md5(chunk) AS chunk FROM chunks""",
)
def chunk_pieces(t):
    """Every document cut and packed, its chunks by digest."""
    out = packing.recursive_chunks(t.documents.select("doc_id", "text"), "text", SIZE, OVERLAP, whole_equations=False)
    return out.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("chunk"))
