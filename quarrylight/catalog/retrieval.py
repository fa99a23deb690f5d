"""Sparse, dense, fused and reranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog import parts as P
from quarrylight.catalog.registry import query
from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators import dense, fusion, sparse
from quarrylight.plans import hybrid

BASE = f"WITH {P.CHUNKS}, {P.QUESTIONS}"

FUSED = f"""{P.INDEX}, {P.BM25}, {P.HASHED},
{P.top("sparse_top", "bm25", V.FIRST_STAGE_K, where="score > 0")},
{P.top("dense_top", "dense", V.FIRST_STAGE_K)},
fused AS (SELECT query_id, chunk_id,
    round(coalesce({V.SPARSE_WEIGHT} / ({V.RRF_K} + s.rank), 0.0) + coalesce({V.DENSE_WEIGHT} / ({V.RRF_K} + d.rank), 0.0), 10) AS score,
    coalesce(s.score, 0.0) AS sparse_score, coalesce(d.score, 0.0) AS dense_score,
    concat_ws(',', CASE WHEN s.rank IS NOT NULL THEN 'bm25' END, CASE WHEN d.rank IS NOT NULL THEN 'dense' END) AS sources
    FROM sparse_top s FULL OUTER JOIN dense_top d USING (query_id, chunk_id))"""


def rerank_sql(source: str, prior: str = "0.0") -> str:
    """Rerank rows of ``source(query_id, chunk_id, question, text)``."""
    grams = " + ".join(
        f"0.1 * {n} * len(list_filter(range(1, len(w) - {n - 2}), "
        f"lambda i: contains(low, array_to_string(w[i:i + {n - 1}], ' '))))"
        for n in (3, 2)
    )
    return f"""SELECT * EXCLUDE (q, c, w, low),
      round({prior} * 0.4 + len(list_intersect(q, c)) / greatest(len(q), 1) * 0.4 + ({grams}) * 0.2, 8) AS score
    FROM (SELECT *, {P.ascii_words("question")} AS q, {P.ascii_words("text")} AS c,
      {P.split_ws("lower(question)")} AS w, lower(text) AS low FROM {source})"""


HYBRID = f"""{FUSED},
{P.top("pool", "fused", V.RERANK_POOL)},
cand AS (SELECT query_id, chunk_id, question, text FROM pool JOIN chunks USING (chunk_id) JOIN questions USING (query_id)),
reranked AS ({rerank_sql("cand")}),
{P.top("hybrid", "reranked", V.TOP_K)}"""


@query(
    "bm25_index_terms",
    f"WITH {P.CHUNKS}, {P.INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
)
def bm25_index_terms(t):
    index = sparse.build_index(t.chunks())
    return index.terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "bm25_index_postings",
    f"WITH {P.CHUNKS}, {P.INDEX} SELECT chunk_id, term, tf, dl::BIGINT AS dl FROM postings JOIN lengths USING (chunk_id)",
)
def bm25_index_postings(t):
    index = sparse.build_index(t.chunks())
    return index.postings().select("chunk_id", "term", "tf", F.col("dl").cast("bigint").alias("dl"))


@query(
    "bm25_index_corpus",
    f"WITH {P.CHUNKS}, {P.INDEX} SELECT n_docs, round(avgdl, 6) AS avgdl FROM corpus",
)
def bm25_index_corpus(t):
    return sparse.build_index(t.chunks()).corpus().select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(
    "bm25_search_topk",
    f"{BASE}, {P.INDEX}, {P.BM25}, {P.top('best', 'bm25', 10, where='score > 0')} "
    "SELECT query_id, chunk_id, score, rank FROM best",
)
def bm25_search_topk(t):
    hits = sparse.bm25_search(t.questions(), sparse.build_index(t.chunks()), 10)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "dense_hashed_topk",
    f"{BASE}, {P.HASHED}, {P.top('best', 'dense', 10)} SELECT query_id, chunk_id, score, rank FROM best",
)
def dense_hashed_topk(t):
    hits = dense.hashed_search(t.questions(), t.chunks(), 10)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "rrf_fusion",
    f"{BASE}, {FUSED}, {P.top('best', 'fused', 50)} SELECT query_id, chunk_id, score, "
    "sparse_score, dense_score, sources, rank FROM best",
)
def rrf_fusion(t):
    fused = hybrid.first_stage(t.questions(), t.chunks())
    best = fusion.top_k(fused, 50)
    return best.select(
        "query_id",
        "chunk_id",
        "score",
        "sparse_score",
        "dense_score",
        F.array_join("sources", ",").alias("sources"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(
    "hybrid_retrieval",
    f"{BASE}, {HYBRID} SELECT query_id, chunk_id, score, rank FROM hybrid",
)
def hybrid_retrieval(t):
    best = hybrid.hybrid_search(t.questions(), t.chunks())
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("verbatim_relevance", f"{BASE}, {P.RELEVANT} SELECT query_id, chunk_id FROM relevant")
def verbatim_relevance(t):
    return t.relevant()


# ------------------------------------------------------------------ vectors

VEC = """v AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, label FROM embeddings),
cent AS (SELECT label AS query_id, list(m ORDER BY pos) AS vector FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM v)
  GROUP BY label, pos) GROUP BY label),
sims AS (SELECT query_id, chunk_id, label, round(list_cosine_similarity(cent.vector, v.vector), 8) AS score FROM cent, v)"""


def _centroids(t):
    return dense.centroids(t.embeddings, "label", "embedding").select(
        F.col("label").cast("bigint").alias("query_id"), "vector", F.col("label").alias("group")
    )


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("group"))


@query(
    "knn_topk",
    f"WITH {VEC}, {P.top('best', 'sims', 10)} SELECT query_id::BIGINT AS query_id, chunk_id, score, rank FROM best",
)
def knn_topk(t):
    return dense.knn(_centroids(t), _vectors(t), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "knn_filtered",
    f"WITH {VEC}, {P.top('best', 'sims', 10, where='label = query_id')} "
    "SELECT query_id::BIGINT AS query_id, chunk_id, score, rank FROM best",
)
def knn_filtered(t):
    return dense.knn(_centroids(t), _vectors(t), 10, same_group=True).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "embedding_centroids",
    f"WITH {VEC} SELECT query_id AS label, unnest(range(1, len(vector) + 1))::INT AS pos, "
    "round(unnest(vector), 8) AS x FROM cent",
)
def embedding_centroids(t):
    cent = dense.centroids(t.embeddings, "label", "embedding")
    return cent.select("label", F.posexplode("vector").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).alias("pos"), F.round("x", 8).alias("x")
    )


@query(
    "embedding_centroid_cosine",
    f"WITH {VEC} SELECT v.chunk_id, v.label, round(list_cosine_similarity(cent.vector, v.vector), 8) AS score "
    "FROM v JOIN cent ON cent.query_id = v.label",
)
def embedding_centroid_cosine(t):
    cent = dense.centroids(t.embeddings, "label", "embedding").withColumnRenamed("vector", "mean")
    return t.embeddings.join(cent, "label").select(
        F.col("vec_id").alias("chunk_id"), "label", F.round(dense.cosine(F.col("embedding"), F.col("mean")), 8).alias("score")
    )


@query(
    "hashed_tf_vectors",
    f"WITH {P.CHUNKS}, {P.QUESTIONS}, {P.HASHED} SELECT chunk_id, b AS bucket, round(w / norm, 8) AS weight "
    "FROM doc_bucket JOIN doc_norm USING (chunk_id)",
)
def hashed_tf_vectors(t):
    return dense.hashed_vector(t.chunks(), "chunk_id", "text").select("chunk_id", "bucket", F.round("weight", 8).alias("weight"))


# -------------------------------------------------- paper-level dense search


@query(
    "abstract_search_papers",
    f"""{BASE}, {P.HASHED},
    best_chunk AS (SELECT query_id, paper_id, max(dense.score) AS score FROM dense JOIN chunks USING (chunk_id)
      WHERE section = 'en' GROUP BY query_id, paper_id),
    {P.top('best', 'best_chunk', 3, key='paper_id')}
    SELECT query_id, paper_id, score, rank FROM best""",
)
def abstract_search_papers(t):
    return hybrid.abstract_search(t.questions(), t.chunks(), "en", 3).withColumn("rank", F.col("rank").cast("bigint"))


# ------------------------------------------------------------------ titles

TITLES = r"""papers AS (SELECT page_id AS paper_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
n_papers AS (SELECT greatest(count(*), 1) AS n FROM papers)"""


def _titles(t):
    return t.pages.select(
        F.col("page_id").alias("paper_id"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title")
    )


@query(
    "title_index_match",
    f"""WITH {P.QUESTIONS}, {TITLES},
    words AS (SELECT paper_id, term FROM (SELECT paper_id, unnest({P.ascii_words("title")}) AS term FROM papers) WHERE length(term) >= 2),
    asked AS (SELECT query_id, term FROM (SELECT query_id, unnest({P.ascii_words("question")}) AS term FROM questions)
      WHERE NOT list_contains({P.words(V.TITLE_STOP)}, term)),
    w AS (SELECT term, ln(n / c) AS weight FROM (SELECT term, count(*) AS c FROM words GROUP BY term), n_papers WHERE c <= n * 0.5),
    sums AS (SELECT query_id, paper_id, round(sum(weight), 8) AS score FROM asked JOIN w USING (term) JOIN words USING (term)
      GROUP BY query_id, paper_id),
    {P.top('best', 'sums', 9, key='paper_id')}
    SELECT query_id, paper_id, score, rank FROM best, n_papers WHERE rank <= 3 AND score >= ln(n / 200.0)""",
)
def title_index_match(t):
    return sparse.title_matches(t.questions(), _titles(t)).select(
        "query_id", "paper_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


# ---------------------------------------------------------- injection, cuts


INJECTED = f"""{FUSED},
{P.top("pool", "fused", 20)},
inj AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS inject_rank
  FROM (SELECT q.query_id, c.chunk_id, d.score FROM questions q JOIN dense d USING (query_id) JOIN chunks c USING (chunk_id)
        JOIN labels l ON l.doc_id = c.chunk_id WHERE l.quality = 1)),
inj_top AS (SELECT * FROM inj WHERE inject_rank <= 10),
sizes AS (SELECT query_id, count(*) AS pool_size FROM pool GROUP BY query_id),
fresh AS (SELECT i.query_id, i.chunk_id, row_number() OVER (PARTITION BY i.query_id ORDER BY inject_rank, i.chunk_id) AS nth
  FROM inj_top i WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = i.query_id AND p.chunk_id = i.chunk_id)),
new AS (SELECT * FROM fresh JOIN sizes USING (query_id) WHERE nth <= floor(pool_size / 4)),
n_new AS (SELECT query_id, count(*) AS n_new FROM new GROUP BY query_id),
mixed AS (
  SELECT p.query_id, p.chunk_id, p.rank, FALSE AS injected FROM pool p JOIN sizes USING (query_id) LEFT JOIN n_new USING (query_id)
  WHERE p.rank <= pool_size - coalesce(n_new, 0)
  UNION ALL
  SELECT query_id, chunk_id, pool_size - n_new + nth, TRUE FROM new JOIN n_new USING (query_id))"""


def _injections(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    trusted = t.chunks().join(good, "chunk_id", "left_semi")
    hits = dense.hashed_search(t.questions(), trusted, 10)
    return hits.select("query_id", "chunk_id", F.col("rank").alias("inject_rank"))


@query("inject_pool", f"{BASE}, {INJECTED} SELECT query_id, chunk_id, rank, injected FROM mixed")
def inject_pool(t):
    pool = fusion.top_k(hybrid.first_stage(t.questions(), t.chunks()), 20)
    return fusion.inject(pool, _injections(t))


@query(
    "inject_and_readd",
    f"""{BASE}, {INJECTED},
    cand AS (SELECT query_id, chunk_id, injected, question, text FROM mixed JOIN chunks USING (chunk_id) JOIN questions USING (query_id)),
    reranked AS ({rerank_sql("cand")}),
    {P.top("best", "reranked", 5)},
    last AS (SELECT query_id, max(rank) AS last FROM best GROUP BY query_id),
    missed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS nth FROM reranked r
      WHERE injected AND NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = r.query_id AND b.chunk_id = r.chunk_id))
    SELECT query_id, chunk_id, score, injected, rank::BIGINT AS rank FROM best
    UNION ALL SELECT query_id, chunk_id, score, injected, last + nth FROM missed JOIN last USING (query_id)""",
)
def inject_and_readd(t):
    out = hybrid.hybrid_search(t.questions(), t.chunks(), k=5, pool=20, injections=_injections(t))
    return out.select("query_id", "chunk_id", "score", "injected", F.col("rank").cast("bigint").alias("rank"))


@query(
    "relevance_threshold",
    f"{BASE}, {HYBRID} SELECT query_id, chunk_id, score, rank FROM hybrid WHERE score >= 0.3",
)
def relevance_threshold(t):
    out = hybrid.hybrid_search(t.questions(), t.chunks(), threshold=0.3)
    return out.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


SOURCE_FILTER = """
tops AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 2 THEN score END) AS second
  FROM hybrid GROUP BY query_id),
ratios AS (SELECT *, CASE WHEN top > 2.0 THEN CASE WHEN top > 3.0 AND dominant THEN 0.7 ELSE 0.35 END
    WHEN top > 0.05 THEN CASE WHEN top > 0.7 AND dominant THEN 0.8 ELSE 0.5 END END AS ratio
  FROM (SELECT *, second IS NULL OR second <= 0 OR top >= 1.8 * second AS dominant FROM tops)),
marked AS (SELECT h.*, ratio, coalesce(score >= top * ratio, rank = 1) AS ok FROM hybrid h JOIN ratios USING (query_id)),
five AS (SELECT * EXCLUDE (ok), ok AND count(*) FILTER (WHERE ok) OVER (PARTITION BY query_id ORDER BY rank) <= 5 AS ok FROM marked),
filled AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY query_id)
   + count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY query_id ORDER BY rank) AS reach FROM five),
picked AS (SELECT query_id, chunk_id, score, rank,
   row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, rank) AS source_number
   FROM filled WHERE ok OR (ratio IS NOT NULL AND reach <= 3))"""


@query(
    "filter_relevant_sources",
    f"{BASE}, {HYBRID}, {SOURCE_FILTER} SELECT query_id, chunk_id, score, source_number FROM picked",
)
def filter_relevant_sources(t):
    best = hybrid.hybrid_search(t.questions(), t.chunks())
    out = fusion.filter_sources(best)
    return out.select("query_id", "chunk_id", "score", F.col("source_number").cast("bigint").alias("source_number"))


@query(
    "query_with_citations",
    f"""{BASE}, {HYBRID} SELECT query_id, rank, format('[Source {{}}] {{}} — {{}}', rank, paper_id, section) AS citation,
    max(hybrid.score) OVER (PARTITION BY query_id) >= 0.3 AS is_relevant FROM hybrid JOIN chunks USING (chunk_id)""",
)
def query_with_citations(t):
    return hybrid.search_with_citations(t.questions(), t.chunks()).withColumn("rank", F.col("rank").cast("bigint"))
