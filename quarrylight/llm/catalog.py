"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import (
    decontaminate,
    fingerprints,
    jaccard_join,
    line_dedup,
    link_trust,
    lm_scoring,
    mixing,
    quality,
    secrets,
    substring_dedup,
    token_counts,
    turn_repair,
    whitening,
)
from quarrylight.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_lattice_scores")
def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), fold("doc_id", 7) == 2)
    return scored.withColumnRenamed("_id", "doc_id")


@query("op2_passage_attention")
def passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    scored = quality.score(docs, model).withColumnRenamed("_id", "doc_id")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op3_similar_classes")
def similar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(documents(spark, sf_dir)).select(F.col("_id").alias("doc_id"), "class_id", "n_links")


@query("op4_token_counts")
def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("_id", "doc_id")


@query("op5_bottom_k")
def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir)).withColumnRenamed("_id", "doc_id")


@query("op6_hamming_windows")
def leaked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.transform("hits", lambda hit: hit["item_id"])
    return found.select(
        F.col("_id").alias("doc_id"),
        (F.size("hits") > 0).alias("leaked"),
        F.size("hits").alias("n_items"),
        items.alias("item_ids"),
        F.round(F.array_max(F.transform("hits", lambda hit: hit["similarity"])), 6).alias("best"),
    )


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
spread AS (
  SELECT trim(line) AS line, min(doc_id) AS first FROM lines WHERE trim(line) <> '' GROUP BY 1
  HAVING count(DISTINCT site) >= (SELECT least(10, greatest(2, ceil(count(DISTINCT coalesce(source, '')) * 2 / 5))) FROM documents)),
placed AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
marked AS (
  SELECT p.*, coalesce(p.doc_id > s.first, false) AS gone FROM placed p LEFT JOIN spread s ON trim(p.line) = s.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_site_spread_lines", LINES_SQL)
def deduped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir))
    return kept.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_sorted_suffixes")
def deduped_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_substrings(documents(spark, sf_dir))
    return cut.select(
        F.col("_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_secret_spans")
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    return found.select(F.col("_id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
capped AS (
  SELECT *, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap FROM weighed),
ordered AS (
  SELECT *, sum(cap) OVER o - cap AS before, sum(w) OVER () - sum(w) OVER o + w AS open, row_number() OVER o AS rank,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM capped WINDOW o AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
units AS (SELECT *, (total - before) / open AS unit FROM ordered),
chosen AS (SELECT arg_min(unit, rank) AS unit FROM units WHERE unit <= cap / w),
targets AS (
  SELECT u.source, u.source_size, coalesce(least(u.cap, c.unit * u.w), u.cap) AS target FROM units u CROSS JOIN chosen c)
SELECT s.doc_id, s.size, t.source_size, t.target,
       CAST(s.size * (floor(r.rate) + CASE WHEN s.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source,
     LATERAL (SELECT CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate) r
"""


@query("op9_mixed_sources", MIX_SQL)
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(documents(spark, sf_dir))
    return planned.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op11_jacobi_davidson")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("_id", "vec_id")


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@query("op12_link_trust")
def judged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


@query("op13_auction_repair")
def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
