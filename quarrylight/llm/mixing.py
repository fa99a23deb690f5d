"""Mixing sources to target weights: repetition rates from token totals, then hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import WORD, whole_text
from quarrylight.session import settle

#: A table of sources with at most this many rows is small enough to send to every executor.
BROADCAST_SOURCES = 100_000


def word_count(text_col: str) -> Column:
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``_source, source_size, target, rate`` from rows ``_source, _size``.

    Sources in code point order (null last) take the weights in turn and share ``share`` times all
    tokens. A target stops at ``limit`` times its source's size and what is over is shared again by
    weight until no target is above: with the sources ordered by limit over weight, a prefix is
    capped and the rest get one common amount per unit of weight. Only one row per source is
    ordered here; the documents are summed before. A source without tokens has target and rate 0.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    given = F.array(*(F.lit(int(w)) for w in weights))
    rows = totals.withColumn("_place", F.row_number().over(by_name)).select(
        "_source",
        "source_size",
        "_place",
        F.element_at(given, F.col("_place") % F.lit(len(weights)) + F.when(F.col("_place") % len(weights) == 0, len(weights)).otherwise(0)).alias("_weight"),
        (F.lit(limit) * F.col("source_size")).alias("_cap"),
    )
    ordered = Window.orderBy(F.col("_cap") / F.col("_weight"), "_place")
    everything = Window.partitionBy(F.lit(0))
    rows = rows.select(
        "*",
        (F.sum("_cap").over(ordered) - F.col("_cap")).alias("_capped"),
        (F.sum("_weight").over(everything) - F.sum("_weight").over(ordered) + F.col("_weight")).alias("_open"),
        F.row_number().over(ordered).alias("_rank"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("_total"),
    ).withColumn("_unit", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    fits = F.when(F.col("_unit") <= F.col("_cap") / F.col("_weight"), F.struct("_rank", "_unit"))
    unit = F.min(fits).over(everything)["_unit"]
    target = F.coalesce(F.least(F.col("_cap"), unit * F.col("_weight")), F.col("_cap"))
    rows = rows.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.select("_source", "source_size", "target", rate.alias("rate"))


def draw(id_col: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **targets) -> DataFrame:
    """Each document's row with its number of copies.

    Returns ``_row`` (the row as it came, whatever its columns are called) and ``size, source_size,
    target, rate, copies``. A document gets floor(rate) copies plus one more when its seeded draw is
    below the fraction, so reruns agree and rows that repeat a key share its draw. Null texts and
    texts without words have size 0; a null source is a source; an empty table gives no rows.
    """
    sized = docs.select(
        F.struct("*").alias("_row"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"), draw(id_col, seed).alias("_draw")
    )
    rates = settle(source_targets(sized.select("_source", "_size"), **targets), "mix-targets")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    planned = sized.alias("d").join(rates.alias("r"), F.expr("d._source <=> r._source"))
    copies = (F.floor("rate") + (F.col("_draw") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return planned.select("_row", F.col("_size").alias("size"), "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, with ``copy`` counting from 1."""
    planned = plan_copies(docs, **options).where("copies > 0")
    repeated = planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return repeated.select("_row.*", F.col("_copy").alias("mix_copy"))
