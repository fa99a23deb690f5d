"""Line dedup: lines that spread over many sites are boilerplate; the spread is a HyperLogLog per line hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import whole_text
from quarrylight.session import settle


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_hashes(text: Column) -> Column:
    """Distinct hashes of a text's lines, blank ones left out."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")
    return F.array_distinct(F.transform(lines, line_hash))


def site_name(site: Column) -> Column:
    return F.concat(F.lit("="), F.coalesce(site.cast("string"), F.lit("")))  # sketches skip empty strings


def fewest_sites(sites: int) -> int:
    """Sites a line must be on to be boilerplate: two in five of those there are, at least 2 and at most 10.

    A corpus of few sites has boilerplate too, and one that is mostly a single site shows a passage on
    fewer of them; where there are many sites, ten that share a line are enough.
    """
    return min(10, max(2, math.ceil(sites * 2 / 5)))


def site_lines(df: DataFrame, id_col: str, text_col: str, site: Column) -> DataFrame:
    return df.select(
        F.col(id_col).cast("long").alias("_id"),
        site_name(site).alias("_site"),
        F.explode(line_hashes(whole_text(text_col))).alias("_line"),
    )


def line_sketches(lines: DataFrame, lg_size: int = 10) -> DataFrame:
    """``_line, _sketch, _first``: the sites of each line as a sketch, and the smallest document that has it."""
    return lines.groupBy("_line").agg(F.hll_sketch_agg("_site", F.lit(lg_size)).alias("_sketch"), F.min("_id").alias("_first"))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """Sketches of several parts of a corpus brought together."""
    return parts.groupBy("_line").agg(F.hll_union_agg("_sketch").alias("_sketch"), F.min("_first").alias("_first"))


def boilerplate(lines: DataFrame, min_sites: int = 10, band: float = 0.3, lg_size: int = 10) -> DataFrame:
    """``_line, _first, _sites`` of the lines on at least ``min_sites`` sites.

    The sketches decide where their estimate is more than ``band`` off the threshold (ten standard
    errors at this size); lines nearer to it are counted exactly.
    """
    spread = line_sketches(lines, lg_size).select("_line", "_first", F.hll_sketch_estimate("_sketch").alias("_sites"))
    spread = spread.where(F.col("_sites") >= min_sites * (1 - band))
    near = F.col("_sites") <= min_sites * (1 + band)
    clear = spread.where(~near)
    # A line that is everywhere is a row per site before it meets anything.
    counted = lines.groupBy("_line", "_site").agg(F.min("_id").alias("_first"))
    exact = counted.join(spread.where(near).select("_line"), "_line", "left_semi").groupBy("_line").agg(F.min("_first").alias("_first"), F.count("*").alias("_sites"))
    return clear.unionByName(exact.where(F.col("_sites") >= min_sites))


def removed_lines(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """``_id, _gone``: for each document the hashes of its lines that go; the first document keeps them."""
    hits = lines.select("_id", "_line").join(spread.select("_line", "_first"), "_line")
    gone = hits.where(F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_first"))))
    return gone.groupBy("_id").agg(F.collect_set("_line").alias("_gone"))  # at most a document's own lines


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site: Column | None = None, min_sites: int | None = None) -> DataFrame:
    """Every row with its text rid of cross-site boilerplate: ``_row, n_lines, n_removed, kept_text``.

    ``_row`` is the row as it came, whatever its columns are called. A line is what stands between
    line feeds, compared without the spaces around it; blank lines stay. ``site`` defaults to the
    column ``source``; a null site is a site. A line on ``min_sites`` sites or more (left out:
    what ``fewest_sites`` says of the exact number of sites of all rows) stays in the
    document with the smallest key only (in each of its rows, if the key repeats) and goes
    everywhere else; if no document with it has a key, it stays. Null and empty texts keep one
    blank line; texts that lose all lines become empty and stay as rows.
    """
    site = F.col("source") if site is None else site
    if min_sites is None:
        min_sites = fewest_sites(df.select(site_name(site).alias("_site")).distinct().count())
    lines = site_lines(df, id_col, text_col, site)
    # Stored first: joined as a table, whatever lines are frequent can be split off or broadcast against.
    gone = removed_lines(lines, settle(boilerplate(lines, min_sites), "boilerplate"))
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_key"), F.split(whole_text(text_col), "\n", -1).alias("_lines"))
    rows = rows.alias("d").join(gone.alias("g"), F.expr("d._key <=> g._id"), "left")
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda line: ~F.array_contains(F.col("_gone"), line_hash(line)) | (F.trim(line) == "")))
    rows = rows.select("_row", F.size("_lines").alias("_all"), kept.alias("_kept"))
    return rows.select(
        "_row", F.col("_all").cast("long").alias("n_lines"), (F.col("_all") - F.size("_kept")).cast("long").alias("n_removed"), F.array_join("_kept", "\n").alias("kept_text")
    )
