"""Corpus preparation: merging sources, sections, chunks, keyed upserts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions import vocab as V
from quarrylight.operators.packing import recursive_chunks
from quarrylight.operators.splits import expand_acronyms


def parse_papers(rows: DataFrame) -> DataFrame:
    """Raw paper rows in the fixed shape; missing columns fall back to the next name.

    A column that exists but is empty is taken as it is; only an absent one is passed over.
    """

    def first_of(names: list[str], default: Column) -> Column:
        for name in names:
            if name in rows.columns:
                return F.coalesce(F.col(name).cast("string"), F.lit(""))
        return default

    paper_id = first_of(["id", "arxiv_id", "doi"], F.lit("unknown"))
    dates = [F.nullif(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("")) for c in ("published", "date", "created") if c in rows.columns]
    year = F.col("year") if "year" in rows.columns else F.lit(None)
    text = first_of(["content", "text", "chunk"], F.lit(""))
    return rows.select(
        F.replace(F.concat(F.lit("arxiv_"), paper_id), F.lit("/"), F.lit("_")).alias("doc_id"),
        T.strip(first_of(["title"], F.lit("Unknown"))).alias("title"),
        T.publication_year(year, F.coalesce(*dates, F.lit("")), paper_id).alias("year"),
        paper_id.alias("arxiv_id"),
        text.alias("full_text"),
    )


def usable_papers(papers: DataFrame) -> DataFrame:
    """Papers with an id and at least 100 characters of text."""
    named = (F.col("arxiv_id") != "") & (F.col("arxiv_id") != "unknown")
    return papers.where((F.length("full_text") >= V.MIN_PAPER_CHARS) & named)


def last_by_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of every key; rows are pre-reduced per task, so repeated keys stay cheap."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def merge_sources(left: DataFrame, right: DataFrame, key: str, prefer_left: bool = True) -> DataFrame:
    """Full outer merge of two sources with one row per key: rows of one side win whole.

    ``origin`` says where a row was found and which side it came from.
    """
    columns = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    row = F.coalesce("a", "b") if prefer_left else F.coalesce("b", "a")
    origin = (
        F.when(F.col("b").isNull(), "left_only")
        .when(F.col("a").isNull(), "right_only")
        .otherwise("both_prefer_left" if prefer_left else "both_prefer_right")
    )
    merged = both.select(key, row.alias("r"), origin.alias("origin"))
    return merged.select(key, *[F.col(f"r.{c}").alias(c) for c in columns], "origin")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` replace rows of the same key; the rest stays."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def unseen(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def first_topic_wins(topics: list[DataFrame], key: str) -> DataFrame:
    """Union of topic crawls in which a paper belongs to the first topic that found it."""
    tagged = [t.withColumn("topic_no", F.lit(i)) for i, t in enumerate(topics)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    others = [c for c in out.columns if c != key]
    best = out.groupBy(key).agg(F.min_by(F.struct(*others), "topic_no").alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def markdown_sections(papers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, section, text`` from ``#`` to ``####`` headers.

    Text before the first header is the preamble. Of repeated names the last text stays, at the
    place of the first.
    """
    pieces = F.split(F.col(text), r"(?m)^(?=[ \t]*#{1,4}[ \t]+\S)")
    parts = papers.select(key, F.posexplode(pieces).alias("ord", "piece"))
    header = r"^[ \t]*#{1,4}[ \t]+([^\n]*)"
    name = F.regexp_extract("piece", header, 1)
    is_header = F.rlike("piece", F.lit(header + r"\S"))
    section = F.when(is_header, T.section_name(T.strip(name))).otherwise("preamble")
    body = T.strip(F.when(is_header, F.regexp_replace("piece", header, "")).otherwise(F.col("piece")))
    named = parts.select(key, "ord", section.alias("section"), body.alias("text")).where(F.length("text") > 0)
    merged = named.groupBy(key, "section").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"))
    return merged.select(key, "ord", "section", "text")


def indexable_sections(sections: DataFrame) -> DataFrame:
    return sections.where(
        ~F.lower("section").isin(*V.SECTION_BLOCKLIST) & (F.length(T.strip(F.col("text"))) >= V.MIN_SECTION_CHARS)
    )


def chunk_sections(
    sections: DataFrame,
    key: str,
    title: str,
    size: int = V.CHUNK_CHARS,
    overlap: int = V.CHUNK_OVERLAP_CHARS,
    acronyms: str | None = None,
) -> DataFrame:
    """Chunks of all sections: ``chunk_id, key, section, ord, text`` with a ``title — Section`` prefix.

    ``acronyms`` names an array column of ``(acronym, full_form)``; their first use in a chunk is
    spelled out.

    The number of a chunk counts the short ones that are dropped, so numbers may have gaps.
    """
    extra = [F.col(acronyms).alias("acronyms")] if acronyms else []
    texts = indexable_sections(sections).select(key, "section", F.col(title).alias("title"), *extra, "text")
    parts = recursive_chunks(texts, "text", size, overlap).withColumnRenamed("chunk", "raw")
    if acronyms:
        parts = parts.withColumn("raw", expand_acronyms(F.col("raw"), F.col("acronyms")))
    # As an array, so that the filter on its length does not compute the body a second time.
    long_enough = F.filter(F.array(T.tidy_whitespace(F.col("raw"))), lambda b: F.length(b) >= V.MIN_CHUNK_CHARS)
    cleaned = parts.withColumn("body", T.unnest(long_enough)).where("body IS NOT NULL")
    label = F.initcap(F.replace(F.col("section"), F.lit("_"), F.lit(" ")))
    return cleaned.select(
        F.format_string("%s_%s_%03d", F.col(key).cast("string"), "section", "ord").alias("chunk_id"),
        key,
        "section",
        "ord",
        F.concat("title", F.lit(" — "), label, F.lit("\n\n"), "body").alias("text"),
    )


def length_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Count, min, max, mean and upper median of text lengths.

    The median comes from counts per distinct length, a table no larger than the longest text, so
    texts are neither sorted nor collected.
    """
    counts = chunks.groupBy(F.length(text).alias("len")).agg(F.count("*").alias("c"))
    running = counts.withColumn("upto", F.sum("c").over(Window.orderBy("len"))).withColumn(
        "n", F.sum("c").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    return running.agg(
        F.sum("c").alias("n"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        (F.sum(F.col("c") * F.col("len")) / F.sum("c")).alias("avg_len"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len"))).alias("median_len"),
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct("paper_id").alias("papers"),
        F.count_distinct("section").alias("sections"),
        (F.count("*") / F.count_distinct("paper_id")).alias("chunks_per_paper"),
    )


def list_papers(chunks: DataFrame) -> DataFrame:
    """One row per paper: first year, number of chunks, sorted section names."""
    return chunks.groupBy("paper_id").agg(
        F.min_by("year", "chunk_id").alias("year"),
        F.count("*").alias("chunk_count"),
        F.array_sort(F.collect_set(F.nullif("section", F.lit("")))).alias("sections"),
    )


def paper_list(chunks: DataFrame) -> DataFrame:
    """Papers by title: ``paper_id, title, year, arxiv_id, chunk_count, sections`` as the first chunk of each tells them.

    ``chunks(chunk_id, paper_id, title, year, arxiv_id, section)``. A paper without a title is 'Unknown', without a
    year 0; chunks that name no paper are left out. Equal titles go by id; the order is one range-partitioned sort.
    """
    named = chunks.where(F.coalesce("paper_id", F.lit("")) != "")
    first = F.min_by(F.struct("title", "year", "arxiv_id"), "chunk_id").alias("first")
    papers = named.groupBy("paper_id").agg(first, F.count("*").alias("chunk_count"), F.array_sort(F.collect_set(F.nullif("section", F.lit("")))).alias("sections"))
    rows = papers.select(
        "paper_id", F.coalesce("first.title", F.lit("Unknown")).alias("title"), F.coalesce("first.year", F.lit(0)).alias("year"),
        F.coalesce("first.arxiv_id", F.lit("")).alias("arxiv_id"), "chunk_count", "sections",
    )
    return rows.orderBy("title", "paper_id")


def section_position(section: Column) -> Column:
    """Reading order of a section name."""
    order = F.create_map(*[x for name, at in V.SECTION_ORDER.items() for x in (F.lit(name), F.lit(at))])
    return F.coalesce(F.try_element_at(order, F.lower(section)), F.lit(V.SECTION_ORDER_DEFAULT))


def paper_view(chunks: DataFrame) -> DataFrame:
    """Chunks of every paper in reading order: section, then the number at the end of the id."""
    number = F.regexp_extract("chunk_id", r"_(\d+)$", 1).try_cast("int")
    w = Window.partitionBy("paper_id").orderBy(section_position(F.col("section")), F.coalesce(number, F.lit(0)), "chunk_id")
    return chunks.withColumn("position", F.row_number().over(w))


def preferred_chunks(chunks: DataFrame, wanted: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` chunks of each wanted paper, abstract and introduction first."""
    place = F.array_position(F.array(*[F.lit(s) for s in V.PREFERRED_SECTIONS]), F.lower("section"))
    rank = F.when(place > 0, place - 1).otherwise(F.lit(len(V.PREFERRED_SECTIONS)))
    w = Window.partitionBy("paper_id").orderBy(rank, "chunk_id")
    return chunks.join(wanted, "paper_id", "left_semi").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


# Characters a token stands for, tokens kept for the prompt around the context, authors that are named.
CHARS_PER_TOKEN, PROMPT_TOKENS, MOST_AUTHORS, PREVIEW_CHARS = 3.5, 512, 5, 200


def context_chars(max_tokens: int) -> int:
    """Characters of context that fit into a window of ``max_tokens`` beside the prompt."""
    return int((max_tokens - PROMPT_TOKENS) * CHARS_PER_TOKEN)


def author_line(authors: Column) -> Column:
    """``Authors: ...`` of an array (its first five) or of a text; null where there are none."""
    named = F.array_join(F.slice(authors, 1, MOST_AUTHORS), ", ")
    return F.when(F.size(authors) > 0, F.concat(F.lit("Authors: "), named))


def document_context(sections: DataFrame, key: str, title: str, max_chars: int, authors: str | None = None) -> DataFrame:
    """Whole text of a paper for a prompt, or a preview of each section when it is too long.

    ``sections(key, ord, section, text, title)``; ``authors`` names an array column of author names.
    """
    from quarrylight.operators.answers import in_order

    label = F.initcap(F.replace(F.col("section"), F.lit("_"), F.lit(" ")))
    full = F.concat(F.lit("\n## "), label, F.lit("\n"), F.col("text"))
    head = F.regexp_replace(F.substring("text", 1, PREVIEW_CHARS), r" [^ ]*$", "")
    short = F.when((F.length("text") > PREVIEW_CHARS) & (F.lower("section") != "abstract"), F.concat(head, F.lit("…"))).otherwise(F.col("text"))
    preview = F.concat(F.lit("\n## "), label, F.lit("\n"), short)
    first = F.when(F.lower("section") == "abstract", F.lit(-1)).otherwise(F.col("ord"))
    marked = sections.withColumn("full", full).withColumn("preview", preview).withColumn("first", first)
    line = author_line(F.col(authors)) if authors else F.lit(None).cast("string")
    built = marked.groupBy(key, title).agg(
        F.first(line, ignorenulls=True).alias("authors_line"),
        F.array_join(in_order("ord", "full"), "\n").alias("full"),
        F.array_join(in_order("first", "preview"), "\n").alias("preview"),
    )
    lead = F.concat(F.lit("Title: "), F.col(title), F.lit("\n"), F.coalesce(F.concat("authors_line", F.lit("\n")), F.lit("")))
    whole, less = F.concat(lead, "full"), F.concat(lead, "preview")
    cut = F.when(F.length(less) > max_chars, F.concat(F.substring(less, 1, max_chars), F.lit("\n[truncated]"))).otherwise(less)
    return built.select(key, F.when(F.length(whole) <= max_chars, whole).otherwise(cut).alias("context"))


def with_cache(rows: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """Join results computed earlier for the same text: ``cache(fingerprint, cached)``."""
    keyed = rows.withColumn("fingerprint", T.fingerprint(F.col(text)))
    return keyed.join(cache, "fingerprint", "left").withColumn("hit", F.col("cached").isNotNull())
