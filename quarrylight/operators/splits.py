"""Texts as rows of sentences or lines: topic splits, sections of PDF text, preambles, repairs.

Sentences and lines of one text are rows that windows over the text's key put in context; only the
packing of pieces to a size folds over an array, and that array is one text's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.functions.text import strip
from quarrylight.operators.answers import in_order

# An average similarity this even has no drops; defaults of the topic splitter.
FLAT, LOW, HIGH, WINDOW, SPREAD = 1e-6, 200, 2048, 3, 1.0


def sentences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, nth, sentence``: a sentence behind a known abbreviation is one with it."""
    parts = texts.select(key, F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("at", "part")).where(F.length(strip(F.col("part"))) > 0)
    order = Window.partitionBy(key).orderBy("at")
    last_word = F.lower(F.element_at(F.split(strip(F.rtrim(F.col("part"), F.lit("."))), r"\s+"), -1))
    parts = parts.withColumn("starts", F.coalesce(~F.lag(last_word.isin(*V.ABBREVIATIONS)).over(order), F.lit(True)))
    parts = parts.withColumn("nth", F.sum(F.col("starts").cast("int")).over(order) - 1)
    return parts.groupBy(key, "nth").agg(strip(F.array_join(in_order("at", "part"), " ")).alias("sentence"))


def hashed_words(rows: DataFrame, key: str) -> DataFrame:
    """``key, nth, bucket, value``: unit-length hashed word counts, the offline stand-in for a sentence model."""
    words = rows.select(key, "nth", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("word"))
    counts = words.groupBy(key, "nth", (F.crc32("word") % 256).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key, "nth")))
    return counts.select(key, "nth", "bucket", (F.col("n") / norm).alias("value"))


def hashed_vector(sentence: Column) -> Column:
    """The vector of ``hashed_words`` as a map from bucket to value, without rows for words."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit("[a-z0-9]{2,}"), F.lit(0))
    told = F.array_sort(F.transform(words, lambda w: (F.crc32(w) % 256).cast("int")))
    # In sorted order a bucket's count is the way from its first place to the next bucket's.
    firsts = lambda h: F.transform(F.array_distinct(h), lambda d: F.struct(d.alias("bucket"), F.array_position(h, d).alias("at")))
    sized = lambda f, end: F.transform(f, lambda x, i: F.struct(x["bucket"].alias("bucket"), (F.coalesce(F.get(f, i + 1)["at"], end) - x["at"]).cast("double").alias("n")))
    counts = _once(told, lambda h: _once(firsts(h), lambda f: sized(f, F.size(h) + 1)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda total, x: total + x["n"] * x["n"]))
    unit = lambda c, length: F.transform(c, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / length).alias("value")))
    return F.map_from_entries(_once(counts, lambda c: _once(norm(c), lambda length: unit(c, length))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _with_similarity(rows: DataFrame, key: str, window: int) -> DataFrame:
    """``rows(key, nth, vector, ...)`` with the ``similarity`` of the gap before each sentence; none before the first.

    Only products of sentences fewer than ``2 * window`` apart count. Every sentence meets those behind it, and a gap
    adds up the products of its sides, so nothing is copied to gaps and nothing leaves the text's partition.
    """
    order = Window.partitionBy(key).orderBy("nth")
    reach = range(1, 2 * window)
    near = rows.select("*", *[F.lead("vector", k).over(order).alias(f"_next{k}") for k in reach])
    dot = lambda u, v: F.aggregate(F.map_entries(v), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.try_element_at(u, e["key"]), F.lit(0.0)))
    dots = F.array(*[F.coalesce(dot(F.col("vector"), F.col(other)), F.lit(0.0)) for other in ("vector", *(f"_next{k}" for k in reach))])
    told = near.withColumn("_dots", dots).drop("vector", *(f"_next{k}" for k in reach))
    places = range(-window, window)
    told = told.select("*", *[F.lag("_dots", -i).over(order).alias(f"_dots{i + window}") for i in places])
    product = lambda i, j: F.coalesce(F.get(F.col(f"_dots{min(i, j) + window}"), F.lit(abs(i - j))), F.lit(0.0))
    left, right = range(-window, 0), range(window)
    total = lambda ones, others: sum((product(i, j) for i in ones for j in others), F.lit(0.0))
    cosine = total(left, right) / F.nullif(F.sqrt(total(left, left) * total(right, right)), F.lit(0.0))
    similarity = F.when(F.col("nth") > 0, F.round(F.coalesce(cosine, F.lit(0.0)), 12))
    return told.withColumn("similarity", similarity).drop("_dots", *(f"_dots{i + window}" for i in places))


def _vectored(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``vectors(key, nth, bucket, value)`` say of each sentence as a map."""
    summed = vectors.groupBy(key, "nth", "bucket").agg(F.sum("value").alias("value"))
    maps = summed.groupBy(key, "nth").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("vector"))
    return rows.join(maps, [key, "nth"], "left")


def gap_similarity(vectors: DataFrame, rows: DataFrame, key: str, window: int = WINDOW) -> DataFrame:
    """``key, gap, similarity`` of up to ``window`` sentences before and behind each gap; gap n is before sentence n.

    A sum has the direction of the mean, so the sides are sums of their sentences' vectors.
    """
    return _with_similarity(_vectored(rows, vectors, key), key, window).where("nth > 0").select(key, F.col("nth").alias("gap"), "similarity")


def _drops(key: str, spread: float) -> Column:
    text = Window.partitionBy(key)
    mean, deviation = F.avg("similarity").over(text), F.stddev_pop("similarity").over(text)
    return (deviation >= FLAT) & (F.col("similarity") < mean - spread * deviation)


def topic_gaps(similarity: DataFrame, key: str, spread: float = SPREAD) -> DataFrame:
    """``key, gap`` where the similarity is ``spread`` deviations under the mean of the text."""
    return similarity.select(key, "gap", _drops(key, spread).alias("cut")).where("cut").select(key, "gap")


def packed(pieces: Column, low: int, high: int) -> Column:
    """Neighbouring pieces as runs ``(first, last, size)``: a run under ``low`` takes the next if ``high`` allows."""
    sizes = F.transform(pieces, lambda p, i: F.struct(i.alias("first"), i.alias("last"), F.length(p).alias("size")))
    end = lambda runs: F.element_at(runs, -1)

    def joined(runs: Column, other: Column) -> Column:
        whole = F.struct(end(runs)["first"].alias("first"), other["last"].alias("last"), (end(runs)["size"] + 1 + other["size"]).alias("size"))
        return F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(whole))

    def take(runs: Column, piece: Column) -> Column:
        fits = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["size"] < low) & (F.try_element_at(runs, F.lit(-1))["size"] + 1 + piece["size"] <= high)
        return F.when(fits, joined(runs, piece)).otherwise(F.concat(runs, F.array(piece)))

    runs = F.aggregate(sizes, F.array().cast("array<struct<first:int,last:int,size:int>>"), take)
    before = lambda r: F.slice(r, 1, F.size(r) - 1)
    small = (F.size(runs) > 1) & (F.try_element_at(runs, F.lit(-1))["size"] < low)
    room = F.try_element_at(runs, F.lit(-2))["size"] + 1 + F.try_element_at(runs, F.lit(-1))["size"] <= high
    return F.when(small & room, joined(before(runs), end(runs))).otherwise(runs)


def wrapped(text: Column, high: int) -> Column:
    """A text as lines of at most ``high`` characters, broken between words; a longer word is a line."""

    def take(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = (F.size(lines) > 0) & (F.length(last) + 1 + F.length(word) <= high)
        return F.when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.length(text) <= high, F.array(text)).otherwise(F.aggregate(words, F.array().cast("array<string>"), take))


def semantic_chunks(
    texts: DataFrame, key: str, text: str, embed: Callable[[DataFrame, str], DataFrame] = hashed_words,
    low: int = LOW, high: int = HIGH, window: int = WINDOW, spread: float = SPREAD,
) -> DataFrame:
    """``key, ord, chunk``: texts cut where the topic changes, pieces joined or wrapped to size.

    ``embed`` gets rows ``key, nth, sentence`` and the key's name and returns ``key, nth, bucket, value``.
    """
    if not 0 <= low < high or spread < 0:
        raise ValueError("need 0 <= low < high and spread >= 0")
    # Dealt out by text once; every step behind it groups by the text, so nothing is shuffled again.
    rows = sentences(texts.repartition(key), key, text)
    vectored = rows.withColumn("vector", hashed_vector(F.col("sentence"))) if embed is hashed_words else _vectored(rows, embed(rows, key), key)
    marked = _with_similarity(vectored, key, window).withColumn("cut", F.coalesce(_drops(key, spread).cast("int"), F.lit(0)))
    piece = F.sum("cut").over(Window.partitionBy(key).orderBy("nth"))
    pieces = marked.withColumn("piece", piece).groupBy(key, "piece").agg(F.array_join(in_order("nth", "sentence"), " ").alias("body"))
    whole = pieces.groupBy(key).agg(in_order("piece", "body").alias("pieces"))
    runs = whole.select(key, "pieces", F.explode(packed(F.col("pieces"), low, high)).alias("run"))
    body = F.array_join(F.slice("pieces", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1), " ")
    lines = runs.select(key, F.col("run.first").alias("first"), F.posexplode(wrapped(body, high)).alias("line", "chunk"))
    return lines.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("first", "line")) - 1).alias("ord"), "chunk")


# Shapes of section headers in text taken from PDF files.
PDF_HEADERS = [
    r"^#{1,4}\s+(.+)$",
    r"^(\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z\s]+)$",
    r"^([A-Z][A-Z\s]{3,40})$",
    r"(?i)^(Abstract|Introduction|Related Work|Background|Method(?:ology|s)?|Approach|Model|Architecture|"
    r"Experiment(?:s|al)?(?:\s+(?:Setup|Results))?|Results|Discussion|Conclusion(?:s)?|Limitation(?:s)?|"
    r"Training|Evaluation|Analysis|Appendix)\s*$",
]
LONE_NUMBER = r"^(\d+(?:\.\d+)*)\.?\s*$"
SHORT_TEXT, LONG_HEADER, LONG_TITLE, SHORT_BODY = 100, 80, 60, 30


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.col(text).alias("whole"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).withColumn("bare", strip(F.col("line")))


def pdf_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, header, text`` of text taken from a PDF; names may repeat.

    A number alone on a line and a short title on the next make one header. Sections with little
    text are dropped; a text that is short or has no other is one section ``full_text``.
    """
    filled = texts.select(key, F.coalesce(text, F.lit("")).alias("_body"))
    order = Window.partitionBy(key).orderBy("at")
    following = F.coalesce(F.lead("bare").over(order), F.lit(""))
    shaped = F.coalesce(*(F.when(F.rlike("bare", F.lit(p)), strip(F.regexp_extract("bare", p, 1))) for p in PDF_HEADERS), F.lit(""))
    titled = F.rlike(following, F.lit(r"^\p{Lu}")) & (F.length(following) < LONG_TITLE) & ~F.endswith(following, F.lit("."))
    lines = text_lines(filled, key, "_body").select(
        key, "at", "line", shaped.alias("shaped"), ((shaped == "") & F.rlike("bare", F.lit(LONE_NUMBER)) & titled).alias("split"), F.concat("bare", F.lit(" "), following).alias("both")
    )
    taken = F.coalesce(F.lag("split").over(order), F.lit(False))
    lines = lines.withColumn("taken", taken).where("not taken").withColumn("header", F.when(F.col("split"), F.col("both")).otherwise(F.col("shaped")))
    is_header = (F.col("header") != "") & (F.length("header") < LONG_HEADER)
    lines = lines.withColumn("opens", is_header).withColumn("nth", F.sum(F.col("opens").cast("int")).over(order))
    found = lines.groupBy(key, "nth").agg(
        F.coalesce(F.max(F.when(F.col("opens"), F.col("header"))), F.lit("preamble")).alias("header"),
        strip(F.array_join(in_order("at", F.when(~F.col("opens"), F.col("line"))), "\n")).alias("text"),
    )
    kept = found.where(F.length("text") > SHORT_BODY)
    long_enough = filled.where(F.length(strip(F.col("_body"))) >= SHORT_TEXT).select(key)
    kept = kept.join(long_enough, key, "left_semi")
    whole = filled.join(kept.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("nth"), F.lit("full_text").alias("header"), F.col("_body").alias("text"))
    both = kept.select(key, F.col("nth").cast("long").alias("nth"), "header", "text").unionByName(whole)
    return both.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("nth")) - 1).alias("ord"), "header", "text")


# What a caption starts with, and the lengths that tell headings from sentences.
CAPTION = r"(?i)^(?:Figure|Fig\.|Table|Algorithm)\s+\d+"
SHORT_LINE, SENTENCE = 50, 60


def strip_preambles(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` without the title prefix, captions and short headings a chunk may start with.

    A caption goes on over short lines in lower case. The text starts at the first line that is
    long or ends like a sentence; without one nothing but the prefix is taken off.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A.+ — .+\n\n", "")
    lines = text_lines(texts.select(key, body.alias("_body")), key, "_body")
    caption = F.rlike("bare", F.lit(CAPTION))
    goes_on = (F.length("bare") < SHORT_LINE) & F.rlike("bare", F.lit(r"^\p{Ll}"))
    # What the line says about the ones behind it: in a caption, out of it, or as before.
    says = F.when(F.col("bare") == "", False).when(caption, True).when(goes_on, F.lit(None)).otherwise(False)
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(says, ignorenulls=True).over(before), F.lit(False))
    starts = (F.col("bare") != "") & ~caption & ~(inside & goes_on) & ((F.length("bare") >= SENTENCE) | F.rlike("bare", F.lit(r"[.!?:,]$")))
    first = lines.withColumn("starts", starts).groupBy(key, "whole").agg(F.min(F.when(F.col("starts"), F.col("at"))).alias("at"))
    rest = F.array_join(F.slice(F.split("whole", "\n", -1), F.coalesce("at", F.lit(0)) + 1, F.length("whole") + 1), "\n")
    return first.select(key, strip(rest).alias("text"))


# Characters whose UTF-8 bytes often show up one by one, and readings that lost a byte.
MOJIBAKE_CHARS = "αβγδεζηθικλμνξοπσςτυφχψω≤≥≈×÷±∞√∂∆∇∈∩∪∼·áéóöüñç²³"
MOJIBAKE_MORE = {"â†'": "→", "âˆ'": "∑", "Ï²": "ρ", "Ïµ": "ε", "Âµ": "μ", "Ï\x81": "ρ", "Ï": "ρ"}


def garbled(char: str) -> str:
    """A character's UTF-8 bytes read as cp1252; bytes that has no letter for keep their number."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in char.encode())


def fix_encoding(text: Column) -> Column:
    """Undo UTF-8 read as Latin-1, for the whole text where that works, else sign by sign."""
    text = F.coalesce(text, F.lit(""))
    marks = lambda t: F.length(F.regexp_replace(t, "[^ÂÃ]", ""))
    latin = F.rlike(text, F.lit(r"\A[\x00-\xFF]*\z"))
    again = F.encode(F.when(latin, text).otherwise(F.lit("")), "ISO-8859-1").cast("string")
    signs = text
    for bad, good in {**{garbled(c): c for c in MOJIBAKE_CHARS}, **MOJIBAKE_MORE}.items():
        signs = F.replace(signs, F.lit(bad), F.lit(good))
    return F.when(latin & F.is_valid_utf8(again) & (marks(again) < marks(text)), again).otherwise(signs)


def expand_acronyms(text: Column, pairs: Column) -> Column:
    """Spell out the first standalone use of every acronym that is not spelled out yet.

    ``pairs`` is an array of ``(acronym, full_form)``; of repeated acronyms the last counts.
    """
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["acronym"] == p["acronym"]))

    def spell(told: Column, pair: Column) -> Column:
        spelled = F.concat(pair["full_form"], F.lit(" ("), pair["acronym"], F.lit(")"))
        first = F.concat(F.lit(r"(?s)\A(.*?)\b\Q"), pair["acronym"], F.lit(r"\E\b"))
        safe = F.regexp_replace(spelled, r"([\\$])", r"\\$1")
        return F.when(F.contains(told, spelled), told).otherwise(F.regexp_replace(told, first, F.concat(F.lit("$1"), safe)))

    return F.aggregate(F.coalesce(last, F.array().cast("array<struct<acronym:string,full_form:string>>")), F.coalesce(text, F.lit("")), spell)
