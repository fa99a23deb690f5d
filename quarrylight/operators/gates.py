"""Answer gates on the words of a question: its entities against the passages, its premises against them.

Entities are rows, so are their spellings; counting them in the passages is one projection and the
verdict a decision over the counts. Premises are column expressions over the question and its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V

# How many of the best results each check reads.
ENTITY_RESULTS, PREMISE_RESULTS, PAPER_RESULTS = 5, 3, 10
# Shapes of entities in a question (the last one's quotes are not part of it).
ENTITY_SHAPES = [
    (r"\b([A-Z][A-Za-z]*(?:-[A-Za-z0-9]+)*)\b", 1),
    (r"([A-Z]{2,}-?\d[\w.-]*)", 1),
    (r"([A-Z][a-z]+(?:[A-Z][a-z]+)+)", 1),
    (r'"([^"]+)"', 1),
]
# Shapes of questions that assert something checkable.
CLAIM_SHAPES = [
    r"(?U)according to (?:the )?(\w[\w\s]*?)(?:paper|study|work|authors?),?\s+(?:what|how|the|their)\s+(?:were\s+)?(?:the )?results? (?:of|on|for)\s+(?:applying\s+\w+\s+to\s+)?(\w[\w\s]*?)[\?\.]",
    r"(?U)(?:the|that)\s+(?:original\s+)?(\w[\w\s]*?)paper\s+(?:showed?|demonstrated?|proved?|claimed?)\s+(?:that\s+)?(?:their\s+)?model\s+(\w[\w\s]*?)[\.\?]",
    r"(?U)what (?:accuracy|score|result|performance) did (?:the )?(\w[\w\s]*?)(?:achieve|get|reach) on (\w[\w\s]*?)[\?\.]",
]
NUMBER_SHAPES = [
    r"(?iU)(\w+)\s+(?:uses?|has|have|contains?)\s+(\d[\d,.]*)\s*(?:billion|million|thousand|B|M|K)?\s*(?:parameters?|layers?|heads?|dimensions?|tokens?)",
    r"(?iU)(\w+)\s+(?:scores?d?|achieves?d?|reache[sd]|got|gets?)\s+(?:a\s+)?(?:score\s+of\s+)?(\d[\d,.]*)\s*(?:BLEU|F1|accuracy|%|percent)",
    r"(?iU)(?:the\s+)?(\w+)\s+paper\s+(?:claims?|shows?|proves?|states?)\s+that\s+.*?(\d[\d,.]+)\s*(?:billion|million|thousand|B|M|K|%|percent)?",
]
PAPER_SHAPE = r"(?U)according to (?:the )?(\w[\w\s-]*?)(?:paper|study|work)"
APPLIED_SHAPE = r"(?U)(?:applying\s+\w+\s+to|applied\s+to|results?\s+(?:of|on)\s+applying\s+\w+\s+to)\s+([\w][\w\s-]+?)(?:\s+models?)?[\?\.]"
REACH, OFTEN = 100, 5


def occurrences(text: Column, part: Column) -> Column:
    """How often a non-empty string occurs in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def holds_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def question_entities(questions: DataFrame) -> DataFrame:
    """``query_id, entity, key``: capitalised names, model codes, joined words and quoted phrases.

    ``key`` is the lower-case name; of spellings that share it the first one found stays.
    """
    found = [F.regexp_extract_all("question", F.lit(shape), F.lit(group)) for shape, group in ENTITY_SHAPES]
    names = F.filter(found[0], lambda name: (F.length(name) > 2) & ~name.isin(*V.SENTENCE_OPENERS))
    stem = lambda name: F.substring_index(name, "-", 1)
    hyphened = F.filter(names, lambda name: (F.length(stem(name)) > 2) & F.lower(F.substring_index(name, "-", -1)).isin(*V.HYPHEN_SUFFIXES) & F.contains(name, F.lit("-")))
    listed = F.concat(names, F.transform(hyphened, stem), *found[1:])
    rows = questions.select("query_id", F.posexplode(listed).alias("at", "entity"))
    return rows.groupBy("query_id", F.lower("entity").alias("key")).agg(F.min_by("entity", "at").alias("entity"))


def entity_spellings(entities: DataFrame) -> DataFrame:
    """One row per lower-case form under which an entity may appear: ``query_id, key, form``."""
    key, entity = F.col("key"), F.col("entity")
    shorter = [F.when(F.endswith(key, F.lit(s)), F.substring(key, F.lit(1), F.length(key) - len(s))) for s in V.VARIANT_SUFFIXES]
    inner = F.rlike(F.substring(entity, 2, 1 << 30), F.lit("[A-Z]"))
    parts = F.concat(
        F.when(inner, F.regexp_extract_all(entity, F.lit("([A-Z][a-z]*|[a-z]+)"), F.lit(1))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(entity, F.lit("-")), F.split(entity, "-")).otherwise(F.array().cast("array<string>")),
    )
    long_parts = F.transform(F.filter(parts, lambda p: F.length(p) > 2), lambda p: F.lower(p))
    forms = F.array_distinct(F.array_compact(F.concat(F.array(key, *shorter), long_parts)))
    return entities.select("query_id", "key", F.explode(forms).alias("form")).where(F.length("form") > 0)


def entity_verdicts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, entity_reason``: why the passages don't cover the question's entities, or ''.

    ``evidence(query_id, body, heads)`` holds the lower-case text and titles of the results read.
    Codes: ``absent_terms``, ``no_terms``, ``passing_mention``.
    """
    entities = question_entities(questions)
    counted = (
        entity_spellings(entities)
        .join(evidence.select("query_id", "body", "heads"), "query_id")
        .select("query_id", "key", occurrences(F.col("body"), F.col("form")).alias("times"), F.contains("heads", F.col("form")).alias("titled"))
        .groupBy("query_id", "key")
        .agg(F.max("times").alias("times"), F.bool_or("titled").alias("titled"))
    )
    acronym = F.col("key").isin(*V.CONCEPT_ACRONYMS)
    nowhere = (F.col("times") == 0) & ~F.col("titled")
    told = counted.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.bool_and(acronym).alias("concepts"),
        F.count_if(F.col("titled") | (F.col("times") >= 1)).alias("named"),
        F.count_if(F.col("titled") | (F.col("times") >= 3)).alias("prominent"),
        F.count_if(nowhere & ~acronym & (F.length("key") > 2)).alias("absent"),
        F.bool_or(F.col("times") > 0).alias("seen"),
    )
    rows = questions.select("query_id", holds_any(F.lower("question"), V.SYNTHESIS_WORDS).alias("wide")).join(told, "query_id", "left")
    covered = F.when(F.col("wide") & (F.col("n") > 1), F.col("named")).otherwise(F.col("prominent"))
    reason = (
        F.when(F.col("n").isNull() | F.col("concepts"), "")
        .when(F.col("wide") & (covered >= F.col("n") / 2), "")
        .when(~F.col("wide") & (covered > 0), F.when(F.col("absent") > 0, "absent_terms").otherwise(""))
        .when(F.col("seen"), "passing_mention")
        .otherwise("no_terms")
    )
    return rows.select("query_id", reason.alias("entity_reason"))


def unmet_claim(question: Column, body: Column) -> Column:
    """A claim about a paper names a term of more than three letters that the text lacks."""
    terms = [F.trim(F.regexp_extract(question, shape, group)) for shape in CLAIM_SHAPES for group in (1, 2)]
    return F.exists(F.array(*terms), lambda term: (F.length(term) > 3) & ~F.contains(body, term))


def unmet_number(question: Column, body: Column) -> Column:
    """A number the question states that the text lacks."""
    numbers = [F.replace(F.regexp_extract(question, shape, 2), F.lit(","), F.lit("")) for shape in NUMBER_SHAPES]
    return F.exists(F.array(*numbers), lambda number: (number != "") & ~F.contains(body, number))


def contexts(text: Column, term: Column) -> Column:
    """The surroundings of every whole-word occurrence of a term, ``REACH`` characters on both sides."""
    between = F.split(text, F.concat(F.lit(r"(?U)\b"), term, F.lit(r"\b")), -1)
    width = F.length(term)
    before = lambda n: F.aggregate(F.slice(between, 1, n), F.lit(0), lambda sum_, part: sum_ + F.length(part))
    at = F.transform(F.sequence(F.lit(1), F.size(between) - 1), lambda n: before(n) + (n - 1) * width)
    near = F.transform(at, lambda p: F.substring(text, F.greatest(p - REACH, F.lit(0)) + 1, F.least(p, F.lit(REACH)) + width + REACH))
    return F.when(F.size(between) > 1, near).otherwise(F.array().cast("array<string>"))


def premise_verdicts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, premise_reason``: why a premise of the question looks wrong, or ''.

    ``evidence(query_id, top, papers)``: lower-case text of the few best results, and of more of
    them an array of ``(title, text)``. A claim about a named paper must be in that paper's own
    passages, often, and near both its method and a word for results. Codes: ``unknown_claim``,
    ``unknown_number``, ``paper_not_found``, ``rare_claim``, ``no_joint_evidence``.
    """
    low = F.lower("question")
    rows = questions.join(evidence.select("query_id", "top", "papers"), "query_id", "left").select(
        "query_id",
        unmet_claim(low, F.coalesce("top", F.lit(""))).alias("claim_unmet"),
        unmet_number(F.col("question"), F.coalesce("top", F.lit(""))).alias("number_unmet"),
        F.rlike(low, F.lit(PAPER_SHAPE)).alias("about_paper"),
        F.trim(F.regexp_extract(low, PAPER_SHAPE, 1)).alias("paper"),
        F.trim(F.regexp_extract(low, APPLIED_SHAPE, 1)).alias("use"),
        F.coalesce("papers", F.array().cast("array<struct<title:string,text:string>>")).alias("papers"),
    )
    own = F.filter("papers", lambda p: F.contains(F.lower(p["title"]), F.col("paper")))
    rows = rows.withColumn("n_own", F.size(own)).withColumn("own", F.lower(F.array_join(F.transform(own, lambda p: p["text"]), " ")))
    rows = rows.withColumn("near", F.when(F.col("use") != "", contexts(F.col("own"), F.col("use"))).otherwise(F.array().cast("array<string>")))
    method = lambda text: F.contains(text, F.col("paper")) | holds_any(text, V.METHOD_WORDS)
    studied = F.exists("near", lambda text: method(text) & holds_any(text, V.RESULT_WORDS))
    reason = (
        F.when(F.col("claim_unmet"), "unknown_claim")
        .when(F.col("number_unmet"), "unknown_number")
        .when(~F.col("about_paper"), "")
        .when(F.col("n_own") == 0, "paper_not_found")
        .when(F.col("use") == "", "")
        .when((F.length("use") > 3) & (F.size("near") < OFTEN), "rare_claim")
        .when((F.size("near") > 0) & ~studied, "no_joint_evidence")
        .otherwise("")
    )
    return rows.select("query_id", reason.alias("premise_reason"))
