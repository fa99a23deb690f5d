"""Evaluation sets in their loose source shapes, brought into fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The keys under which annotated spans and passages may store their fields.
SPAN = "struct<text:string,hallucinated_text:string,start:int,start_idx:int,end:int,end_idx:int,label_type:string,type:string,hallucination_type:string>"
PASSAGE = "struct<text:string,content:string,is_relevant:boolean,relevant:boolean,id:string,passage_id:string>"
DEFLECT_TAGS = ["unanswerable", "no_answer", "deflect"]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


EVAL_QUERY = (
    "id string, question string, difficulty string, category string, answer_type string, reason string, should_deflect boolean, "
    "relevant_doc string, relevant_docs array<string>, expected_section string, expected_sections array<string>"
)


def read_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation queries in any of their shapes, from a JSON array or JSON lines."""
    array = spark.read.schema(EVAL_QUERY).option("multiLine", True).json(path)
    return eval_queries(array)


def eval_queries(rows: DataFrame) -> DataFrame:
    """One shape for rows that name one paper or several, one section or several, or none at all.

    ``id, question, difficulty, category, papers, sections, should_deflect, reason``.
    """
    none = F.array().cast("array<string>")
    several = lambda many, single: F.coalesce(many, F.when(single.isNotNull(), F.array(single)), none)
    papers = several(F.col("relevant_docs"), F.col("relevant_doc"))
    return rows.select(
        "id", "question", "difficulty", "category", papers.alias("papers"), several(F.col("expected_sections"), F.col("expected_section")).alias("sections"),
        F.coalesce("should_deflect", F.lit(False)).alias("should_deflect"), "reason",
    )


def quoted_spans(reasoning: Column, answer: Column) -> Column:
    """Quotes of ten characters or more in a judge's reasoning that the answer holds, case aside."""
    quotes = F.regexp_extract_all(reasoning, F.lit('"([^"]{10,})"'), F.lit(1))
    return F.filter(quotes, lambda quote: F.contains(F.lower(answer), F.lower(quote)))


def parse_spans(raw: Column) -> Column:
    """JSON array of span objects (either key set) or of plain strings."""
    objects = F.from_json(raw, f"array<{SPAN}>")
    strings = F.from_json(raw, "array<string>")
    named = F.transform(
        objects,
        lambda s: F.struct(
            F.coalesce(s["text"], s["hallucinated_text"], F.lit("")).alias("text"),
            F.coalesce(s["start"], s["start_idx"], F.lit(-1)).alias("start"),
            F.coalesce(s["end"], s["end_idx"], F.lit(-1)).alias("end"),
            F.coalesce(s["label_type"], s["type"], s["hallucination_type"], F.lit("")).alias("label_type"),
        ),
    )
    plain = F.transform(
        strings,
        lambda s: F.struct(s.alias("text"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("label_type")),
    )
    return F.when(F.rlike(raw, F.lit(r'^\s*\[\s*"')), plain).otherwise(F.coalesce(named, F.slice(plain, 1, 0)))


def annotated_responses(sources: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses with the last source of their id; empty fields fall back to the other side.

    ``sources(source_id, ord, source_info, task_type, prompt)``,
    ``responses(id, source_id, response, task_type, prompt, spans)`` with ``spans`` parsed.
    """
    last = sources.groupBy("source_id").agg(F.max_by(F.struct("source_info", "task_type", "prompt"), "ord").alias("s"))
    joined = responses.join(last, "source_id", "left")

    def pick(mine: str, theirs: str) -> Column:
        return F.coalesce(F.nullif(mine, F.lit("")), F.nullif(F.col(theirs), F.lit("")), F.lit(""))

    return joined.select(
        "id",
        "source_id",
        pick("task_type", "s.task_type").alias("task_type"),
        F.coalesce(F.col("s.source_info"), F.lit("")).alias("context"),
        pick("prompt", "s.prompt").alias("prompt"),
        "response",
        "spans",
        (F.size("spans") > 0).alias("has_hallucination"),
    )


def grounded_questions(raw: DataFrame) -> DataFrame:
    """Questions with passages: JSON ``passages`` in any key set, and a deflect flag of three signals.

    ``raw(id, question, answer, passages, question_tag, should_deflect, answerable)``.
    """
    parsed = F.from_json("passages", f"array<{PASSAGE}>")
    passages = F.transform(
        parsed,
        lambda p, i: F.struct(
            (i + 1).alias("passage_no"),
            F.coalesce(p["text"], p["content"], F.lit("")).alias("text"),
            F.coalesce(p["is_relevant"], p["relevant"], F.lit(False)).alias("is_relevant"),
            F.coalesce(p["id"], p["passage_id"], F.concat(F.lit("p_"), i.cast("string"))).alias("passage_id"),
        ),
    )
    deflect = (
        F.lower("question_tag").isin(*DEFLECT_TAGS)
        | F.coalesce("should_deflect", F.lit(False))
        | ~F.coalesce("answerable", F.lit(True))
    )
    return raw.select("id", "question", F.col("answer").alias("gold"), passages.alias("passages"), deflect.alias("should_deflect"), "question_tag")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42, by: str | None = None) -> DataFrame:
    """A repeatable sample: the ``n`` rows (per ``by``) with the smallest hash of key and seed."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    if by is None:
        return rows.withColumn("draw", draw).orderBy("draw", key).limit(n).drop("draw")
    w = Window.partitionBy(by).orderBy("draw", key)
    return rows.withColumn("draw", draw).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("draw", "nth")
