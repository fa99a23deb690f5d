"""From raw documents to a training mix: five stages, each one operator over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from quarrylight.session import settle

#: The first and third stage have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from all labels there are for these documents."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.accepted(docs, model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts rid of lines that spread over many sources; ``n_chars`` follows. Null texts stay null."""
    kept = line_dedup.dedup_lines(docs)
    text = F.when(F.col("_row.text").isNotNull(), F.col("kept_text"))
    row = F.col("_row").withField("text", text).withField("n_chars", F.length(text).cast("long"))
    return kept.select(row.alias("_row")).select("_row.*").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the smallest id."""
    return jaccard_join.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are a written table before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
