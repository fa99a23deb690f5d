import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
import plain as P  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_all_but_the_last_stage_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    for _, _, after in stages[:-1]:
        assert after.columns == columns
    assert set(columns) <= set(stages[-1][2].columns)


def test_rejected_documents_go(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert after.join(labels.where("quality = 0"), "doc_id").count() == 0
    good = labels.where("quality = 1").join(before, "doc_id").count()
    assert after.join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * good


def test_lines(stages):
    _, before, after = stages[1]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    fewest = min(10, max(2, -(-2 * len({source for _, _, source in rows}) // 5)))
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted(P.site_lines(rows, fewest))
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_one_document_of_each_class(stages):
    _, before, after = stages[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    label, _ = P.classes(rows)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(rows[n][0] for n in set(label))


def test_benchmark_texts_are_gone(spark, stages):
    _, before, after = stages[3]
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaked(rows):
        return {r["doc_id"] for r in rows.collect() if any(i in " ".join((r["text"] or "").lower().split()) for i in items)}

    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert leaked(before) <= gone and not leaked(after) and len(gone) <= len(leaked(before)) + 2


def test_mix_repeats_rows(stages):
    _, before, after = stages[4]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    total = before.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    taken = after.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert taken == pytest.approx(1.5 * total, rel=0.1)


def test_hard_and_empty_rows_pass_every_stage(spark):
    for frame in (P.hard_frame(spark), P.empty_frame(spark)):
        for _, stage in corpus_pipeline.STAGES:
            after = stage(spark, frame, FOLDER)
            assert set(frame.columns) <= set(after.columns)
            after.count()
