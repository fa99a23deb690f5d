"""Evaluation runs: summaries of gappy rows, and runs that answer from given context."""

import pytest

from quarrylight.operators import runs
from quarrylight.plans import evaluation

COLUMNS = "run_id int, query_id long, topic string, query_type string, difficulty string, expected_deflection boolean, deflected boolean, latency_ms double, " + ", ".join(f"{m} double" for m in runs.MEANS)


def row(query, topic, expected, deflected, latency, value):
    return (1, query, topic, "simple", "easy", expected, deflected, latency, *([value] * len(runs.MEANS)))


def test_means_skip_what_was_not_measured(spark):
    rows = [row(1, "a", False, False, 100.0, 0.5), row(2, "a", True, True, 0.0, 0.9), row(3, "b", None, True, 50.0, None), row(4, "b", False, None, 30.0, 1.0)]
    frame = spark.createDataFrame(rows, COLUMNS)
    got = {(r["topic"], r["query_type"], r["difficulty"]): r for r in runs.shown(runs.summary(frame)).collect()}
    every = got[None, None, None]
    assert every["total_queries"] == 4 and every["mrr"] == 0.75 and every["citation_density"] == 0.75
    assert every["deflection_accuracy"] == round(2 / 3, 4) and every["avg_latency_ms"] == 60.0
    assert got["a", None, None]["mrr"] == 0.5 and got["b", None, None]["deflection_accuracy"] == 0.0
    assert len(got) == 5 and runs.summary(frame.limit(0)).count() == 0
    none = runs.summary(frame.where("query_id = 2")).where("topic IS NULL AND query_type IS NULL AND difficulty IS NULL").first()
    assert none["mrr"] == 0.0 and none["avg_latency_ms"] == 0.0 and none["deflection_accuracy"] == 1.0


def test_citation_reports(spark):
    rows = [(1, "correct", 1.0, 1.0, "a"), (2, "over_citation", 0.5, 1.0, "a"), (3, "not_cited", 0.0, 0.0, "b"), (4, "retrieval_miss", 0.0, 0.0, "b")]
    frame = spark.createDataFrame(rows, "query_id long, class string, precision double, recall double, topic string")
    told = {(r["class"], r["topic"]): r for r in runs.citation_splits(frame, ["topic"]).collect()}
    assert (told[None, None]["precision_perfect"], told[None, None]["precision_partial"], told[None, None]["precision_zero"]) == (1, 1, 2)
    assert told[None, "b"]["recall_zero"] == 2 and told["correct", None]["precision"] == 1.0
    causes = {r["class"]: (r["n"], r["share"], r["failure_share"]) for r in runs.root_causes(frame).collect()}
    assert causes["correct"] == (1, 0.25, None) and causes["not_cited"] == (1, 0.25, pytest.approx(1 / 3))


def test_grounded_run_answers_from_its_passages(spark):
    text = "Gradient descent updates the model weights step by step to lower the loss of the network during training. "
    kind = "query_id long, question string, gold string, tag string, should_deflect boolean, passages array<struct<text:string,is_relevant:boolean>>"
    rows = [
        (1, "How does gradient descent train the model network?", text, "how", False, [(text * 3, True), ("Unrelated words about cooking rice and beans. " * 4, None)]),
        (2, "How does gradient descent train the model network?", None, "", True, []),
        (3, "How does gradient descent train the model network?", "", None, False, [(text * 3, True)]),
    ]
    got = {r["query_id"]: r for r in evaluation.grounded_run(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == 3 and got[2]["deflected"] and got[2]["raf"] is None and got[2]["attribution_f1"] is None
    assert not got[1]["deflected"] and got[1]["uraf"] > 0.5 and got[1]["attribution_recall"] == 1.0
    answered = spark.createDataFrame([(r["query_id"], r["tag"], r["raf"], r["uraf"], 1.0, 1.0, r["attribution_f1"], None) for r in got.values() if not r["deflected"]],
        "query_id long, tag string, raf double, uraf double, attribution_precision double, attribution_recall double, attribution_f1 double, latency_ms double")
    told = {r["tag"]: r["n"] for r in runs.grounded_summary(answered).collect()}
    assert told[None] == len([r for r in got.values() if not r["deflected"]]) and told["how"] == 1


def test_annotated_run_measures_what_it_wrote(spark):
    source = "Transformers use attention layers to weigh the tokens of a sequence against each other in every model layer. " * 3
    kind = "query_id long, prompt string, source_info string, spans array<struct<text:string,type:string>>"
    rows = [(1, "How do transformers use attention layers in the model?", source, []), (2, "How do transformers use attention layers in the model?", None, [("made up words", "Evident Conflict")])]
    got = {r["query_id"]: r for r in evaluation.annotated_run(spark.createDataFrame(rows, kind)).collect()}
    assert not got[1]["gold"] and not got[1]["predicted"] and got[1]["span_f1"] == 1.0
    assert got[2]["gold"] and not got[2]["predicted"] and got[2]["span_f1"] == 0.0
    frame = spark.createDataFrame([(r["gold"], r["predicted"], r["span_f1"], 5.0) for r in got.values()], "gold boolean, predicted boolean, span_f1 double, latency_ms double")
    told = runs.annotated_summary(frame).first()
    assert told["total"] == 2 and told["gold_rate"] == 0.5 and told["predicted_rate"] == 0.0 and told["mean_span_f1"] == 0.5 and told["avg_latency_ms"] == 5.0
