"""Ingest runs: what they redo, what they take up again, what readers see."""

import pytest
from pyspark.sql import functions as F

from quarrylight.plans import ingest


def papers(spark, rows):
    return spark.createDataFrame([(k, t, None, "x") for k, t in rows], "id long, text string, year int, run_note string")


def words(rows):
    return rows.select("id", F.explode(F.split("text", " ")).alias("word"))


def state(spark, folder):
    return sorted((r["id"], r["word"]) for r in ingest.current(spark, folder, "words", "id").collect())


def told(report):
    return {r["step"]: (r["run"], r["n_papers"], r["n_rows"], r["reused"]) for r in report.collect()}


def test_only_changed_papers_are_redone(spark, tmp_path):
    folder, seen = str(tmp_path), []

    def counted(rows):
        seen.append(sorted(r["id"] for r in rows.select("id").collect()))
        return words(rows)

    stages = [("words", counted)]
    first = told(ingest.ingest(papers(spark, [(1, "a b"), (2, "c"), (3, None), (None, "q")]), folder, "id", stages))
    assert first == {"plan": (0, 3, 3, False), "gone": (0, 0, 0, False), "words": (0, 2, 3, False)}
    second = told(ingest.ingest(papers(spark, [(1, "a b"), (2, "c d"), (4, "e")]), folder, "id", stages))
    assert second == {"plan": (1, 2, 3, False), "gone": (1, 1, 0, False), "words": (1, 2, 3, False)}
    assert seen == [[1, 2, 3], [2, 4]]
    assert state(spark, folder) == [(1, "a"), (1, "b"), (2, "c"), (2, "d"), (4, "e")]
    third = told(ingest.ingest(papers(spark, [(1, "a b"), (2, "c d"), (4, "e")]), folder, "id", stages))
    assert third["plan"] == (2, 0, 3, False) and seen[2] == []
    ingest.ingest(papers(spark, [(3, "back"), (3, "back")]), folder, "id", stages)
    assert state(spark, folder) == [(3, "back")]


def test_an_ended_run_is_taken_up(spark, tmp_path):
    folder, calls = str(tmp_path), []

    def upper(rows):
        calls.append("upper")
        return rows.withColumn("text", F.upper("text"))

    def broken(rows):
        raise RuntimeError("executor lost")

    rows = papers(spark, [(1, "a b"), (2, "c")])
    with pytest.raises(RuntimeError):
        ingest.ingest(rows, folder, "id", [("upper", upper), ("words", broken)])
    assert ingest.current(spark, folder, "upper", "id") is None
    report = told(ingest.ingest(rows, folder, "id", [("upper", upper), ("words", words)]))
    assert calls == ["upper"] and report["plan"][3] and report["upper"][3] and not report["words"][3]
    assert state(spark, folder) == [(1, "A"), (1, "B"), (2, "C")]


def test_an_ended_run_with_other_papers_starts_anew(spark, tmp_path):
    folder, calls = str(tmp_path), []

    def upper(rows):
        calls.append("upper")
        return rows.withColumn("text", F.upper("text"))

    def broken(rows):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        ingest.ingest(papers(spark, [(1, "a b")]), folder, "id", [("upper", upper), ("words", broken)])
    ingest.ingest(papers(spark, [(1, "z")]), folder, "id", [("upper", upper), ("words", words)])
    assert calls == ["upper", "upper"] and state(spark, folder) == [(1, "Z")]


def test_an_empty_source_and_an_empty_folder(spark, tmp_path):
    assert ingest.current(spark, str(tmp_path), "words", "id") is None
    report = told(ingest.ingest(papers(spark, [(1, "a")]).limit(0), str(tmp_path), "id", [("words", words)]))
    assert report["plan"] == (0, 0, 0, False) and state(spark, str(tmp_path)) == []
