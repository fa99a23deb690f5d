"""Paper lists, contexts under a budget, stage means."""

from pyspark.sql import functions as F

from quarrylight.operators import corpus, telemetry


def test_paper_list_by_title(spark):
    rows = [(2, "p", "Zeta", 2020, "1.2", "b"), (1, "p", "Beta", None, None, "a"), (3, "q", None, 2001, "x", ""), (4, "", "no", 1, "", "s"), (5, None, "no", 1, "", "s"), (6, "r", "Alpha", 1999, "", "b"), (7, "r", "Beta", 1999, "", "b")]
    chunks = spark.createDataFrame(rows, "chunk_id int, paper_id string, title string, year int, arxiv_id string, section string")
    got = [tuple(r) for r in corpus.paper_list(chunks).collect()]
    assert got == [("r", "Alpha", 1999, "", 2, ["b"]), ("p", "Beta", 0, "", 2, ["a", "b"]), ("q", "Unknown", 2001, "x", 1, [])]


def test_context_names_five_authors_and_keeps_the_budget(spark):
    rows = [(1, 0, "abstract", "Short.", "T", [f"A{i}" for i in range(7)]), (1, 1, "related_work", "w " * 300, "T", [f"A{i}" for i in range(7)]), (2, 0, "intro", "x", "U", []), (3, 0, "intro", "y", "V", None)]
    sections = spark.createDataFrame(rows, "id int, ord int, section string, text string, title string, authors array<string>")
    whole = {r["id"]: r["context"] for r in corpus.document_context(sections, "id", "title", 10_000, "authors").collect()}
    assert whole[1].startswith("Title: T\nAuthors: A0, A1, A2, A3, A4\n\n## Abstract\nShort.\n\n## Related Work\nw w")
    assert whole[2] == "Title: U\n\n## Intro\nx" and whole[3] == "Title: V\n\n## Intro\ny"
    less = {r["id"]: r["context"] for r in corpus.document_context(sections, "id", "title", 300, "authors").collect()}
    assert less[1].endswith("w…") and len(less[1]) <= 300
    cut = {r["id"]: r["context"] for r in corpus.document_context(sections, "id", "title", 50, "authors").collect()}
    assert cut[1].endswith("\n[truncated]") and len(cut[1]) == 50 + len("\n[truncated]")
    assert corpus.context_chars(30_000) == 103_208


def test_stage_means_skip_stages_that_took_no_time(spark):
    rows = [(1, "search", 5.0), (2, "search", 0.0), (3, "search", -1.0), (4, "search", 7.0), (5, "rerank", 0.0), (6, "search", 9.0), (7, "search", None)]
    events = spark.createDataFrame(rows, "at int, stage string, ms double")
    assert [tuple(r) for r in telemetry.stage_means(events, "stage", "ms", [F.col("at").desc()], 2).collect()] == [("search", 2, 8.0)]
