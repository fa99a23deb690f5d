"""The splitter in columns against the plain recursive form."""

import random

import pytest

from quarrylight.functions import splitting as S
from quarrylight.functions import vocab as V
from quarrylight.operators import packing


def texts():
    draw = random.Random(4)
    out = ["", "   \n ", "word", None, "a" * 205, "é" * 130 + " " + "ü" * 33, "x. y; z, w " * 30, "\n\nlead\n\n\n\ntail\n", " " * 90, "𝒳" * 95, "ab\r\ncd " * 40, "x" * 40, "x" * 41 + " y"]
    for _ in range(60):
        words = ["a" * draw.choice([1, 2, 5, 9, 30, 70]) for _ in range(draw.randrange(1, 80))]
        out.append("".join(w + draw.choice([" ", " ", " ", ". ", ", ", "; ", "\n", "\n\n", ""]) for w in words))
    return out


def chunked(spark, rows, size, overlap, **options):
    frame = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(rows)], "id long, text string, ord string").repartition(3)
    got = {i: [] for i in range(len(rows))}
    out = packing.recursive_chunks(frame.drop("ord"), "text", size, overlap, **options)
    for r in sorted(out.collect(), key=lambda r: (r["id"], r["ord"])):
        assert r["ord"] == len(got[r["id"]])
        got[r["id"]].append(r["chunk"])
    return list(got.values())


@pytest.mark.parametrize("size, overlap", [(40, 8), (40, 0), (64, 63), (1, 0), (500, 100)])
def test_chunks_equal_the_plain_form(spark, size, overlap):
    rows = texts()
    assert chunked(spark, rows, size, overlap, whole_equations=False) == [S.recursive_split(t or "", size, overlap) for t in rows]


def test_separators_without_the_empty_one_leave_long_pieces(spark):
    rows = texts()
    assert chunked(spark, rows, 30, 5, separators=["\n", " "], whole_equations=False) == [S.recursive_split(t or "", 30, 5, ["\n", " "]) for t in rows]


def test_equations_stay_whole(spark):
    rows = ["word " * 20 + "$$" + "x + y " * 30 + "$$" + " word" * 20, "a \\[ x \\] b", "no $5 here", r"\begin{align}" + "q" * 300 + r"\end{align}", "$$a$$ " * 40]
    assert chunked(spark, rows, 60, 10) == [S.split_around_equations(t, 60, 10) for t in rows]


def test_repeated_rows_and_defaults(spark):
    text = "Sentence of some words. " * 200
    assert chunked(spark, [text, text], V.CHUNK_CHARS, V.CHUNK_OVERLAP_CHARS) == [S.split_around_equations(text, V.CHUNK_CHARS, V.CHUNK_OVERLAP_CHARS)] * 2
    with pytest.raises(ValueError):
        packing.recursive_chunks(spark.createDataFrame([("x",)], "text string"), "text", 10, 10)


def test_cuts_are_computed_once(spark):
    texts = spark.createDataFrame([(1, "a b. c d")], "id long, body string")
    plan = packing.recursive_chunks(texts, "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") and "size(flatten(" not in plan
