"""The recursive text splitter in columns and windows: cut at the coarsest separator present, pack to size with overlap.

Cutting is one array expression per separator, so a text stays one row until all its pieces are known. Pieces
are then rows, and packing needs no loop over them: where a chunk that begins at a piece ends, and where the
chunk behind a cut begins, are range frames over the pieces' offsets. Following those two from the first
piece gives the chunks; that walk takes one step a chunk. Everything is grouped by text, so the largest unit of
work is one text, sorted by Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import vocab as V
from quarrylight.functions.splitting import EQUATIONS
from quarrylight.functions.text import once

EQUATION = "(?s)" + "|".join(EQUATIONS)
#: A piece may still be cut, may be packed with its neighbours, or is a chunk of its own.
OPEN, SMALL, DONE = range(3)
WHITE = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def quoted(literal: str) -> str:
    """A separator as a pattern that matches just it."""
    return re.escape(literal)


def pieces_at(body: Column, separator: str) -> Column:
    """Non-empty pieces of a text; a separator stays at the start of the piece behind it."""
    parts = F.split(body, quoted(separator), -1)
    return F.filter(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))), lambda p: F.length(p) > 0)


def cut_by_size(body: Column, size: int, overlap: int) -> Column:
    """Runs of ``size`` characters that begin ``size - overlap`` apart, the last one as short as it is."""
    count = F.greatest(F.ceil((F.length(body) - size) / (size - overlap)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(body, i * (size - overlap) + 1, F.lit(size)))


def atoms(text: Column, size: int, overlap: int, separators: list[str]) -> Column:
    """``array<struct<body, parent, kind>>``: the pieces of a text in order; neighbours with one parent are packed together."""
    state = F.array(F.struct(text.alias("body"), F.lit("").alias("parent"), F.lit(OPEN).alias("kind")))
    for level, separator in enumerate(separators):
        state = F.flatten(F.transform(state, cutter(level, separator, level + 1 == len(separators), size, overlap)))
    return state


def cutter(level: int, separator: str, last: bool, size: int, overlap: int):
    """What one separator makes of a piece: a long piece that holds it is cut, any other stays as it is."""

    def kind(p: Column) -> Column:
        return F.when(F.length(p) <= size, SMALL).otherwise(DONE if last else OPEN)

    def cut(x: Column, i: Column) -> Column:
        parent = F.concat(F.lit(f"{level}:"), i.cast("string")).alias("parent")
        if separator:
            made = F.transform(pieces_at(x["body"], separator), lambda p: F.struct(p.alias("body"), parent, kind(p).alias("kind")))
        else:
            runs = F.filter(F.transform(cut_by_size(x["body"], size, overlap), stripped), lambda p: F.length(p) > 0)
            made = F.transform(runs, lambda p: F.struct(p.alias("body"), parent, F.lit(DONE).alias("kind")))
        here = F.lit(True) if last or not separator else F.contains(x["body"], F.lit(separator))
        return F.when((x["kind"] == OPEN) & here, made).otherwise(F.array(x))

    return cut


def packed_rows(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """``_row, _at, _nth, _head, chunk`` from the rows ``_row, _at, body, parent, kind`` of texts' pieces; a text's ``_head`` comes with its first."""
    text = Window.partitionBy("_row").orderBy("_at")
    apart = (F.col("kind") == DONE) | (F.lag("kind").over(text) == DONE) | (F.lag("parent").over(text) != F.col("parent"))
    rows = rows.withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(text)).withColumn("len", F.length("body").cast("bigint"))
    whole = Window.partitionBy("_row", "run")
    placed = rows.withColumns({"idx": F.row_number().over(whole.orderBy("_at")) - 1, "end": F.sum("len").over(whole.orderBy("_at")), "n": F.count("*").over(whole), "total": F.sum("len").over(whole)})
    placed = placed.withColumn("start", F.col("end") - F.col("len"))
    by_start, by_end = whole.orderBy("start"), whole.orderBy("end")
    fits = F.max("idx").over(by_start.rangeBetween(0, size))
    repeats = F.min("idx").over(by_start.rangeBetween(-overlap, 0))
    room = F.min("idx").over(by_end.rangeBetween(-size, 0)) + 1
    placed = placed.withColumns(
        {
            # The piece a chunk that begins here no longer takes, and where the chunk begins whose first new piece this is.
            "until": F.when(F.col("total") <= F.col("start") + size, F.col("n")).otherwise(fits).cast("int"),
            "from": F.greatest(repeats, F.when(F.col("end") <= size, 0).otherwise(room)).cast("int"),
        }
    )
    runs = placed.groupBy("_row", "run").agg(
        F.min("_at").alias("_at"), F.max("kind").alias("kind"), F.first("_head", ignorenulls=True).alias("_head"), F.sort_array(F.collect_list(F.struct("idx", "body", "from", "until"))).alias("p")
    )
    step = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    first = F.array(step(F.lit(0), F.get("p", F.lit(0))["until"]))

    def walk(cuts: Column, _: Column) -> Column:
        at = F.element_at(cuts, -1)["b"]
        begin = F.get("p", at)["from"]
        return F.when(at < F.size("p"), F.concat(cuts, F.array(step(begin, F.get("p", begin)["until"])))).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(1), F.size("p")), first, walk)
    joined = F.transform(cuts, lambda c: stripped(F.array_join(F.transform(F.slice("p", c["a"] + 1, c["b"] - c["a"]), lambda w: w["body"]), "")))
    chunks = F.when(F.col("kind") == DONE, F.col("p.body")).otherwise(F.filter(joined, lambda c: F.length(c) > 0))
    head = F.first("_head", ignorenulls=True).over(Window.partitionBy("_row").orderBy("_at"))
    return runs.select("_row", "_at", head.alias("_head"), chunks.alias("c")).select("_row", "_at", "_head", F.posexplode_outer("c").alias("_nth", "chunk")).where("chunk IS NOT NULL")


def hidden(text: Column, equations: Column) -> Column:
    """The text with a short token for every display equation."""
    parts = F.split(text, EQUATION, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(equations), F.concat(p, F.format_string("__EQ_%04d__", i))).otherwise(p)), "")


def restored(chunk: Column, equations: Column) -> Column:
    tokens = F.array_distinct(F.regexp_extract_all(chunk, F.lit(r"__EQ_(\d{4,})__"), 1))

    def put(c: Column, token: Column) -> Column:
        return F.coalesce(F.replace(c, F.concat(F.lit("__EQ_"), token, F.lit("__")), F.get(equations, token.try_cast("int"))), c)

    return F.when(F.size(equations) > 0, F.aggregate(tokens, chunk, put)).otherwise(chunk)


def recursive_chunks(
    texts: DataFrame, text: str, size: int = V.CHUNK_CHARS, overlap: int = V.CHUNK_OVERLAP_CHARS,
    separators: list[str] = V.CHUNK_SEPARATORS, whole_equations: bool = True,
) -> DataFrame:
    """Rows of ``texts`` with ``ord, chunk`` in place of the text, one per chunk; other columns stay.

    Chunks have at most ``size`` characters and repeat up to ``overlap`` of the one before. With ``whole_equations`` a
    display equation counts as one short token and is never cut. Null, empty and blank texts have no chunks; repeated
    rows are texts of their own.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > overlap >= 0")
    rest = [c for c in texts.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(body, F.lit(EQUATION), 0) if whole_equations else F.array().cast("array<string>")
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.struct(found.alias("_eqs"), *rest).alias("_head"), body.alias("_body"))
    cut = atoms(once(F.col("_head._eqs"), lambda eqs: hidden(F.col("_body"), eqs)) if whole_equations else F.col("_body"), size, overlap, separators)
    pieces = rows.select("_row", "_head", F.posexplode_outer(cut).alias("_at", "a")).where("_at IS NOT NULL")
    chunks = packed_rows(pieces.select("_row", "_at", F.when(F.col("_at") == 0, F.col("_head")).alias("_head"), "a.body", "a.parent", "a.kind"), size, overlap)
    order = F.row_number().over(Window.partitionBy("_row").orderBy("_at", "_nth")) - 1
    return chunks.select(*(F.col(f"_head.{c}") for c in rest), order.alias("ord"), restored(F.col("chunk"), F.col("_head._eqs")).alias("chunk"))
