"""Knowledge graph as tables: edge aggregation, lookup, neighbourhoods, shortest paths.

Edges are ``s_name, s_type, predicate, o_name, o_type, weight, ...`` with lower-case keys
``s_key`` and ``o_key``. Traversals work for a table of start entities at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.ranking import ranked
from quarrylight.operators.sizing import broadcast_if_small
from quarrylight.session import settle

# Limits of the graph lookups.
MAX_NEIGHBOURS, MAX_ENTITIES, MAX_NGRAM, MIN_ENTITY_CHARS = 50, 5, 4, 2
#: Rows that a task of a walk may have to hold at once.
TASK_ROWS = 1 << 18
EDGE_KEY = ["s_key", "s_type", "predicate", "o_key", "o_type"]


def clean_triples(triples: DataFrame) -> DataFrame:
    """Trimmed names, upper-case types and predicates; empty fields and self-loops are dropped."""
    named = triples.select(
        F.trim("s_name").alias("s_name"),
        F.upper(F.trim(F.coalesce("s_type", F.lit("OTHER")))).alias("s_type"),
        F.upper(F.trim("predicate")).alias("predicate"),
        F.trim("o_name").alias("o_name"),
        F.upper(F.trim(F.coalesce("o_type", F.lit("OTHER")))).alias("o_type"),
        *[c for c in triples.columns if c not in ("s_name", "s_type", "predicate", "o_name", "o_type")],
    )
    filled = (F.col("s_name") != "") & (F.col("predicate") != "") & (F.col("o_name") != "")
    return named.where(filled & (F.lower("s_name") != F.lower("o_name")))


def parse_triples(responses: DataFrame, most: int = 10) -> DataFrame:
    """Triples from model replies: JSON array, or the first ``[...]`` inside other text.

    ``responses(chunk_id, doc_id, response)``; only the first ``most`` items of a reply count,
    before validation.
    """
    item = "array<struct<subject_name:string,subject_type:string,predicate:string,object_name:string,object_type:string>>"
    strict = F.from_json("response", item)
    inner = F.from_json(F.regexp_extract("response", r"(?s)\[.*\]", 0), item)
    usable = F.when(F.rlike(F.trim("response"), F.lit(r"(?s)^\[.*\]$")), strict).otherwise(inner)
    rows = responses.select("chunk_id", "doc_id", F.explode(F.slice(usable, 1, most)).alias("t"))
    named = rows.select(
        F.col("t.subject_name").alias("s_name"),
        F.col("t.subject_type").alias("s_type"),
        F.col("t.predicate").alias("predicate"),
        F.col("t.object_name").alias("o_name"),
        F.col("t.object_type").alias("o_type"),
        "chunk_id",
        "doc_id",
        F.lit(1.0).alias("confidence"),
    )
    return clean_triples(named)


def edges_of(triples: DataFrame, chunk: str = "chunk_id", doc: str = "doc_id") -> DataFrame:
    """Edge table: occurrences, distinct chunks and documents, summed confidence.

    Provenance is counted, not listed: a frequent edge may come from a third of all documents.
    ``provenance`` gives the lists as rows. Display names are the first in sort order.
    """
    return edges_from(evidence(triples, chunk, doc))


def evidence(triples: DataFrame, chunk: str = "chunk_id", doc: str = "doc_id") -> DataFrame:
    """One row per edge, document and chunk that states it, with how often and how surely."""
    keyed = triples.withColumn("s_key", F.lower("s_name")).withColumn("o_key", F.lower("o_name"))
    return keyed.groupBy(*EDGE_KEY, F.col(doc).alias("doc_id"), F.col(chunk).alias("chunk_id")).agg(
        F.min("s_name").alias("s_name"), F.min("o_name").alias("o_name"), F.count("*").alias("weight"), F.sum("confidence").alias("confidence_sum")
    )


def edges_from(rows: DataFrame) -> DataFrame:
    """Edges counted from their evidence: by document first, so a frequent edge is small before it meets.

    A chunk is part of one document, so chunks add up over documents.
    """
    names = [F.min("s_name").alias("s_name"), F.min("o_name").alias("o_name")]
    sums = [F.sum("weight").alias("weight"), F.sum("confidence_sum").alias("confidence_sum")]
    by_doc = rows.groupBy(*EDGE_KEY, "doc_id").agg(*names, *sums, F.count_distinct("chunk_id").alias("n_chunks"))
    found = by_doc.groupBy(*EDGE_KEY).agg(*names, *sums, F.sum("n_chunks").alias("n_chunks"), F.count("*").alias("n_docs"))
    return found.select(*EDGE_KEY, "s_name", "o_name", "weight", "n_chunks", "n_docs", "confidence_sum")


def weighted_edges(triples: DataFrame) -> DataFrame:
    """Edges with how often they are stated and no counts of who states them: what lookups and walks read.

    One aggregation with partial sums per task, however many chunks state an edge.
    """
    keyed = triples.withColumn("s_key", F.lower("s_name")).withColumn("o_key", F.lower("o_name"))
    found = keyed.groupBy(*EDGE_KEY).agg(F.min("s_name").alias("s_name"), F.min("o_name").alias("o_name"), F.count("*").alias("weight"))
    return found.select(*EDGE_KEY, "s_name", "o_name", "weight")


def provenance(triples: DataFrame, doc: str = "doc_id") -> DataFrame:
    keyed = triples.select(F.lower("s_name").alias("s_key"), "s_type", "predicate", F.lower("o_name").alias("o_key"), "o_type", doc)
    return keyed.distinct()


def merge_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add a batch of evidence to what is stored: the same edge in the same chunk is one row.

    Occurrences and confidences add up. Counts of documents and chunks come from ``edges_from``
    afterwards, so batches may share documents.
    """
    rows = existing.unionByName(new)
    return rows.groupBy(*EDGE_KEY, "doc_id", "chunk_id").agg(
        F.min("s_name").alias("s_name"), F.min("o_name").alias("o_name"), F.sum("weight").alias("weight"), F.sum("confidence_sum").alias("confidence_sum")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("s_key").alias("key"), F.col("s_type").alias("entity_type"), F.col("s_name").alias("name")).unionByName(
        edges.select(F.col("o_key").alias("key"), F.col("o_type").alias("entity_type"), F.col("o_name").alias("name"))
    )
    return ends.groupBy("key", "entity_type").agg(F.min("name").alias("name"))


def entity_index(nodes: DataFrame) -> DataFrame:
    """One row per name; a name of several types keeps the first type in sort order."""
    best = nodes.groupBy("key").agg(F.min(F.struct("entity_type", "name")).alias("e"))
    return best.select("key", "e.name", "e.entity_type")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends: ``key, neighbour, neighbour_type, predicate, weight, direction``."""
    out = edges.select(
        F.col("s_key").alias("key"), F.col("o_key").alias("neighbour"), F.col("o_type").alias("neighbour_type"),
        "predicate", "weight", F.lit("out").alias("direction"),
    )
    back = edges.select(
        F.col("o_key").alias("key"), F.col("s_key").alias("neighbour"), F.col("s_type").alias("neighbour_type"),
        "predicate", "weight", F.lit("in").alias("direction"),
    )
    return out.unionByName(back)


def neighbours(starts: DataFrame, edges: DataFrame, limit: int = MAX_NEIGHBOURS) -> DataFrame:
    """Direct neighbours of every start entity (``key``), heaviest edges first."""
    seen = both_ways(edges).join(broadcast_if_small(starts.select("key").distinct(), starts), "key", "left_semi")
    order = [F.col("weight").desc(), F.col("neighbour"), F.col("predicate"), F.col("direction")]
    return ranked(seen, "key", order, "place").where(F.col("place") <= limit)


def neighbours_two_hops(starts: DataFrame, edges: DataFrame, limit: int = MAX_NEIGHBOURS) -> DataFrame:
    """Edges on paths of one or two steps, by the entity the path ends in; nearest first.

    Rows are distinct ``(key, neighbour, predicate, weight, hops)``. With self-loops gone and the
    end different from the start, a two-step path cannot use an edge twice, so paths need not be
    enumerated: every edge meets *distinct* adjacent entities, on either side of the middle node.

    A hub is not paired with everything around it. Only the first ``limit`` rows of a start are
    asked for, so a middle node passes on its ``limit`` heaviest edges (plus as many as may lead
    straight back to the start) and its ``limit + 1`` first neighbours by name; nothing beyond
    those can be among the answers.
    """
    view = both_ways(edges).select("key", "neighbour", "predicate", "weight").distinct()
    first = view.join(broadcast_if_small(starts.select("key").distinct(), starts), "key", "left_semi")
    one = first.withColumn("hops", F.lit(1))
    parallel = view.groupBy("key", "neighbour").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    heaviest = [F.col("weight").desc(), F.col("neighbour"), F.col("predicate")]
    step = ranked(view, "key", heaviest, "nth").where(F.col("nth") <= limit + int(parallel))
    step = step.select(F.col("key").alias("mid"), F.col("neighbour").alias("end"), "predicate", "weight")
    reach = first.select("key", F.col("neighbour").alias("mid")).distinct()
    last_edge = reach.join(step, "mid").select("key", F.col("end").alias("neighbour"), "predicate", "weight")
    around = ranked(view.select("key", "neighbour").distinct(), "key", [F.col("neighbour")], "nth").where(F.col("nth") <= limit + 1)
    onward = around.select(F.col("key").alias("mid"), F.col("neighbour").alias("end"))
    first_edge = (
        first.withColumnRenamed("neighbour", "mid").join(onward, "mid").select("key", F.col("end").alias("neighbour"), "predicate", "weight")
    )
    two = last_edge.unionByName(first_edge).where(F.col("key") != F.col("neighbour")).withColumn("hops", F.lit(2))
    rows = one.unionByName(two).distinct()
    order = [F.col("hops"), F.col("weight").desc(), F.col("neighbour"), F.col("predicate")]
    return ranked(rows, "key", order, "place").where(F.col("place") <= limit)


def typed_view(edges: DataFrame) -> DataFrame:
    """Every edge from both ends, nodes told apart by name and type: ``node, node_type, neighbour, neighbour_type, predicate, weight, edge``."""
    edge = F.to_json(F.array(*EDGE_KEY)).alias("edge")
    ends = [("s_key", "s_type", "o_key", "o_type"), ("o_key", "o_type", "s_key", "s_type")]
    sides = [
        edges.select(F.col(a).alias("node"), F.col(b).alias("node_type"), F.col(c).alias("neighbour"), F.col(d).alias("neighbour_type"), "predicate", F.col("weight").cast("bigint").alias("weight"), edge)
        for a, b, c, d in ends
    ]
    return sides[0].unionByName(sides[1])


def neighbours_n_hops(starts: DataFrame, edges: DataFrame, hops: int, limit: int = MAX_NEIGHBOURS) -> DataFrame:
    """Entities within ``hops`` steps of every start name (``key``), with every edge of the ways there, nearest first.

    Rows are distinct ``(key, neighbour, neighbour_type, predicate, weight, hops)`` over all ways of each length that use
    no edge twice and end elsewhere than they began; the first ``limit`` by hops, falling weight, name, type and predicate stay.

    One frontier for all starts grows a step per round. Levels come first in the order, so a start that has ``limit`` rows
    is finished, and one that hasn't has few ways: ways are never enumerated around what is full. A node passes on
    its heaviest edges and those to its first neighbours by name, as many as ``limit`` rows can need after the edges
    already walked and those back to the start are set aside; only a level that fills its start is cut by that, and such
    a level isn't walked on from. So a hub costs its bounded list, and the rows are exact. Adaptive execution sees only the
    few bytes of the ways before a step, so the tasks behind it are counted.
    """
    view = settle(typed_view(edges), "typed-view")
    at = ["node", "node_type"]
    same = view.groupBy(*at, "neighbour", "neighbour_type").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    by_weight = Window.partitionBy(*at).orderBy(F.col("weight").desc(), "neighbour", "neighbour_type", "predicate")
    by_name = Window.partitionBy(*at).orderBy("neighbour", "neighbour_type")
    heavy = view.withColumn("nth", F.dense_rank().over(by_weight)).where(F.col("nth") <= limit + hops + int(same)).drop("nth")
    first = view.withColumn("nth", F.dense_rank().over(by_name)).where(F.col("nth") <= limit + hops + 1).drop("nth")
    steps = settle(heavy.unionByName(first).distinct().withColumnsRenamed({"node": "end", "node_type": "end_type"}), "steps")
    steps = steps.withColumn("step", F.struct("edge", "predicate", "weight")).select("end", "end_type", "neighbour", "neighbour_type", "step")
    outs = settle(steps.groupBy("end", "end_type").agg(F.count("*").alias("n_out")), "outs")
    keys = starts.select("key").distinct()
    began = view.select(*at).distinct().join(keys.withColumnRenamed("key", "node"), "node", "left_semi")
    kind = steps.schema["step"].dataType.simpleString()
    ways = settle(began.select(F.col("node").alias("key"), F.col("node_type").alias("key_type"), F.col("node").alias("end"), F.col("node_type").alias("end_type"), F.array().cast(f"array<{kind}>").alias("way")), "ways")
    order = [F.col("weight").desc(), F.col("neighbour"), F.col("neighbour_type"), F.col("predicate")]
    found, told_rows = None, 0
    for n in range(1, hops + 1):
        grown, tasks = _grown(ways, steps, outs, n)
        grown = grown.repartition(tasks, "key").persist()
        elsewhere = grown.where((F.col("end") != F.col("key")) | (F.col("end_type") != F.col("key_type")))
        told = elsewhere.select("key", F.col("end").alias("neighbour"), F.col("end_type").alias("neighbour_type"), F.explode("way").alias("w"))
        told = told.select("key", "neighbour", "neighbour_type", "w.predicate", "w.weight").distinct()
        level = settle(ranked(told, "key", order, "place").where(F.col("place") <= limit).drop("place").withColumn("hops", F.lit(n)), "found")
        told_rows += level.count()
        found = level if found is None else found.unionByName(level)
        if n < hops:
            full = found.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= limit)
            ways = settle(grown.join(full, "key", "left_anti"), "ways")
        grown.unpersist()
        if n < hops and ways.isEmpty():
            break
    dealt = found.repartition(1 + told_rows // TASK_ROWS, "key")
    return ranked(dealt, "key", [F.col("hops"), *order], "place").where(F.col("place") <= limit)


def _grown(ways: DataFrame, steps: DataFrame, outs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The ways a step longer, no edge twice, and the tasks that their ``n`` rows each are dealt to.

    Many starts meet in a hub, so the ways that end there are dealt to as many copies of its steps as keep a task bounded.
    """
    at = ["end", "end_type"]
    met = settle(ways.groupBy(*at).agg(F.count("*").alias("n_ways")).join(outs, at), "met")
    tasks = 1 + n * int(met.agg(F.sum(F.col("n_ways") * F.col("n_out"))).first()[0] or 0) // TASK_ROWS
    copies = met.select(*at, F.ceil(F.col("n_ways") * F.col("n_out") * n / TASK_ROWS).alias("copies"))
    salted = ways.join(copies, at).withColumn("salt", F.pmod(F.xxhash64("key", "way"), F.col("copies"))).drop("copies")
    copied = steps.join(copies, at).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    met_at = [*at, "salt"]
    fresh = ~F.exists("way", lambda w: w["edge"] == F.col("step.edge"))
    grown = salted.repartition(tasks, *met_at).join(copied.repartition(tasks, *met_at).hint("merge"), met_at).where(fresh)
    return grown.select("key", "key_type", F.col("neighbour").alias("end"), F.col("neighbour_type").alias("end_type"), F.concat("way", F.array("step")).alias("way")), tasks


def shortest_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 4) -> DataFrame:
    """Undirected unweighted shortest path of every ``(source, target)`` pair: ``hops, path``.

    Breadth-first search for all pairs at once, from both ends: a round takes the sources and the targets of all open
    pairs a step further in one pass over the links, and a pair is done when its two sides meet. So a side goes
    half of the way only, and what it sees follows the links around the ends and not the size of the graph.

    Of equally short paths the one whose entities, read back from the target, come first stays. A side keeps one row per
    end and entity with its first way there: a source's goes over the alphabetically first predecessor, a target's is the
    first as a whole, so the first way of a target to a middle entity and the way of the source to it are the path.
    """
    links = settle(edges.select(F.col("s_key").alias("node"), F.col("o_key").alias("next")).where("node <> next"), "links")
    links = links.unionByName(links.select(F.col("next").alias("node"), F.col("node").alias("next")))
    left = settle(pairs.select("source", "target").distinct(), "open")
    ends = [left.select(F.lit(c == "source").alias("forward"), F.col(c).alias("origin"), F.col(c).alias("node"), F.array(c).alias("way")) for c in ("source", "target")]
    level = settle(ends[0].unionByName(ends[1]).distinct(), "level")
    before, found = level.limit(0), [settle(_meeting(left, level, level, 0), "found")]
    for hops in range(1, max_hops + 1, 2):
        left = settle(left.join(found[-1], ["source", "target"], "left_anti"), "open")
        far = left.select(F.lit(True).alias("forward"), F.col("source").alias("origin"))
        if hops < max_hops:
            far = far.unionByName(left.select(F.lit(False).alias("forward"), F.col("target").alias("origin")))
        nxt = settle(_stepped(level.join(far.distinct(), ["forward", "origin"], "left_semi"), links, before.unionByName(level)), "level")
        if nxt.isEmpty():
            break
        found.append(settle(_meeting(left, nxt, level, hops), "found"))
        if hops < max_hops:
            left = settle(left.join(found[-1], ["source", "target"], "left_anti"), "open")
            found.append(settle(_meeting(left, nxt, nxt, hops + 1), "found"))
        before, level = level, nxt
    answers = found[0]
    for part in found[1:]:
        answers = answers.unionByName(part)
    return pairs.join(answers, ["source", "target"]).select("source", "target", "hops", "path")


def _stepped(front: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    """The entities a step behind a level, which no end has ``seen``, with the first way there."""
    front = settle(front, "front")
    steps = links.join(broadcast_if_small(front), "node")
    order = F.when(F.col("forward"), F.array("node")).otherwise(F.col("way"))
    first = steps.groupBy("forward", "origin", F.col("next").alias("found")).agg(F.min(F.struct(order.alias("order"), "way")).alias("first"))
    fresh = first.withColumnRenamed("found", "node").join(seen.select("forward", "origin", "node"), ["forward", "origin", "node"], "left_anti")
    return fresh.select("forward", "origin", "node", F.concat("first.way", F.array("node")).alias("way"))


def _meeting(left: DataFrame, sources: DataFrame, targets: DataFrame, hops: int) -> DataFrame:
    """The pairs whose levels share an entity: ``source, target, hops, path``."""
    there = sources.where("forward").select(F.col("origin").alias("source"), "node", F.col("way").alias("there"))
    back = targets.where("NOT forward").select(F.col("origin").alias("target"), "node", F.col("way").alias("back"))
    met = left.join(there, "source").join(back, ["target", "node"]).groupBy("source", "target").agg(F.min(F.struct("back", "there")).alias("m"))
    path = F.concat("m.there", F.reverse(F.slice("m.back", F.lit(1), F.size("m.back") - 1)))
    return met.select("source", "target", F.lit(hops).alias("hops"), path.alias("path"))


def entity_triples(names: DataFrame, edges: DataFrame, limit: int = MAX_NEIGHBOURS) -> DataFrame:
    """Edges with a wanted entity (``key``) at either end, heaviest first."""
    wanted = broadcast_if_small(names.select("key").distinct(), names)
    columns = ["key", *EDGE_KEY, "s_name", "o_name", "weight"]
    subject = edges.withColumn("key", F.col("s_key")).join(wanted, "key").select(*columns)
    other = edges.where(F.col("s_key") != F.col("o_key")).withColumn("key", F.col("o_key")).join(wanted, "key").select(*columns)
    order = [F.col("weight").desc(), *[F.col(c) for c in EDGE_KEY]]
    return ranked(subject.unionByName(other), "key", order, "place").where(F.col("place") <= limit)


def fact_line() -> Column:
    verb = F.lower(F.replace(F.col("predicate"), F.lit("_"), F.lit(" ")))
    return F.format_string("%s (%s) %s %s (%s)", "s_name", "s_type", verb, "o_name", "o_type")


def match_entities(queries: DataFrame, index: DataFrame, most: int = MAX_ENTITIES) -> DataFrame:
    """Known entity names among the 1- to 4-word runs of a question, longer runs first.

    Returns ``query_id, key, name, entity_type, place``; at most ``most`` per question, each once.
    """
    plain = F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}_\s\-.]", " ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 0)
    split = queries.select("query_id", words.alias("words"))
    runs = None
    for n in range(MAX_NGRAM, 0, -1):
        starts = F.sequence(F.lit(1), F.size("words") - (n - 1))
        at = split.where(F.size("words") >= n).select(
            "query_id", F.lit(n).alias("n"), "words", F.explode(starts).alias("i")
        )
        part = at.select("query_id", "n", "i", F.array_join(F.slice("words", F.col("i"), F.lit(n)), " ").alias("key"))
        runs = part if runs is None else runs.unionByName(part)
    known = runs.where(F.length("key") >= MIN_ENTITY_CHARS).join(broadcast_if_small(index, index), "key")
    first = known.groupBy("query_id", "key", "name", "entity_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "i")).alias("at"))
    return ranked(first, "query_id", [F.col("at")], "place").where(F.col("place") <= most).drop("at")


def graph_context(queries: DataFrame, edges: DataFrame, summaries: DataFrame | None = None, min_weight: int = 1) -> DataFrame:
    """One text per question: facts about its entities (and summaries of their communities).

    ``summaries(key, summary)``. Entities, facts per entity and so the text are bounded.
    """
    from quarrylight.operators.answers import in_order

    matched = match_entities(queries, entity_index(nodes_of(edges)))
    heads = matched.groupBy("query_id").agg(F.array_join(in_order("place", "name"), ", ").alias("names"), F.count("*").alias("n_entities"))
    facts = entity_triples(matched.select("key"), edges).where(F.col("weight") >= min_weight)
    lines = matched.select("query_id", "key", F.col("place").alias("entity_place")).join(
        facts.select("key", "place", fact_line().alias("fact")), "key"
    )
    first = lines.groupBy("query_id", "fact").agg(F.min(F.struct("entity_place", "place")).alias("at"))
    body = first.groupBy("query_id").agg(
        F.array_join(F.transform(in_order("at", "fact"), lambda f: F.concat(F.lit("- "), f)), "\n").alias("facts"),
        F.count("*").alias("n_facts"),
    )
    out = heads.join(body, "query_id")
    text = F.concat(F.lit("Knowledge graph facts about: "), F.col("names"), F.lit("\n\n"))
    if summaries is not None:
        told = matched.join(summaries, "key").groupBy("query_id", "summary").agg(F.min("place").alias("place"))
        context = told.groupBy("query_id").agg(
            F.concat(
                F.array_join(F.transform(in_order("place", "summary"), lambda s: F.concat(F.lit("Research context: "), s)), "\n"),
                F.lit("\n\n"),
            ).alias("context")
        )
        out = out.join(context, "query_id", "left")
        text = F.concat(text, F.coalesce("context", F.lit("")))
    return out.select("query_id", "n_entities", "n_facts", F.concat(text, F.col("facts")).alias("text"))


def expand_queries(queries: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """Append up to ``most`` neighbour names that the question does not mention yet."""
    from quarrylight.operators.answers import in_order

    index = entity_index(nodes_of(edges))
    matched = match_entities(queries, index)
    near = neighbours(matched.select("key"), edges).select("key", "neighbour")
    named = matched.select("query_id", "key").join(near, "key").join(
        index.select(F.col("key").alias("neighbour"), F.col("name").alias("other")), "neighbour"
    )
    fresh = named.join(queries, "query_id").where(~F.contains(F.lower("question"), F.lower("other")))
    names = ranked(fresh.select("query_id", "other").distinct(), "query_id", [F.col("other")], "place").where(F.col("place") <= most)
    hint = names.groupBy("query_id").agg(F.array_join(in_order("place", "other"), " ").alias("hint"))
    extended = F.concat("question", F.lit(" [Related: "), "hint", F.lit("]"))
    return queries.join(hint, "query_id", "left").select(
        "query_id", F.when(F.col("hint").isNotNull(), extended).otherwise(F.col("question")).alias("question")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """``u, v, weight, predicate`` per unordered pair; weights add up, the first predicate stays."""
    pairs = edges.select(F.least("s_key", "o_key").alias("u"), F.greatest("s_key", "o_key").alias("v"), "predicate", "weight")
    # The first of strings is told by sorting, and names often begin alike, so a number leads the keys.
    return pairs.where(F.col("u") != F.col("v")).groupBy(F.xxhash64("u", "v").alias("pair"), "u", "v").agg(
        F.sum("weight").alias("weight"), F.min("predicate").alias("predicate")
    ).drop("pair")


def stats(edges: DataFrame) -> DataFrame:
    """``kind, name, n`` rows: node and edge totals, nodes per type, the 20 commonest predicates."""
    nodes = nodes_of(edges)
    preds = edges.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "predicate").limit(20)
    parts = [
        nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.lit("").alias("name"), "n"),
        edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), F.lit("").alias("name"), "n"),
        nodes.groupBy("entity_type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("entity_type").alias("name"), "n"),
        preds.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"), "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
