import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarrylight.operators import answers as A
from quarrylight.operators import boost, communities, corpus, evaluate, faithfulness, graph, routing


def results(spark, lists):
    rows = [(q, q * 100 + i, s, i) for q, scores in lists.items() for i, s in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int")


def test_confidence_classes(spark):
    frame = results(spark, {1: [0.97, 0.5, 0.4], 2: [0.92, 0.919, 0.918], 3: [0.75, 0.2], 4: [0.3], 5: [0.96, 0.96, 0.96]})
    got = {r.query_id: (r.confidence, r.action) for r in routing.crag_confidence(frame).collect()}
    assert got == {
        1: ("correct", "pass_through"), 2: ("ambiguous", "refine_only"), 3: ("ambiguous", "refine_only"),
        4: ("incorrect", "hyde_rewrite"), 5: ("correct", "pass_through"),
    }


def test_refine_never_drops_the_best(spark):
    frame = results(spark, {1: [0.2, 0.1], 2: [0.9, 0.3, 0.29]})
    assert sorted((r.query_id, r["rank"]) for r in routing.refine(frame).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_merges(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query_id long, chunk_id long, score double")
    b = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.4), (1, 1, 0.5)], "query_id long, chunk_id long, score double")
    merged = [(r.chunk_id, r.score, r.origin) for r in routing.merge_results(a, b, 3).orderBy("rank").collect()]
    assert merged == [(2, 0.9, 1), (1, 0.5, 0), (3, 0.4, 1)]
    context = [(r.chunk_id, r.score) for r in routing.merge_context(a, b, 3).orderBy("rank").collect()]
    assert context == [(1, 0.5), (2, 0.4), (3, 0.4)]


def test_gate_reasons(spark):
    frame = results(spark, {1: [0.1], 2: [0.9, 0.8], 3: [0.9]}).withColumn("paper_id", F.lit("p"))
    asked = spark.createDataFrame(
        [(1, "what is x"), (2, "compare x and y"), (3, "what is x"), (4, "what is x")], "query_id long, question string"
    )
    got = {r.query_id: r.reason for r in routing.gate(frame, asked).collect()}
    assert got == {1: "low_score", 2: "single_source", 3: "", 4: "no_results"}


def test_focal_gate(spark):
    frame = results(spark, {1: [0.9], 2: [0.9]})
    texts = spark.createDataFrame([(101, "hardware once"), (201, "hardware and hardware, hardware")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "What specific hardware was used?"), (2, "What specific hardware was used?")], "query_id long, question string")
    assert {r.query_id: r.deflect for r in routing.focal_gate(frame, asked, texts).collect()} == {1: True, 2: False}


def test_boost_and_diversify(spark):
    rows = [(1, 1, "a", "1706.03762", 2017, 0.8), (1, 2, "b", "x", 2023, 0.9), (1, 3, "b", "y", 2022, 0.85), (1, 4, "b", "z", None, 0.1)]
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, paper_id string, paper_key string, year int, score double")
    intents = spark.createDataFrame([(1, "foundational")], "query_id long, intent string")
    out = boost.boost_results(frame, intents, boost.landmark_table(spark))
    by = {r.chunk_id: (round(r.score, 4), r["rank"]) for r in out.collect()}
    assert by[1] == (2.88, 1) and by[3] == (1.02, 2) and by[2] == (0.9, 3) and by[4] == (0.1, 4)
    one = boost.diversify(out, 3, 1)
    assert sorted(r.chunk_id for r in one.collect()) == [1, 3]
    weak = out.withColumn("rank", 5 - F.col("rank"))
    kept = boost.diversify(weak, 2, 2, boost.landmark_table(spark))
    assert {(r.place, r.chunk_id) for r in kept.collect()} == {(1, 4), (2, 1)}


def test_topic_papers(spark):
    asked = spark.createDataFrame([(1, "Explain RLHF"), (2, "latest BERT 2024"), (3, "storage")], "query_id long, question string")
    got = {}
    for r in boost.topic_papers(asked).collect():
        got.setdefault(r.query_id, set()).add(r.paper_key)
    assert got == {1: {"2203.02155", "1707.06347"}, 3: {"2005.11401"}}


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame(
        [(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4), (2, "z", 1)], "query_id long, paper string, rank int"
    )
    truth = spark.createDataFrame([(1, "b"), (1, "q")], "query_id long, paper string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rows = {r.query_id: r for r in evaluate.retrieval_metrics(ranked, truth, asked, 2).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].mrr, rows[1].hit_rate) == (0.5, 0.5, 0.5, 1.0)
    assert abs(rows[1].ndcg - (1 / 1.5849625) / (1 + 1 / 1.5849625)) < 1e-6
    assert rows[2].recall == 1.0 and rows[2].ndcg == 1.0 and rows[3].mrr == 0.0 and rows[3].should_deflect


def test_answers_and_renumbering(spark):
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id long, question string")
    src = spark.createDataFrame(
        [(1, 1, "One is long enough. Two follows. Three ends. Four is cut."), (1, 2, "tiny"), (2, 1, "short")],
        "query_id long, source_number int, text string",
    )
    got = {r.query_id: r.answer for r in A.template_answer(asked, src).collect()}
    assert got == {1: "One is long enough. Two follows. Three ends. [Source 1].", 2: A.NO_DETAIL, 3: A.NO_SOURCES}
    texts = spark.createDataFrame([(1, "a [Source 3] b [Source 1]")], "query_id long, answer string")
    three = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, source_number int")
    row = A.renumber_citations(texts, three).first()
    assert row.answer == "a [Source 2] b [Source 1]" and row.kept == [1, 3]


def test_citation_injection(spark):
    texts = spark.createDataFrame([(1, "The neural encoder maps tokens into vectors. Ok. Cited tokens vectors encoder here [Source 2].")], "query_id long, answer string")
    src = spark.createDataFrame([(1, 1, "unrelated words"), (1, 2, "encoder tokens vectors neural")], "query_id long, source_number int, text string")
    assert A.inject_citations(texts, src).first().answer.startswith("The neural encoder maps tokens into vectors [Source 2]. Ok.")


def test_faithfulness_edges(spark):
    pairs = spark.createDataFrame(
        [(1, "Completely different words appear here today.", "nothing shared at all whatsoever"), (2, "", "ctx"), (3, "Same words stay same words.", "same words stay")],
        "query_id long, answer string, context string",
    )
    got = {r.query_id: len(r.spans) for r in faithfulness.detect_unsupported(pairs).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    f1 = spark.range(1).select(*faithfulness.span_f1(F.array().cast("array<string>"), F.array(F.lit("x")))).first()
    assert tuple(f1) == (0.0, 0.0, 0.0)
    f1 = spark.range(1).select(*faithfulness.span_f1(F.array(F.lit("x y")), F.array(F.lit("x")))).first()
    assert (f1.span_precision, f1.span_recall) == (0.5, 1.0)


TRIPLES = [
    ("BERT", "model", "uses", "Attention", "method", "c1", "d1", 1.0),
    ("bert", "MODEL", "USES", "attention", "METHOD", "c2", "d1", 0.5),
    ("GPT", "MODEL", "USES", "Attention", "METHOD", "c3", "d2", 1.0),
    ("GPT", "MODEL", "EXTENDS", "gpt", "MODEL", "c3", "d2", 1.0),
    ("GPT", "MODEL", "TRAINED_ON", "Web Text", "DATASET", "c4", "d3", 1.0),
]


def edge_table(spark):
    frame = spark.createDataFrame(
        TRIPLES, "s_name string, s_type string, predicate string, o_name string, o_type string, chunk_id string, doc_id string, confidence double"
    )
    return graph.edges_of(graph.clean_triples(frame))


def test_edges_merge_case_and_drop_loops(spark):
    edges = {(r.s_key, r.predicate, r.o_key): r for r in edge_table(spark).collect()}
    assert set(edges) == {("bert", "USES", "attention"), ("gpt", "USES", "attention"), ("gpt", "TRAINED_ON", "web text")}
    row = edges[("bert", "USES", "attention")]
    assert (row.weight, row.n_chunks, row.n_docs, row.confidence_sum) == (2, 2, 1, 1.5)


def test_paths_and_neighbours(spark):
    edges = edge_table(spark)
    pairs = spark.createDataFrame([("bert", "web text"), ("bert", "bert"), ("bert", "missing")], "source string, target string")
    got = {(r.source, r.target): (r.hops, r.path) for r in graph.shortest_paths(pairs, edges).collect()}
    assert got == {("bert", "web text"): (3, ["bert", "attention", "gpt", "web text"]), ("bert", "bert"): (0, ["bert"])}
    start = spark.createDataFrame([("bert",)], "key string")
    two = {(r.neighbour, r.predicate, r.weight, r.hops) for r in graph.neighbours_two_hops(start, edges).collect()}
    assert two == {("attention", "USES", 2, 1), ("gpt", "USES", 2, 2), ("gpt", "USES", 1, 2)}


def plain_path(links, source, target, most):
    """Breadth-first search from the source, read back over the first predecessor by name."""
    via, level = {source: None}, [source]
    for _ in range(most):
        step = {}
        for node in level:
            for there in sorted(links[node]):
                if there not in via:
                    step[there] = min(step.get(there, node), node)
        via, level = via | step, sorted(step)
    if target not in via:
        return None
    path = [target]
    while via[path[-1]] is not None:
        path.append(via[path[-1]])
    return path[::-1]


def test_paths_are_those_of_a_plain_search(spark):
    draw = random.Random(7)
    names = [f"n{i:02d}" for i in range(60)]
    rows = {(draw.choice(names), draw.choice(names), p) for _ in range(75) for p in "xy"}
    links = defaultdict(set)
    for a, b, _ in rows:
        links[a].add(b)
        links[b].add(a)
    edges = spark.createDataFrame([*((a, "T", p, b, "T", 1) for a, b, p in rows), (None, "T", "x", "n00", "T", 1)], "s_key string, s_type string, predicate string, o_key string, o_type string, weight long")
    asked = [(draw.choice(names), draw.choice(names)) for _ in range(150)]
    asked += [asked[0], ("n01", None), (None, "n01"), ("off", "off"), ("off", "n01")]
    pairs = spark.createDataFrame(asked, "source string, target string")
    for most in (0, 1, 3, 4, 5):
        got = sorted((r.source, r.target, r.hops, r.path) for r in graph.shortest_paths(pairs, edges, most).collect())
        plain = [(a, b, plain_path(links, a, b, most)) for a, b in asked if a and b]
        assert got == sorted((a, b, len(p) - 1, p) for a, b, p in plain if p) and {len(p) for _, _, p in plain if p} == set(range(1, most + 2))


def test_a_path_does_not_see_what_lies_around_its_middle(spark, monkeypatch):
    rows = [("s", "a"), ("a", "b"), ("b", "c"), ("c", "t"), *(("b", f"leaf{i:03d}") for i in range(300))]
    edges = spark.createDataFrame([(a, "T", "x", b, "T", 1) for a, b in rows], "s_key string, s_type string, predicate string, o_key string, o_type string, weight long")
    pairs = spark.createDataFrame([("s", "t")], "source string, target string")
    sizes = []

    def counted(df, name, real=graph.settle):
        out = real(df, name)
        sizes.append(out.count() if name == "level" else 0)
        return out

    monkeypatch.setattr(graph, "settle", counted)
    assert [tuple(r) for r in graph.shortest_paths(pairs, edges).collect()] == [("s", "t", 4, list("sabct"))]
    assert 0 < max(sizes) < 10


def test_entity_matching_prefers_longer_runs(spark):
    edges = edge_table(spark)
    asked = spark.createDataFrame([(1, "Does GPT, trained on Web Text, use attention?")], "query_id long, question string")
    rows = graph.match_entities(asked, graph.entity_index(graph.nodes_of(edges))).orderBy("place").collect()
    assert [r.key for r in rows] == ["web text", "gpt", "attention"]
    text = graph.graph_context(asked, edges).first().text
    assert text.startswith("Knowledge graph facts about: Web Text, GPT, Attention\n\n- GPT (MODEL) trained on Web Text (DATASET)")


def test_json_triples(spark):
    replies = spark.createDataFrame(
        [
            (1, 1, '[{"subject_name": " A ", "predicate": "uses", "object_name": "B"}]'),
            (2, 2, 'Sure: [{"subject_name": "A", "predicate": "uses", "object_name": "a"}, {"subject_name": "C", "predicate": "x", "object_name": "D"}] done'),
            (3, 3, "no json"),
        ],
        "chunk_id long, doc_id long, response string",
    )
    got = {(r.chunk_id, r.s_name, r.predicate, r.o_name, r.s_type) for r in graph.parse_triples(replies).collect()}
    assert got == {(1, "A", "USES", "B", "OTHER"), (2, "C", "X", "D", "OTHER")}


def test_communities_of_two_clusters(spark):
    left = [(a, b, 1) for i, a in enumerate("abcd") for b in "abcd"[i + 1 :]]
    right = [(a, b, 1) for i, a in enumerate("wxyz") for b in "wxyz"[i + 1 :]]
    pairs = spark.createDataFrame([*left, *right, ("d", "w", 1)], "u string, v string, weight long")
    members = {r.node: r.community for r in communities.louvain(pairs).collect()}
    assert len({members[n] for n in "abcd"}) == 1 and len({members[n] for n in "wxyz"}) == 1 and members["a"] != members["w"]


def ring_of_clusters(spark):
    """Six cliques of five, each linked to the next."""
    inside = [(f"{c}{i}", f"{c}{j}", 1) for c in "abcdef" for i in range(5) for j in range(i + 1, 5)]
    across = [(f"{c}0", f"{d}1", 1) for c, d in zip("abcdef", "bcdefa", strict=True)]
    return spark.createDataFrame([*inside, *across], "u string, v string, weight long")


def test_communities_are_named_by_their_first_member(spark):
    members = {r.node: r.community for r in communities.louvain(ring_of_clusters(spark)).collect()}
    assert {n: f"{n[0]}0" for n in members} == members and len(members) == 30


def test_communities_without_broadcast(spark):
    pairs = ring_of_clusters(spark)
    links = pairs.selectExpr("xxhash64(u) a", "xxhash64(v) b", "double(weight) w").unionByName(pairs.selectExpr("xxhash64(v) a", "xxhash64(u) b", "double(weight) w"))
    (labels, q), (met, met_q) = (communities._one_level(links, 132.0, 1.0, most) for most in (1 << 20, 0))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, met.collect())) and abs(q - met_q) < 1e-9
    assert abs(communities.modularity(links, labels, 132.0, 1.0) - q) < 1e-9


def test_arrays_give_the_levels_of_joins(spark, monkeypatch):
    monkeypatch.setattr(communities, "BLOCK_LINKS", 7)
    draw = random.Random(3)
    ids = [draw.getrandbits(64) - (1 << 63) for _ in range(60)]
    # Thirds of the nodes hang together, and the first node with all; its links go over several blocks.
    rows = {(ids[0], x): 1.0 for x in ids[1:]} | {(draw.choice(ids[i::3]), draw.choice(ids[i::3])): float(draw.randint(1, 4)) for i in range(3) for _ in range(90)}
    rows = {(min(a, b), max(a, b)): w for (a, b), w in rows.items()}
    half = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "a long, b long, w double")
    links = communities._both_ways(half)
    total = links.groupBy().sum("w").first()[0]
    for most in (1, 2):
        (labels, q), (met, met_q) = (communities._one_level(communities._both_ways(half), total, 1.0, most) for most in (1 << 20, 0))
        assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, met.collect())) and abs(q - met_q) < 1e-9
        assert abs(communities.modularity(communities._both_ways(half), labels, total, 1.0) - q) < 1e-9
        merged, other = (sorted(map(tuple, communities._merged(half, labels, most).collect())) for most in (1 << 20, 0))
        assert merged == other and sum(w * (1 + (a != b)) for a, b, w in merged) == total
        assert 1 < len({r.label for r in labels.collect()}) < len(ids)
        half = spark.createDataFrame(merged, "a long, b long, w double")


def test_rounds_of_a_level_write_no_tables(spark, monkeypatch):
    written, levels = [], []
    settle, one_level = communities.settle, communities._one_level
    monkeypatch.setattr(communities, "settle", lambda df, name: written.append(name) or settle(df, name))
    monkeypatch.setattr(communities, "_one_level", lambda *a, **k: levels.append(1) or one_level(*a, **k))
    assert len({r.community for r in communities.louvain(ring_of_clusters(spark)).collect()}) == 6
    assert written.count("labels") == len(levels) > 1


def test_summaries_read_the_sales_once(spark, folder, monkeypatch):
    from quarrylight.catalog import graph as catalog
    from quarrylight.sources.tables import Tables

    reads = []

    class Counted(Tables):
        def read(self, name):
            reads.append(name)
            return super().read(name)

    monkeypatch.setattr(catalog.C, "louvain", lambda pairs: reads.append(catalog.C.is_plain(pairs)) or pairs.select(F.col("u").alias("node"), F.lit("all").alias("community")).distinct())
    t = Counted(spark, folder)
    pairs = catalog.shipped_pairs(t)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, graph.undirected(catalog.shipped(t)).collect()))
    reads.clear()
    catalog.C.louvain(catalog.shipped_pairs(t))
    assert reads.count("lineitem") == 1 and reads[-1] is True


def test_sections_and_upsert(spark):
    papers = spark.createDataFrame(
        [(1, "intro text\n# 1. Method\nfirst\n## Results\nrows\n##### deep\n# Method\nsecond\n")], "doc_id long, text string"
    )
    got = {r.section: (r.ord, r.text) for r in corpus.markdown_sections(papers, "doc_id", "text").collect()}
    assert got == {"preamble": (0, "intro text"), "method": (1, "second"), "results": (2, "rows\n##### deep")}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, corpus.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    stats = corpus.length_stats(spark.createDataFrame([("a",), ("bbb",), ("cc",), ("dddd",)], "text string")).first()
    assert (stats.n, stats.min_len, stats.max_len, stats.avg_len, stats.median_len) == (4, 1, 4, 2.5, 3)


def test_topic_paper_gets_place_two(spark):
    from quarrylight.plans import answering

    columns = "query_id long, chunk_id long, paper_key long, rank int, place int"
    pool = spark.createDataFrame([(1, c, c, c, None) for c in range(1, 8)] + [(2, c, c, c, None) for c in range(1, 4)] + [(3, 9, 9, 1, None), (3, 5, 5, 2, None)], columns)
    chosen = spark.createDataFrame([(1, c, c, c, c) for c in range(1, 5)] + [(2, c, c, c, c) for c in range(1, 4)] + [(3, 9, 9, 1, 1)], columns)
    topics = spark.createDataFrame([(1, 7), (1, 6), (2, 3), (3, 5)], "query_id long, paper_key long")
    got = answering.with_topic_paper(chosen, pool, topics).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id, r.place) for r in got] == [(1, 1, 1), (1, 6, 2), (1, 2, 3), (1, 3, 4), (2, 1, 1), (2, 2, 2), (2, 3, 3), (3, 5, 1)]


def test_landmark_comes_back_after_the_filter(spark):
    from quarrylight.plans import answering

    rows = spark.createDataFrame([(q, c, c, c) for q in (1, 2) for c in range(1, 6)], "query_id long, chunk_id long, paper_key long, rank int")
    picked = rows.where("rank <= 3").withColumn("source_number", F.col("rank"))
    marks = spark.createDataFrame([(5,), (4,)], "paper_key long")
    got = answering.with_landmark(picked, rows, marks).orderBy("query_id", "source_number").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [(1, 1), (1, 2), (1, 4), (2, 1), (2, 2), (2, 4)]
    none = answering.with_landmark(picked, rows, marks.where("paper_key = 0"))
    assert none.count() == 6


def test_evidence_of_batches_that_share_documents(spark):
    from quarrylight.operators import graph

    columns = "s_name string, s_type string, predicate string, o_name string, o_type string, chunk_id long, doc_id long, confidence double"
    rows = [("A", "X", "uses", "B", "Y", c, 1, 0.5) for c in (1, 2, 3, 3)]
    frame = spark.createDataFrame(rows, columns)
    parts = [graph.evidence(frame.where(f"chunk_id % 2 = {i}")) for i in (0, 1)]
    edge = graph.edges_from(graph.merge_evidence(*parts)).first()
    assert (edge.weight, edge.n_chunks, edge.n_docs, edge.confidence_sum) == (4, 3, 1, 2.0)


def test_answers_from_given_context(spark):
    from quarrylight.plans import answering

    asked = spark.createDataFrame([(1, "How does the attention model work?"), (2, "Nice weather today?"), (3, "How does the attention model work?")], "query_id long, question string")
    text = "The attention model works by attention over tokens. The attention model learns weights. It is trained on data."
    context = spark.createDataFrame([(1, 1, "Attention model", "body", text, 0.9), (2, 1, "x", "body", text, 0.9)], "query_id long, rank int, title string, section string, text string, score double")
    got = {r.query_id: r for r in answering.answer_from_context(asked, context).collect()}
    assert got[2].deflected and got[2].reason == "off_topic"
    assert got[3].deflected and not got[3].citations
    assert not got[1].deflected and "[Source 1] Attention model" in got[1].answer and len(got[1].citations) == 1


def test_eval_query_file_and_stage_tables(spark, tmp_path):
    import json

    from quarrylight.sources import evalsets, sinks

    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"id": "a", "question": "q", "relevant_doc": "p1"}, {"id": "b", "question": "q", "relevant_docs": ["p1", "p2"], "expected_sections": ["s"]}, {"id": "c", "question": "q", "should_deflect": True}]))
    got = {r.id: (r.papers, r.sections, r.should_deflect) for r in evalsets.read_eval_queries(spark, str(path)).collect()}
    assert got == {"a": (["p1"], [], False), "b": (["p1", "p2"], ["s"], False), "c": ([], [], True)}
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage_table(spark, str(tmp_path), "chunks", make).count() == 3
    assert len(made) == 1
