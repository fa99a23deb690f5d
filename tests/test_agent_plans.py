"""Plans of the agent loop as tables."""

from pyspark.sql import functions as F

from quarrylight.plans import stepped

EDGES = [("paris", "CITY", "IN", "france", "COUNTRY", 3), ("bonn", "CITY", "IN", "germany", "COUNTRY", 2), ("paris", "CITY", "NEAR", "bonn", "CITY", 1)]


def edges(spark):
    frame = spark.createDataFrame(EDGES, "s_key string, s_type string, predicate string, o_key string, o_type string, weight long")
    return frame.withColumns({"s_name": F.initcap("s_key"), "o_name": F.initcap("o_key")})


def test_only_arrays_of_strings_are_plans(spark):
    replies = ['["a", "b"]', 'Sure: ["a?", "b \\"q\\"", "c"] done', '["a", 1]', "[1, 2]", "none", None, "[]", '{"a": ["b"]}', '["a", null]', "x [broken", '[["a"], "b"]', '["1", "2"]']
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = {r["i"]: r["s"] for r in rows.select("i", stepped.string_array(F.col("reply")).alias("s")).collect()}
    assert got == {0: ["a", "b"], 1: ["a?", 'b "q"', "c"], 2: None, 3: None, 4: None, 5: None, 6: [], 7: ["b"], 8: None, 9: None, 10: None, 11: ["1", "2"]}


def test_plans_by_kind(spark):
    asked = [(1, "What is rain?"), (2, "Paris and Bonn?"), (3, "Compare A to B. Is A old? Is B new?"), (4, "Compare A to B"), (5, "Paris is nice. Is it large?"), (6, "One. Two. Three. Four. Five.")]
    queries = spark.createDataFrame(asked, "query_id long, question string")
    kinds, parts = stepped.kinds_of(queries, edges(spark)).cache(), stepped.parts_of(queries, stepped.sentence_parts).cache()
    first = stepped.first_plan(kinds, parts)
    plan = {q: [] for q, _ in asked}
    for r in sorted(first.collect(), key=lambda r: (r["query_id"], r["step"])):
        plan[r["query_id"]].append((r["step"], r["question"], r["query_type"]))
    assert plan[1] == [(0, "What is rain?", "simple")]
    assert plan[2] == [(0, "Paris and Bonn?", "entity_heavy"), (1, "Paris and Bonn? [Related: France Germany]", "entity_heavy")]
    assert plan[3] == [(0, "Compare A to B.", "multi_hop"), (1, "Is A old?", "multi_hop"), (2, "Is B new?", "multi_hop")]
    assert plan[4] == [(0, "Compare A to B", "multi_hop")] and plan[6] == [(0, asked[5][1], "simple")]
    again = {}
    for r in sorted(stepped.next_plan(kinds, parts, first).collect(), key=lambda r: (r["query_id"], r["step"])):
        again.setdefault(r["query_id"], []).append((r["step"], r["question"], r["query_type"]))
    assert again == {5: [(0, "Paris is nice. Is it large? [Related: Bonn France]", "simple")]}
    wide = stepped.first_plan(kinds.withColumn("expanded", F.lit(None).cast("string")), parts)
    split = stepped.next_plan(kinds.withColumn("expanded", F.lit(None).cast("string")), parts, wide).collect()
    assert sorted((r["query_id"], r["question"], r["query_type"]) for r in split) == [(5, "Is it large?", "multi_hop"), (5, "Paris is nice.", "multi_hop")]


def test_first_step_that_finds_a_chunk_scores_it(spark):
    context = spark.createDataFrame([(1, 10, 0.5, 0, 0), (1, 11, 0.4, 0, 0)], "query_id long, chunk_id long, score double, round int, step int")
    found = spark.createDataFrame([(1, 10, 0.9, 1, 0), (1, 12, 0.3, 1, 0), (1, 12, 0.8, 1, 1), (1, 13, 0.45, 1, 1)], "query_id long, chunk_id long, score double, round int, step int")
    got = [(r["chunk_id"], r["score"], r["round"], r["step"], r["rank"]) for r in stepped.merged(context, found, 3).orderBy("rank").collect()]
    assert got == [(10, 0.5, 0, 0, 1), (13, 0.45, 1, 1, 2), (11, 0.4, 0, 0, 3)]


def test_loop_ends_where_context_suffices_or_nothing_is_left_to_ask(spark):
    chunks = spark.createDataFrame([(i, f"p{i}", t) for i, t in enumerate(["red apples grow on old trees behind town", "red apples grow on old trees behind town", "bonn is a city on the rhine", "paris has cafes"])], "chunk_id long, paper_id string, text string")
    queries = spark.createDataFrame([(1, "red apples grow on old trees behind town"), (2, "paris"), (3, "zzz")], "query_id long, question string")
    got = stepped.agent_run(queries, chunks, edges(spark), k=4).collect()
    rounds = {r["query_id"]: r["rounds"] for r in got}
    assert rounds[1] == 1 and rounds[2] == 3
    assert {(r["round"], r["step"]) for r in got if r["query_id"] == 1} == {(0, 0)}
    assert len(got) == len({(r["query_id"], r["chunk_id"]) for r in got})
    assert stepped.agent_run(queries.limit(0), chunks, edges(spark)).count() == 0
