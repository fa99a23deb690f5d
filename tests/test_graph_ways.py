"""Neighbours over several hops against plain enumeration of ways."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import graph
from quarrylight.session import settle

COLUMNS = "s_key string, s_type string, predicate string, o_key string, o_type string, weight long"


def drawn(seed, nodes, count, hub):
    draw = random.Random(seed)
    rows = {}
    for _ in range(count):
        a, b = (("n0" if draw.random() < hub else f"n{draw.randrange(nodes)}") for _ in range(2))
        types = {n: "T" if int(n[1:]) % 3 else "U" for n in (a, b)}
        if a != b:
            rows[a, types[a], f"P{draw.randrange(2)}", b, types[b]] = draw.randrange(1, 5)
    rows["twin", "T", "P0", "n1", "T"] = 2
    rows["twin", "U", "P0", "n2", "T"] = 2
    return [(*k, w) for k, w in rows.items()]


def plain(edges, start, hops, limit):
    around = {}
    for i, (a, ta, p, b, tb, w) in enumerate(edges):
        around.setdefault((a, ta), []).append(((b, tb), i))
        around.setdefault((b, tb), []).append(((a, ta), i))
    rows = set()

    def walk(origin, node, way):
        if way and node != origin:
            rows.update((len(way), -edges[i][5], *node, edges[i][2]) for i in way)
        if len(way) < hops:
            for other, i in around.get(node, []):
                if i not in way:
                    walk(origin, other, (*way, i))

    for node in [n for n in around if n[0] == start]:
        walk(node, node, ())
    return [(n, t, p, -w, h, i + 1) for i, (h, w, n, t, p) in enumerate(sorted(rows)[:limit])]


@pytest.mark.parametrize("seed, nodes, count, hub, hops, limit", [(1, 9, 14, 0.0, 3, 1000), (2, 40, 60, 0.3, 3, 12), (3, 12, 16, 0.2, 4, 25), (4, 60, 90, 0.4, 2, 7), (5, 6, 12, 0.2, 3, 5)])
def test_ways_of_several_hops(spark, seed, nodes, count, hub, hops, limit):
    edges = drawn(seed, nodes, count, hub)
    starts = ["n0", "n1", "n2", "twin", "nobody"]
    got = graph.neighbours_n_hops(spark.createDataFrame([(s,) for s in [*starts, "n1"]], "key string"), spark.createDataFrame(edges, COLUMNS), hops, limit).collect()
    for start in starts:
        mine = sorted((r for r in got if r["key"] == start), key=lambda r: r["place"])
        assert [(r["neighbour"], r["neighbour_type"], r["predicate"], r["weight"], r["hops"], r["place"]) for r in mine] == plain(edges, start, hops, limit)


def test_no_edges_give_no_ways(spark):
    assert graph.neighbours_n_hops(spark.createDataFrame([("x",)], "key string"), spark.createDataFrame([], COLUMNS), 3).count() == 0


def test_a_hub_of_many_starts_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 64)
    names = [f"n{i}" for i in range(1, 41)]
    edges = [(n, "T", "P0", "n0", "T", i + 1) for i, n in enumerate(names)]
    starts = spark.createDataFrame([(n,) for n in names], "key string")
    got = graph.neighbours_n_hops(starts, spark.createDataFrame(edges, COLUMNS), 2, 30).collect()
    for start in names[::13]:
        mine = sorted((r for r in got if r["key"] == start), key=lambda r: r["place"])
        assert [(r["neighbour"], r["neighbour_type"], r["predicate"], r["weight"], r["hops"], r["place"]) for r in mine] == plain(edges, start, 2, 30)
    ways = settle(starts.select("key", F.lit("T").alias("key_type"), F.lit("n0").alias("end"), F.lit("T").alias("end_type"), F.array().cast("array<struct<edge:string>>").alias("way")), "ways")
    step = F.struct(F.col("key").alias("edge")).alias("step")
    steps = settle(starts.select(F.lit("n0").alias("end"), F.lit("T").alias("end_type"), F.col("key").alias("neighbour"), F.lit("T").alias("neighbour_type"), step), "steps")
    grown, tasks = graph._grown(ways, steps, steps.groupBy("end", "end_type").agg(F.count("*").alias("n_out")), 1)
    held = [r["count"] for r in grown.groupBy(F.spark_partition_id()).count().collect()]
    assert tasks == 26 and sum(held) == 1600 and max(held) < 400
