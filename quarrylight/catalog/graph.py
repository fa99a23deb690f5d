"""Knowledge graph built from the trade tables: who buys from whom, and in which segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.catalog.registry import query
from quarrylight.catalog.routing import big
from quarrylight.functions import text as T
from quarrylight.operators import communities as C
from quarrylight.operators import graph as G
from quarrylight.operators import routing
from quarrylight.operators.sizing import broadcast_if_small
from quarrylight.session import settle

TRIPLES = """triples AS (
  SELECT sn.n_name AS s_name, 'NATION' AS s_type, replace(o_orderpriority, '-', '_') AS predicate, cn.n_name AS o_name, 'NATION' AS o_type,
    l_orderkey * 8 + l_linenumber AS chunk_id, l_orderkey AS doc_id, 1.0 - l_discount AS confidence
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey
  WHERE lower(sn.n_name) <> lower(cn.n_name)
  UNION ALL
  SELECT n_name, 'NATION', 'BUYS_IN', c_mktsegment, 'SEGMENT', -c_custkey, -c_custkey, 1.0 FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
EDGES = f"""{TRIPLES}, edges AS (SELECT lower(s_name) AS s_key, s_type, upper(predicate) AS predicate, lower(o_name) AS o_key, o_type, min(s_name) AS s_name, min(o_name) AS o_name,
  count(*) AS weight, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(confidence) AS confidence_sum FROM triples GROUP BY ALL)"""
EDGES = EDGES.replace("GROUP BY ALL", "GROUP BY lower(s_name), s_type, upper(predicate), lower(o_name), o_type")
NODES = """nodes AS (SELECT key, entity_type, min(name) AS name FROM (SELECT s_key AS key, s_type AS entity_type, s_name AS name FROM edges
  UNION ALL SELECT o_key, o_type, o_name FROM edges) GROUP BY key, entity_type)"""
BOTH = """both_ways AS (SELECT s_key AS key, o_key AS neighbour, o_type AS neighbour_type, predicate, weight, 'out' AS direction FROM edges
  UNION ALL SELECT o_key, s_key, s_type, predicate, weight, 'in' FROM edges)"""
ASKED = "asked AS (SELECT c_custkey AS query_id, 'What links ' || n_name || ' to ' || c_mktsegment || '?' AS question FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def triples(t):
    nations = t.nation.select("n_nationkey", "n_name")
    sellers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("s_name"))
    buyers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("o_name"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    items = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount")
    trade = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "s_name",
            F.lit("NATION").alias("s_type"),
            F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("_")).alias("predicate"),
            "o_name",
            F.lit("NATION").alias("o_type"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunk_id"),
            F.col("l_orderkey").alias("doc_id"),
            (1.0 - F.col("l_discount")).alias("confidence"),
        )
    )
    buys = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("s_name"),
        F.lit("NATION").alias("s_type"),
        F.lit("BUYS_IN").alias("predicate"),
        F.col("c_mktsegment").alias("o_name"),
        F.lit("SEGMENT").alias("o_type"),
        (-F.col("c_custkey")).alias("chunk_id"),
        (-F.col("c_custkey")).alias("doc_id"),
        F.lit(1.0).alias("confidence"),
    )
    return G.clean_triples(trade.unionByName(buys))


def edges(t):
    """The edge table as a stored one, which every query over the graph reads several times."""
    return settle(G.weighted_edges(triples(t)), "edges")


def asked(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("What links "), "n_name", F.lit(" to "), "c_mktsegment", F.lit("?"))
    return joined.select(F.col("c_custkey").alias("query_id"), text.alias("question"))


@query(
    "graph_edges",
    f"WITH {EDGES} SELECT s_key, s_type, predicate, o_key, o_type, s_name, o_name, weight, n_chunks, n_docs, round(confidence_sum, 4) AS confidence_sum FROM edges",
)
def graph_edges(t):
    return G.edges_of(triples(t)).withColumn("confidence_sum", F.round("confidence_sum", 4))


@query(
    "graph_provenance",
    f"WITH {TRIPLES} SELECT DISTINCT lower(s_name) AS s_key, s_type, upper(predicate) AS predicate, lower(o_name) AS o_key, o_type, doc_id FROM triples",
)
def graph_provenance(t):
    return G.provenance(triples(t))


@query(
    "graph_merge_batches",
    f"WITH {EDGES} SELECT s_key, predicate, o_key, weight, n_docs, round(confidence_sum, 4) AS confidence_sum FROM edges",
)
def graph_merge_batches(t):
    rows = triples(t)
    # Two write batches whose chunks are of the same documents; together they are the whole table.
    first, second = (G.evidence(rows.where(F.pmod("chunk_id", F.lit(2)) == i)) for i in (0, 1))
    return G.edges_from(G.merge_evidence(first, second)).select("s_key", "predicate", "o_key", "weight", "n_docs", F.round("confidence_sum", 4).alias("confidence_sum"))


@query("graph_nodes", f"WITH {EDGES}, {NODES} SELECT key, entity_type, name FROM nodes")
def graph_nodes(t):
    return G.nodes_of(edges(t))


@query(
    "graph_stats",
    f"""WITH {EDGES}, {NODES} SELECT 'nodes' AS kind, '' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges
    UNION ALL SELECT 'type', entity_type, count(*) FROM nodes GROUP BY entity_type
    UNION ALL SELECT * FROM (SELECT 'predicate', predicate, count(*) AS n FROM edges GROUP BY predicate ORDER BY n DESC, predicate LIMIT 20)""",
)
def graph_stats(t):
    return G.stats(edges(t))


@query(
    "graph_entity_lookup",
    f"WITH {EDGES}, {NODES} SELECT n_nationkey, key, min(entity_type) AS entity_type FROM nodes JOIN nation ON lower(n_name) = key GROUP BY n_nationkey, key",
)
def graph_entity_lookup(t):
    names = t.nation.select("n_nationkey", F.lower("n_name").alias("key"))
    return names.join(G.entity_index(G.nodes_of(edges(t))), "key").select("n_nationkey", "key", "entity_type")


@query(
    "graph_neighbors_1hop",
    f"""WITH {EDGES}, {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, neighbour, predicate, direction) AS place FROM both_ways)
    SELECT key, neighbour, neighbour_type, predicate, weight, direction, place FROM r WHERE place <= 50""",
)
def graph_neighbors_1hop(t):
    e = edges(t)
    return big(G.neighbours(G.nodes_of(e), e), "place")


@query(
    "graph_neighbors_2hop",
    f"""WITH {EDGES}, {BOTH}, starts AS (SELECT DISTINCT lower(n_name) AS key FROM nation),
    one AS (SELECT key, neighbour, predicate, weight, 1 AS hops FROM both_ways JOIN starts USING (key)),
    pairs AS (SELECT a.key, a.predicate AS p1, a.weight AS w1, b.neighbour, b.predicate AS p2, b.weight AS w2
      FROM (SELECT DISTINCT key, neighbour, predicate, weight FROM both_ways JOIN starts USING (key)) a
      JOIN (SELECT DISTINCT key, neighbour, predicate, weight FROM both_ways) b ON b.key = a.neighbour WHERE b.neighbour <> a.key),
    rows AS (SELECT * FROM one UNION SELECT key, neighbour, p1, w1, 2 FROM pairs UNION SELECT key, neighbour, p2, w2, 2 FROM pairs),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hops, weight DESC, neighbour, predicate) AS place FROM rows)
    SELECT key, neighbour, predicate, weight, hops, place FROM r WHERE place <= 500""",
)
def graph_neighbors_2hop(t):
    starts = t.nation.select(F.lower("n_name").alias("key"))
    return big(G.neighbours_two_hops(starts, edges(t), 500), "place")


# Where suppliers and nations lie, and whom each nation's suppliers sell most to: few edges, long ways.
PLACES = """sold AS (SELECT s_suppkey, s_name, s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name, s_nationkey, c_nationkey),
  partner AS (SELECT * FROM (SELECT s_nationkey, c_nationkey, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY sum(n) DESC, c_nationkey) AS r
    FROM sold WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) WHERE r = 1),
  places AS (SELECT lower(s_name) AS s_key, 'SUPPLIER' AS s_type, 'IN_NATION' AS predicate, lower(n_name) AS o_key, 'NATION' AS o_type, sum(n)::BIGINT AS weight
    FROM sold JOIN nation ON n_nationkey = s_nationkey GROUP BY s_name, n_name
  UNION ALL SELECT lower(n_name), 'NATION', 'IN_REGION', lower(r_name), 'REGION', n_nationkey + 1 FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT lower(a.n_name), 'NATION', 'SELLS_MOST_TO', lower(b.n_name), 'NATION', n FROM partner JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey)"""


def places(t):
    customers = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    sold = t.lineitem.join(customers, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    sold = settle(sold.groupBy("s_suppkey", "s_name", "s_nationkey", "c_nationkey").agg(F.count("*").alias("n")), "sold")
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    row = lambda s, s_type, predicate, o, o_type, weight: [F.lower(s).alias("s_key"), F.lit(s_type).alias("s_type"), F.lit(predicate).alias("predicate"), F.lower(o).alias("o_key"), F.lit(o_type).alias("o_type"), weight.cast("bigint").alias("weight")]
    homes = sold.groupBy("s_name", "s_nationkey").agg(F.sum("n").alias("n")).join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    regions = nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    sums = sold.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.sum("n").alias("n"))
    most = sums.groupBy("s_nationkey").agg(F.min(F.struct((-F.col("n")).alias("less"), "c_nationkey")).alias("m"))
    pairs = most.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("a")), "s_nationkey").join(nation.select(F.col("n_nationkey").alias("bk"), F.col("n_name").alias("b")), F.col("bk") == F.col("m.c_nationkey"))
    parts = [
        homes.select(*row("s_name", "SUPPLIER", "IN_NATION", "n_name", "NATION", F.col("n"))),
        regions.select(*row("n_name", "NATION", "IN_REGION", "r_name", "REGION", F.col("n_nationkey") + 1)),
        pairs.select(*row("a", "NATION", "SELLS_MOST_TO", "b", "NATION", -F.col("m.less"))),
    ]
    return settle(parts[0].unionByName(parts[1]).unionByName(parts[2]), "places")


def ways_sql(hops: int, limit: int) -> str:
    return f"""WITH RECURSIVE {PLACES}, numbered AS (SELECT *, row_number() OVER (ORDER BY s_key, s_type, predicate, o_key, o_type) AS e FROM places),
    seen AS (SELECT s_key AS node, s_type AS node_type, o_key AS neighbour, o_type AS neighbour_type, predicate, weight, e FROM numbered
      UNION ALL SELECT o_key, o_type, s_key, s_type, predicate, weight, e FROM numbered),
    walk(key, key_type, node, node_type, way, hops) AS (SELECT DISTINCT node, node_type, node, node_type, []::BIGINT[], 0 FROM seen WHERE node_type <> 'NATION'
      UNION ALL SELECT key, key_type, neighbour, neighbour_type, list_append(way, e), hops + 1 FROM walk JOIN seen USING (node, node_type) WHERE hops < {hops} AND NOT list_contains(way, e)),
    used AS (SELECT key, node AS neighbour, node_type AS neighbour_type, unnest(way) AS e, hops FROM walk WHERE hops > 0 AND (node <> key OR node_type <> key_type)),
    rows AS (SELECT DISTINCT key, neighbour, neighbour_type, predicate, weight, hops FROM used JOIN numbered USING (e))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hops, weight DESC, neighbour, neighbour_type, predicate) AS place FROM rows) WHERE place <= {limit}"""


def ways_from(t, hops: int, limit: int):
    table = places(t)
    starts = G.nodes_of(table.withColumns({"s_name": F.col("s_key"), "o_name": F.col("o_key")})).where("entity_type <> 'NATION'")
    return big(G.neighbours_n_hops(starts.select("key"), table, hops, limit), "place")


@query("graph_neighbors_3hop", ways_sql(3, 30))
def graph_neighbors_3hop(t):
    return ways_from(t, 3, 30)


@query("graph_neighbors_4hop", ways_sql(4, 60))
def graph_neighbors_4hop(t):
    return ways_from(t, 4, 60)


# Customers and the suppliers they bought from: a graph whose nodes grow with the tables.
SHIPPED = """shipped AS (SELECT lower(s_name) AS s_key, lower(c_name) AS o_key, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY lower(s_name), lower(c_name)"
)


def sold(t):
    """An edge of weight 1 for every sale."""
    # Names come to orders and suppliers, so that sales, which are many, are shuffled by order only.
    buyers = t.customer.select("c_custkey", F.lower("c_name").alias("o_key"))
    sellers = t.supplier.select("s_suppkey", F.lower("s_name").alias("s_key"))
    bought = t.orders.select("o_orderkey", "o_custkey").join(broadcast_if_small(buyers), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_key")
    rows = (
        t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("predicate"))
        .join(broadcast_if_small(sellers), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return rows.select("s_key", "o_key", F.lit(1).cast("bigint").alias("weight"), "predicate")


def shipped(t):
    return sold(t).groupBy("s_key", "o_key").agg(F.sum("weight").alias("weight"), F.min("predicate").alias("predicate")).withColumns(
        {"s_type": F.lit("SUPPLIER"), "o_type": F.lit("CUSTOMER")}
    )


def shipped_pairs(t):
    """The pairs of ``shipped`` without their direction: sales add up at once."""
    return settle(G.undirected(sold(t)), "shipped-pairs")


@query(
    "graph_shortest_path",
    f"""WITH RECURSIVE {SHIPPED}, adj AS (SELECT DISTINCT s_key AS a, o_key AS b FROM shipped UNION SELECT DISTINCT o_key, s_key FROM shipped),
    goals AS (SELECT lower(a) AS source, lower(b) AS target FROM (SELECT s_nationkey, min(s_name) AS a, max(s_name) AS b FROM supplier GROUP BY s_nationkey)),
    walk(source, node, hops) AS (SELECT DISTINCT source, source, 0 FROM goals UNION SELECT source, adj.b, hops + 1 FROM walk JOIN adj ON adj.a = walk.node WHERE hops < 4),
    dist AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY source, node),
    par AS (SELECT d.source, d.node, d.hops, min(p.node) AS via FROM dist d LEFT JOIN adj ON adj.b = d.node LEFT JOIN dist p ON p.source = d.source AND p.node = adj.a AND p.hops = d.hops - 1 GROUP BY d.source, d.node, d.hops),
    back(source, target, node, hops, path) AS (SELECT g.source, g.target, g.target, d.hops, g.target FROM goals g JOIN dist d ON d.source = g.source AND d.node = g.target
      UNION ALL SELECT b.source, b.target, p.via, b.hops - 1, p.via || '>' || b.path FROM back b JOIN par p ON p.source = b.source AND p.node = b.node WHERE b.hops > 0)
    SELECT source, target, (len(string_split(path, '>')) - 1)::INT AS hops, path FROM back WHERE hops = 0""",
)
def graph_shortest_path(t):
    ends = t.supplier.groupBy("s_nationkey").agg(F.lower(F.min("s_name")).alias("source"), F.lower(F.max("s_name")).alias("target"))
    found = G.shortest_paths(ends.select("source", "target"), shipped(t))
    return found.withColumn("path", F.array_join("path", ">"))


MATCH = rf"""{ASKED}, split AS (SELECT query_id, question, list_filter(regexp_split_to_array(regexp_replace(lower(question), '[^\p{{L}}\p{{N}}_\s\-.]', ' ', 'g'), '\s+'), lambda w: length(w) > 0) AS w FROM asked),
runs AS (SELECT query_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM split, (VALUES (4), (3), (2), (1)) AS k(n)),
hits AS (SELECT query_id, key, min((-n, i)) AS spot FROM (SELECT query_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM runs) JOIN (SELECT DISTINCT key FROM nodes) USING (key) WHERE length(key) >= 2 GROUP BY query_id, key),
matched AS (SELECT query_id, key, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS place FROM hits) WHERE place <= 5)"""


@query("graph_match_entities", f"WITH {EDGES}, {NODES}, {MATCH} SELECT query_id, key, place FROM matched")
def graph_match_entities(t):
    out = G.match_entities(asked(t), G.entity_index(G.nodes_of(edges(t))))
    return big(out, "place").select("query_id", "key", "place")


FACTS = """around AS (SELECT s_key AS key, e.* FROM edges e UNION ALL SELECT o_key, e.* FROM edges e WHERE s_key <> o_key),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, s_key, s_type, predicate, o_key, o_type) AS place FROM around) WHERE place <= 50)"""


@query(
    "graph_entity_facts",
    f"""WITH {EDGES}, {FACTS} SELECT key, place, s_name || ' (' || s_type || ') ' || lower(replace(predicate, '_', ' ')) || ' ' || o_name || ' (' || o_type || ')' AS fact, weight FROM best""",
)
def graph_entity_facts(t):
    e = edges(t)
    out = G.entity_triples(G.nodes_of(e), e)
    return big(out, "place").select("key", "place", G.fact_line().alias("fact"), "weight")


@query(
    "graph_context",
    f"""WITH {EDGES}, {NODES}, {MATCH}, {FACTS},
    named AS (SELECT query_id, m.key, m.place, name FROM matched m JOIN (SELECT key, min((entity_type, name)) AS e, arg_min(name, (entity_type, name)) AS name FROM nodes GROUP BY key) USING (key)),
    lines AS (SELECT query_id, s_name || ' (' || s_type || ') ' || lower(replace(predicate, '_', ' ')) || ' ' || o_name || ' (' || o_type || ')' AS fact, min((m.place, b.place)) AS spot
      FROM matched m JOIN best b USING (key) GROUP BY query_id, fact),
    heads AS (SELECT query_id, string_agg(name, ', ' ORDER BY place) AS names, count(*) AS n_entities FROM named GROUP BY query_id)
    SELECT query_id, n_entities, n_facts, 'Knowledge graph facts about: ' || names || chr(10) || chr(10) || facts AS text FROM heads
    JOIN (SELECT query_id, string_agg('- ' || fact, chr(10) ORDER BY spot) AS facts, count(*) AS n_facts FROM lines GROUP BY query_id) USING (query_id)""",
)
def graph_context(t):
    return G.graph_context(asked(t), edges(t))


@query(
    "graph_expand_query",
    f"""WITH {EDGES}, {NODES}, {MATCH}, {BOTH}, near AS (SELECT key, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, neighbour, predicate, direction) AS place FROM both_ways) WHERE place <= 50),
    names AS (SELECT key AS neighbour, arg_min(name, (entity_type, name)) AS other FROM nodes GROUP BY key),
    fresh AS (SELECT DISTINCT m.query_id, other FROM matched m JOIN near USING (key) JOIN names USING (neighbour) JOIN asked a ON a.query_id = m.query_id WHERE NOT contains(lower(question), lower(other))),
    top8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY other) AS place FROM fresh) WHERE place <= 8)
    SELECT a.query_id, CASE WHEN hint IS NULL THEN question ELSE question || ' [Related: ' || hint || ']' END AS question FROM asked a
    LEFT JOIN (SELECT query_id, string_agg(other, ' ' ORDER BY place) AS hint FROM top8 GROUP BY query_id) USING (query_id)""",
)
def graph_expand_query(t):
    return G.expand_queries(asked(t), edges(t))


@query(
    "graph_query_type",
    f"""WITH {EDGES}, {NODES}, {MATCH}, c AS (SELECT query_id, count(*) AS n FROM matched GROUP BY query_id)
    SELECT query_id, CASE WHEN coalesce(n, 0) >= 2 THEN 'entity_heavy' ELSE 'simple' END AS query_type FROM asked LEFT JOIN c USING (query_id)""",
)
def graph_query_type(t):
    matched = G.match_entities(asked(t), G.entity_index(G.nodes_of(edges(t))))
    counts = matched.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = asked(t).join(counts, "query_id", "left")
    return rows.select("query_id", T.query_type(F.col("question"), F.coalesce("n", F.lit(0))).alias("query_type"))


@query(
    "graph_query_type_rates",
    f"""WITH {EDGES}, {NODES}, {MATCH}, c AS (SELECT query_id, count(*) AS n FROM matched GROUP BY query_id), k AS (SELECT coalesce(n, 0) >= 2 AS heavy FROM asked LEFT JOIN c USING (query_id))
    SELECT count(*) AS total_queries, round(count_if(NOT heavy) / count(*), 8) AS simple_pct, round(count_if(heavy) / count(*), 8) AS entity_heavy_pct FROM k""",
)
def graph_query_type_rates(t):
    out = routing.rates(graph_query_type(t), "query_type", ["simple", "entity_heavy"])
    return out.select("total_queries", *[F.round(c, 8).alias(c) for c in out.columns[1:]])


@query(
    "graph_subgraph_view",
    f"""WITH {EDGES}, {NODES}, {MATCH}, {FACTS.replace('place <= 50', 'place <= 30')}
    SELECT DISTINCT query_id, s_key, predicate, o_key, weight FROM matched m JOIN best b USING (key)""",
)
def graph_subgraph_view(t):
    e = edges(t)
    matched = G.match_entities(asked(t), G.entity_index(G.nodes_of(e)))
    near = G.entity_triples(matched.select("key"), e, 30)
    return matched.select("query_id", "key").join(near, "key").select("query_id", "s_key", "predicate", "o_key", "weight").distinct()


@query(
    "graph_undirected_weights",
    f"WITH {EDGES} SELECT least(s_key, o_key) AS u, greatest(s_key, o_key) AS v, sum(weight)::BIGINT AS weight, min(predicate) AS predicate FROM edges WHERE s_key <> o_key GROUP BY 1, 2",
)
def graph_undirected_weights(t):
    return G.undirected(edges(t))


@query(
    "community_predicates",
    f"""WITH {EDGES}, pairs AS (SELECT least(s_key, o_key) AS u, greatest(s_key, o_key) AS v, min(predicate) AS predicate FROM edges WHERE s_key <> o_key GROUP BY 1, 2),
    members AS (SELECT lower(n_name) AS node, r_name AS community FROM nation JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT a.community, predicate, count(*) AS n FROM pairs JOIN members a ON a.node = u JOIN members b ON b.node = v WHERE a.community = b.community GROUP BY 1, 2)
    SELECT community, predicate, n, place FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, predicate) AS place FROM c) WHERE place <= 5""",
)
def community_predicates(t):
    return big(C.top_predicates(regions(t), G.undirected(edges(t))), "place")


def regions(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.lower("n_name").alias("node"), F.col("r_name").alias("community"))


@query(
    "community_top_entities",
    f"""WITH {EDGES}, pairs AS (SELECT least(s_key, o_key) AS u, greatest(s_key, o_key) AS v, sum(weight) AS weight FROM edges WHERE s_key <> o_key GROUP BY 1, 2),
    members AS (SELECT lower(n_name) AS node, r_name AS community FROM nation JOIN region ON r_regionkey = n_regionkey),
    deg AS (SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT u AS node, weight FROM pairs UNION ALL SELECT v, weight FROM pairs) GROUP BY node)
    SELECT community, node, degree, place FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS place FROM members JOIN deg USING (node)) WHERE place <= 3""",
)
def community_top_entities(t):
    return big(C.top_entities(regions(t), G.undirected(edges(t)), 3), "place").select("community", "node", "degree", "place")


@query(
    "community_members_of_entity",
    """WITH members AS (SELECT lower(n_name) AS node, r_name AS community FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT a.node AS key, a.community, b.node, row_number() OVER (PARTITION BY a.node ORDER BY b.node) AS place FROM members a JOIN members b USING (community)""",
)
def community_members_of_entity(t):
    names = t.nation.select(F.lower("n_name").alias("key"))
    return big(C.community_members(names, regions(t)), "place").select("key", "community", "node", "place")


@query("communities_louvain")
def communities_louvain(t):
    return C.louvain(shipped_pairs(t))


@query("community_summaries")
def community_summaries(t):
    pairs = shipped_pairs(t)
    return C.describe(settle(C.louvain(pairs), "communities"), pairs)
