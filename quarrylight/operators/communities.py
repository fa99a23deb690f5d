"""Weighted modularity communities (Louvain): passes over the links of a level, nodes against communities.

No task ever holds the graph. The links of a level are kept partitioned by node, as blocks of numbers, and a pass sends
each task the community of every node and the weight of every community as arrays: a task looks up the far ends of its
links, sums them per node and community and tells the nodes that move, so a pass shuffles nothing. Where
the nodes are too many for arrays, labels meet the links by key and sums per node and community are shuffled.

Half of the nodes (by a hash that changes each round) may move at a time, which keeps neighbours
from swapping labels forever. A level ends when a round of both halves moves nothing or stops
raising modularity; communities then become the nodes of the next level.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.ranking import ranked
from quarrylight.operators.sizing import broadcast_if_small, is_plain
from quarrylight.session import settle

# Resolution and the smallest community that counts.
RESOLUTION, MIN_SIZE = 1.0, 3
#: Links that a task of a pass reads, and those of a block.
TASK_LINKS, BLOCK_LINKS = 1 << 20, 1 << 17
#: Bytes a node takes in the arrays that a task is sent, and the most for all nodes.
NODE_BYTES, ARRAY_BYTES = 24, 256 << 20
BLOCK = "a binary, b binary, w binary"


def modularity(links: DataFrame, labels: DataFrame, total: float, resolution: float) -> float:
    """Of ``links(a, b, w)`` (both directions, self-links once with doubled weight)."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = links.join(left, "a").join(right, "b")
    inside = F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0))
    per = joined.groupBy("la").agg(inside.alias("inside"), F.sum("w").alias("degree"))
    value = per.agg(F.sum(F.col("inside") / total - resolution * (F.col("degree") / total) * (F.col("degree") / total))).first()[0]
    return float(value or 0.0)


def _tasks(links: DataFrame, n: int) -> int:
    return max(min(links.sparkSession.sparkContext.defaultParallelism, 1 + n // (TASK_LINKS >> 4)), -(-n // TASK_LINKS))


def _one_level(links: DataFrame, total: float, resolution: float, most: int = ARRAY_BYTES) -> tuple[DataFrame, float]:
    """``node, label`` of the best round and its modularity."""
    nodes = settle(links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")), "nodes")
    inner = float(links.where("a = b").agg(F.sum("w")).first()[0] or 0.0)
    way = _level_of_arrays if nodes.count() * NODE_BYTES <= most else _level_of_joins
    return way(links, nodes, inner, total, resolution)


def _hashed(value: np.ndarray, seed: np.ndarray | int, whole: bool) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint (``whole``) or an int, behind what gave the seed."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.asarray(seed).astype(np.uint64) + p5 + np.uint64(8 if whole else 4)
        value = np.asarray(value).astype(np.uint64)
        h = turned(h ^ (turned(value * p2, 31) * p1), 27) * p1 + p4 if whole else turned(h ^ (value * p1), 23) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _half(ids: np.ndarray, r: int) -> np.ndarray:
    """``pmod(xxhash64(id, r), 2)``."""
    return (_hashed(np.array([r]), _hashed(ids, 42, True), False) & np.uint64(1)).astype(np.int8)


def _summed(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(w[order], starts) if len(key) else w


def _joined(batches, size: int):
    """Batches of ``a, b, w`` put together until there are ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b", "w")])
        n += batch.num_rows
        if n >= size:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _blocks(links: DataFrame, ids) -> DataFrame:
    """The links between nodes as blocks of places in the sorted ``ids``, those of a node behind one another in one task."""
    rows = links.where("a <> b")

    def packed(batches):
        for a, b, w in _joined(batches, BLOCK_LINKS):
            places = [np.searchsorted(ids.value, x).astype(np.int32).tobytes() for x in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*places, w.tobytes())], ["a", "b", "w"])

    dealt = rows.repartition(_tasks(links, rows.count()), "a").sortWithinPartitions("a")
    kept = dealt.mapInArrow(packed, BLOCK).persist()
    kept.count()
    return kept


def _pass(kept: DataFrame, degree, labels: np.ndarray, volume: np.ndarray, turn: np.ndarray, scale: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """The nodes whose turn it is that move, their new labels, and the weight of all links within communities."""
    sent, (resolution, total) = kept.sparkSession.sparkContext.broadcast((labels, volume, turn)), scale

    def moves(node, other, k_in):
        """Of sums per node and community, in this order."""
        labels, volume, _ = sent.value
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[first, len(node)])
        own = other == labels[node]
        at, mine = degree.value[node], node[first]
        gain = np.round(k_in - resolution * at * (volume[other] - np.where(own, at, 0.0)) / total, 9)
        away = np.where(own, -np.inf, gain)
        best = np.maximum.reduceat(away, first)
        # A node none of whose links ends in its own community may stay there as well.
        alone = np.round(0.0 - resolution * degree.value[mine] * (volume[labels[mine]] - degree.value[mine]) / total, 9)
        stay = np.where(np.logical_or.reduceat(own, first), np.maximum.reduceat(np.where(own, gain, -np.inf), first), alone)
        to = np.maximum.reduceat(np.where(away == np.repeat(best, size), other, -1), first)
        found = best > stay
        return mine[found], to[found]

    def told(batches):
        labels, _, turn = sent.value
        inside, key, sums = 0.0, np.zeros(0, np.int64), np.zeros(0)
        result = lambda node, label, w: pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(label, pa.int32()), pa.array(w, pa.float64())], ["node", "label", "inside"])
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("a", "b", "w")), strict=True):
                a, b, w = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int32, np.int32, np.float64), strict=True))
                there = labels[b]
                inside += float(w[labels[a] == there].sum())
                asked = turn[a]
                fresh = (a[asked].astype(np.int64) << 32) | there[asked]
                # What is known of the last node so far goes on as sums, so a hub takes the communities around it.
                key, sums = _summed(np.concatenate([key, fresh]), np.concatenate([sums, w[asked]]))
                node = (key >> 32).astype(np.int32)
                done = int(np.searchsorted(node, node[-1])) if len(node) else 0
                if done:
                    new = moves(node[:done], (key[:done] & 0xFFFFFFFF).astype(np.int32), sums[:done])
                    yield result(*new, np.zeros(len(new[0])))
                    key, sums = key[done:], sums[done:]
        if len(key):
            new = moves((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), sums)
            yield result(*new, np.zeros(len(new[0])))
        yield result([-1], [-1], [inside])

    rows = kept.mapInArrow(told, "node int, label int, inside double").toArrow()
    sent.destroy()
    node, label, inside = (rows.column(c).to_numpy() for c in ("node", "label", "inside"))
    return node[node >= 0], label[node >= 0], float(inside.sum())


def _level_of_arrays(links: DataFrame, nodes: DataFrame, inner: float, total: float, resolution: float) -> tuple[DataFrame, float]:
    """The driver holds what is told of nodes; a label is the place of its first node among the sorted ids."""
    spark = links.sparkSession
    table = nodes.toArrow()
    order = np.argsort(ids := table.column("node").to_numpy())
    ids, degree = ids[order], table.column("degree").to_numpy()[order]
    sent = [spark.sparkContext.broadcast(x) for x in (ids, degree)]
    kept = _blocks(links, sent[0])
    labels, best, best_q, moved = np.arange(len(ids), dtype=np.int32), None, None, 0
    try:
        for r in count():
            halves = _half(ids, r)
            for half in (0, 1):
                volume = np.bincount(labels, weights=degree, minlength=len(ids))
                node, label, inside = _pass(kept, sent[1], labels, volume, halves == half, (resolution, total))
                if half == 0:
                    q = (inside + inner) / total - resolution * float(np.dot(degree, volume[labels])) / total / total
                    if best_q is not None and (moved == 0 or q <= best_q + 1e-9):
                        found = pa.table({"node": ids, "label": ids[best]})
                        return settle(spark.createDataFrame(found), "labels"), best_q
                    best, best_q, moved = labels, q, 0
                labels = labels.copy()
                labels[node] = label
                moved += len(node)
    finally:
        kept.unpersist()
        for x in sent:
            x.destroy()


def _level_of_joins(links: DataFrame, nodes: DataFrame, inner: float, total: float, resolution: float) -> tuple[DataFrame, float]:
    """Labels meet the links, and each node once as its own neighbour of no weight, by the far end ``a``."""
    rows = links.where("a <> b").join(nodes.withColumnRenamed("node", "b"), "b").select("a", "b", "w", "degree")
    own = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"), "degree")
    kept = rows.unionByName(own).repartition(_tasks(links, links.count()), "a").persist()
    kept.count()
    # The first labels need no pass: every node is a community.
    labels = nodes.select("node", F.col("node").alias("label"), "degree", F.lit(False).alias("moved"))
    best, best_q = labels, None
    try:
        for r in count():
            for half in (0, 1):
                volume = labels.groupBy("label").agg(F.sum("degree").alias("volume"))
                at = labels.join(volume, "label").select(F.col("node").alias("a"), F.col("label").alias("other"), "volume")
                turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == half
                # The first half reads all nodes, as their sums give the modularity that the round starts from.
                reads = kept if half == 0 else kept.where(F.pmod(F.xxhash64("b", F.lit(r)), F.lit(2)) == half)
                options = (
                    reads.join(at, "a")
                    .groupBy(F.col("b").alias("node"), "other")
                    .agg(F.sum("w").alias("k_in"), F.max("volume").alias("volume"), F.max("degree").alias("degree"), F.max(F.col("a") == F.col("b")).alias("own"))
                )
                rest = F.col("volume") - F.when(F.col("own"), F.col("degree")).otherwise(0.0)
                gain = F.round(F.col("k_in") - resolution * F.col("degree") * rest / total, 9)
                choice = options.groupBy("node").agg(
                    F.max("degree").alias("degree"),
                    F.max(F.struct(gain.alias("gain"), "own", "other")).alias("c"),
                    F.max(F.when(F.col("own"), F.struct("other", "k_in", "volume"))).alias("mine"),
                )
                moves = turn & (F.col("c.other") != F.col("mine.other"))
                step = choice.select("node", F.when(turn, F.col("c.other")).otherwise(F.col("mine.other")).alias("label"), "degree", moves.alias("moved"), "mine.k_in", "mine.volume")
                if half:
                    step = step.drop("k_in", "volume").unionByName(labels.where(~turn).select("node", "label", "degree", "moved"))
                    labels = settle(step, "labels")
                    continue
                step = settle(step, "labels")
                inside, squares = F.sum("k_in").alias("inside"), F.sum(F.col("degree") * F.col("volume")).alias("squares")
                sums = step.agg(inside, squares).crossJoin(labels.agg(F.count_if("moved").alias("moved"))).first()
                q = (sums["inside"] + inner) / total - resolution * sums["squares"] / total / total
                if best_q is not None and (sums["moved"] == 0 or q <= best_q + 1e-9):
                    return best.select("node", "label"), best_q
                best, best_q = labels, q
                labels = step.select("node", "label", "degree", "moved")
    finally:
        kept.unpersist()


def _numbered(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``node, id`` with a different number for every name, the same on every run, and the seed that gives them."""
    names = settle(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "names")
    for seed in count():
        found = names.select("node", F.xxhash64(F.lit(seed), "node").alias("id"))
        if not found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return found, seed


def _both_ways(half: DataFrame) -> DataFrame:
    """Links from either end; a link of a node to itself once."""
    return half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _merged(half: DataFrame, labels: DataFrame, most: int = ARRAY_BYTES) -> DataFrame:
    """The links of the next level, whose nodes are communities, one way; a link within a community counts from either end."""
    if labels.count() * NODE_BYTES > most:
        left, right = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        inner = F.when((F.col("la") == F.col("lb")) & (F.col("a") != F.col("b")), 2.0).otherwise(1.0)
        rows = half.join(left, "a").join(right, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), (F.col("w") * inner).alias("w"))
        return settle(rows.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    table = labels.toArrow()
    order = np.argsort(ids := table.column("node").to_numpy())
    ids, to = ids[order], table.column("label").to_numpy()[order]
    sent = half.sparkSession.sparkContext.broadcast((ids, to))

    def renamed(batches):
        ids, to = sent.value
        for a, b, w in _joined(batches, BLOCK_LINKS):
            la, lb = (to[np.searchsorted(ids, x)] for x in (a, b))
            w = np.where((la == lb) & (a != b), 2 * w, w)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(la, lb), np.maximum(la, lb), w)], ["a", "b", "w"])

    rows = half.mapInArrow(renamed, "a bigint, b bigint, w double")
    out = settle(rows.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    sent.destroy()
    return out


def louvain(pairs: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """``node, community`` for ``pairs(u, v, weight)``; a community is named by its first member.

    Rounds and levels go on until nothing moves or modularity stops rising.
    """
    pairs = pairs.select("u", "v", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))
    pairs = pairs if is_plain(pairs) else settle(pairs, "pairs")
    names, seed = _numbered(pairs)
    u, v = (F.xxhash64(F.lit(seed), c) for c in ("u", "v"))
    half = settle(pairs.select(u.alias("a"), v.alias("b"), F.when(u == v, 2 * F.col("w")).otherwise(F.col("w")).alias("w")), "links")
    total = float(_both_ways(half).agg(F.sum("w")).first()[0] or 0.0)
    if total == 0:
        return names.select("node", F.col("node").alias("community"))
    members, before = None, None
    while True:
        labels, q = _one_level(_both_ways(half), total, resolution)
        if before is not None and q <= before + 1e-9:
            break
        before = q
        if members is None:
            members = names.join(labels.select(F.col("node").alias("id"), "label"), "id").select("node", F.col("label").alias("community"))
        else:
            members = members.join(labels.select(F.col("node").alias("community"), "label"), "community").select("node", F.col("label").alias("community"))
        members = settle(members, "members")
        half = _merged(half, labels)
    first = members.groupBy("community").agg(F.min("node").alias("first"))
    return members.join(first, "community").select("node", F.col("first").alias("community"))


def community_table(members: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Communities of at least ``min_size``, largest first: ``community, size``."""
    sizes = members.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return sizes.orderBy(F.col("size").desc(), "community")


def top_entities(members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` entities of every community with the highest weighted degree."""
    degree = pairs.select(F.col("u").alias("node"), "weight").unionByName(pairs.select(F.col("v").alias("node"), "weight"))
    totals = degree.groupBy("node").agg(F.sum("weight").alias("degree"))
    order = [F.col("degree").desc(), F.col("node")]
    return ranked(members.join(totals, "node"), "community", order, "place").where(F.col("place") <= k)


def top_predicates(members: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` commonest predicates on edges inside every community."""
    members = broadcast_if_small(members.select("node", "community"))
    a = members.withColumnRenamed("node", "u")
    b = members.withColumnsRenamed({"node": "v", "community": "other"})
    inside = pairs.join(a, "u").join(b, "v").where(F.col("community") == F.col("other"))
    counts = inside.groupBy("community", "predicate").agg(F.count("*").alias("n"))
    return ranked(counts, "community", [F.col("n").desc(), F.col("predicate")], "place").where(F.col("place") <= k)


def describe(members: DataFrame, pairs: DataFrame, min_size: int = MIN_SIZE, entities: int = 10) -> DataFrame:
    """A sentence per community from its size, top entities and top predicates: ``community, size, summary``."""
    from quarrylight.operators.answers import in_order

    names = top_entities(members, pairs, entities).groupBy("community").agg(F.array_join(in_order("place", "node"), ", ").alias("names"))
    verbs = top_predicates(members, pairs).groupBy("community").agg(F.array_join(in_order("place", "predicate"), ", ").alias("verbs"))
    table = community_table(members, min_size).join(names, "community").join(verbs, "community", "left")
    text = F.format_string("%d related entities around %s, connected by %s.", "size", "names", F.coalesce("verbs", F.lit("nothing")))
    return table.select("community", "size", text.alias("summary"))


def community_members(names: DataFrame, members: DataFrame) -> DataFrame:
    """All members of the community each entity (``key``) belongs to, in order of name (``place``)."""
    placed = ranked(members, "community", [F.col("node")], "place")
    home = names.select("key").distinct().join(members.withColumnRenamed("node", "key"), "key")
    return home.join(placed, "community")
