"""N-gram Jaccard join: MinHash candidates, Bayesian pruning by increments, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import by_bytes, pick, whole_text
from quarrylight.llm.fingerprints import shingle_hashes
from quarrylight.llm.graphs import components
from quarrylight.session import settle

HASHES, BANDS, STEP = 128, 32, 16
#: Members of a bucket or component that one task compares with as many others.
BLOCK = 256
_DRAW = np.random.default_rng(11)
FACTORS = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(shingles: list[np.ndarray]) -> np.ndarray:
    """MinHash values, 32 bits each; a text without shingles has the largest value everywhere."""
    out = np.full((len(shingles), HASHES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(shingles) if len(s)]
    if full:
        values = np.concatenate([shingles[i] for i in full])
        starts = np.cumsum([0] + [len(shingles[i]) for i in full[:-1]])
        for n in range(HASHES):
            out[full, n] = np.minimum.reduceat(((values * FACTORS[n] + SHIFTS[n]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, HASHES // BANDS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for n in range(rows.shape[2]):
        keys = (keys ^ rows[:, :, n]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the fewest that must agree for a pair to stay.

    With a flat prior the similarity given ``m`` of ``n`` agreeing values is Beta(m + 1, n - m + 1),
    so P(similarity >= t) is the chance of at most ``m`` successes in n + 1 draws at t.
    """
    need = []
    for n in range(HASHES + 1):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        need.append(m)
    return need


def surviving(left: np.ndarray, right: np.ndarray, need: list[int]) -> np.ndarray:
    """Boolean matrix of the pairs whose posterior never fell below the tolerance."""
    keep = np.zeros((len(left), len(right)), bool)
    for start in range(0, len(left), 64):
        a, b = (x.ravel() for x in np.indices((min(64, len(left) - start), len(right))))
        a = a + start
        matches = np.zeros(len(a), np.int32)
        for low in range(0, HASHES, STEP):
            matches += (left[a, low : low + STEP] == right[b, low : low + STEP]).sum(axis=1, dtype=np.int32)
            stay = matches >= need[low + STEP]
            a, b, matches = a[stay], b[stay], matches[stay]
            if not len(a):
                break
        keep[a, b] = True
    return keep


def exact_similarity(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of all pairs of shingle sets, by products of incidence blocks."""
    both = [*left, *right]
    sizes = np.array([len(s) for s in both])
    kinds, place, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1  # shingles of one set only can't be shared
    row = np.repeat(np.arange(len(both)), sizes)
    shared = counts[place] > 1
    row, column = row[shared], number[place[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        cells = np.zeros((len(both), 2048), np.float32)
        cells[row[a:b], column[a:b] - low] = 1.0
        common += cells[: len(left)] @ cells[len(left) :].T
    return common / (sizes[: len(left), None] + sizes[None, len(left) :] - common)


def smallest_labels(rows: np.ndarray, columns: np.ndarray, count: int) -> np.ndarray:
    """Components of a small graph: the smallest place in each."""
    label = np.arange(count)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[columns])
        np.minimum.at(new, columns, new[rows])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        columns = [table[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(table) > 1 else np.zeros(0, np.int64)
        start = 0
        for cut in cuts.tolist():
            yield table.slice(start, cut - start)
            start = cut
        held = table.slice(start)
    if held is not None and len(held):
        yield held


def dealt(members: DataFrame, group: str, sized: DataFrame) -> DataFrame:
    """Members of groups as block pairs ``group, _i, _j``; a group of up to ``BLOCK`` members is one block.

    A larger group is cut into blocks by a hash of the member, and each member goes to the pairs its
    block is part of, so no task holds more than two blocks whatever the size of the group.
    """
    rows = members.join(sized.select(group, F.ceil(F.col("_members") / BLOCK).cast("int").alias("_blocks")), group)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other", "_blocks")


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of the first and of the second block; the same ones within a block."""
    block = table["_block"].to_numpy()
    i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
    return np.flatnonzero(block == i), np.flatnonzero(block == j)


def each_pair_once(keep: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.nonzero(keep)
    a, b = left[a], right[b]
    once = a < b if len(left) == len(right) and (left == right).all() else np.ones(len(a), bool)
    return a[once], b[once]


def spanning(node: np.ndarray, left: np.ndarray, right: np.ndarray, alike) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block pair (places ``a, b``) and edges (``low, high`` nodes) that connect what they do.

    ``alike(x, y)`` tells which of the places ``x`` and ``y`` are a pair. A block with itself tells one edge per member;
    two blocks tell edges between their own components only, which are found anew here as the block's
    own task finds them. So a group of n members has n edges and at most one per block pair and component.
    """
    a, b = each_pair_once(alike(left, right), left, right)
    count = len(node)
    if len(left) == len(right) and (left == right).all():
        root = smallest_labels(a, b, count)
        moved = np.flatnonzero(root != np.arange(count))
        return a, b, node[root[moved]], node[moved]
    if not len(a):
        return a, b, node[:0], node[:0]
    own = [each_pair_once(alike(side, side), side, side) for side in (left, right)]
    part = smallest_labels(*(np.concatenate([x[n] for x in own]) for n in (0, 1)), count)
    root = smallest_labels(part[a], part[b], count)
    met = np.unique(np.concatenate([part[a], part[b]]))
    moved = met[root[met] != met]
    return a, b, node[root[moved]], node[moved]


def text_key(text: Column) -> Column:
    """What texts share that are equal but for white space."""
    return F.md5(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def sketched(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``_id, _key, _node, _signature, _bands`` of every row; equal texts (but for white space) share a key."""
    rows = pick(df, id_col, text_col).withColumn("_key", text_key(F.col("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            shingles = shingle_hashes(batch.column("_text"), size)
            signature = signatures(shingles)
            keys = [k if len(s) else [] for k, s in zip(band_keys(signature).tolist(), shingles, strict=True)]
            yield pa.record_batch(
                [batch.column("_id"), batch.column("_key"), pa.array([row.tobytes() for row in signature], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["_id", "_key", "_signature", "_bands"],
            )

    found = rows.mapInArrow(run, "_id long, _key string, _signature binary, _bands array<long>")
    return found.withColumn("_node", F.xxhash64("_key"))


def candidate_edges(nodes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges ``a, b`` that span what the surviving pairs connect.

    Buckets are counted before anything is gathered; those with one member are dropped and of
    buckets with the same members one is kept. Within block pairs the MinHash values are compared
    in steps and a pair is dropped as soon as its posterior falls below the tolerance.
    """
    need = fewest_matches(threshold, tolerance)
    banded = nodes.select("_node", F.explode("_bands").alias("_bucket"))
    sized = banded.groupBy("_bucket").agg(
        F.count("*").alias("_members"), F.min("_node").alias("_low"), F.max("_node").alias("_high"), F.bit_xor(F.xxhash64("_node")).alias("_who")
    )
    sized = sized.where("_members > 1").groupBy("_members", "_low", "_high", "_who").agg(F.min("_bucket").alias("_bucket"))
    sized = settle(sized.select("_bucket", "_members"), "buckets")
    members = banded.join(sized.select("_bucket"), "_bucket", "left_semi")
    rows = dealt(members, "_bucket", sized).join(nodes.select("_node", "_signature"), "_node")
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "_bucket", "_i", "_j").sortWithinPartitions("_bucket", "_i", "_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["_bucket", "_i", "_j"]):
            table = table.sort_by("_node")  # what is connected hangs on its smallest node, the same one in every bucket
            node = table["_node"].to_numpy()
            signature = np.frombuffer(b"".join(table["_signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
            _, _, low, high = spanning(node, *sides(table), lambda x, y: surviving(signature[x], signature[y], need))  # noqa: B023
            if len(low):
                yield pa.record_batch([pa.array(low), pa.array(high)], names=["a", "b"])

    edges = rows.select("_bucket", "_i", "_j", "_block", "_node", "_signature").mapInArrow(run, "a long, b long")
    return edges.distinct()


def verified(grouped: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links told per member and block pair (``_node, _links``) and edges (``_node, _root``), from rows ``_group, _node, _copies, _text``."""
    sized = grouped.groupBy("_group").agg(F.count("*").alias("_members"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            sets = [np.unique(h).tobytes() for h in shingle_hashes(batch.column("_text"), size)]
            yield pa.record_batch([batch.column(n) for n in ("_group", "_node", "_copies")] + [pa.array(sets, pa.binary())], names=["_group", "_node", "_copies", "_set"])

    sets = grouped.select("_group", "_node", "_copies", "_text").mapInArrow(shingle, "_group long, _node long, _copies long, _set binary")
    rows = dealt(sets, "_group", sized)
    width = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["_group", "_i", "_j"]):
            table = table.sort_by("_node")
            node, copies = table["_node"].to_numpy(), table["_copies"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in table["_set"].to_pylist()]
            alike = lambda x, y: exact_similarity([sets[i] for i in x], [sets[i] for i in y]) >= threshold - 1e-6  # noqa: B023, E731
            a, b, low, high = spanning(node, *sides(table), alike)
            links = np.zeros(len(node), np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            told = np.flatnonzero(links > 0)
            if len(told):
                counts = np.concatenate([links[told], np.zeros(len(high), np.int64)])
                roots = pa.array(np.concatenate([node[told], low]))
                yield pa.record_batch([pa.array(np.concatenate([node[told], high])), pa.array(counts), roots], names=["_node", "_links", "_root"])

    return rows.select("_group", "_i", "_j", "_block", "_node", "_copies", "_set").mapInArrow(run, "_node long, _links long, _root long")


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """``_id, _key, _class, class_id, n_links`` of every row.

    Two documents are linked when the Jaccard similarity of their sets of ``size``-word shingles is
    ``threshold`` or more; a class is what links connect, named by its smallest id, and ``n_links``
    counts the documents linked to one, its exact copies included. Copies (equal but for white
    space) are one node from the start and never paired. Candidates share one of 32 bands of four
    MinHash values (at similarity 0.8 all but 1 in 10 million do), lose that place only to the
    posterior, and what they connect is verified exactly, all pairs in blocks.

    Null and empty texts are copies of each other; a text under ``size`` words is one shingle; null
    ids are documents like others (a class of nothing else has a null name); repeated rows are copies.
    """
    rows = settle(sketched(df, id_col, text_col, size), "sketches")
    nodes = settle(
        rows.groupBy("_node").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"), F.first("_signature").alias("_signature"), F.first("_bands").alias("_bands")), "nodes"
    )
    grouped = components(candidate_edges(nodes, threshold, tolerance)).select("node", F.col("label").alias("_group"))
    some = grouped.join(nodes.select(F.col("_node").alias("node"), "_rep", "_copies"), "node")
    some = some.select(F.col("node").alias("_node"), "_group", F.col("_rep"), "_copies")
    texts = pick(df, id_col, text_col).withColumn("_node", F.xxhash64(text_key(F.col("_text"))))
    texts = texts.alias("t").join(some.alias("s"), F.expr("t._node = s._node AND t._id <=> s._rep")).select("_group", F.col("s._node").alias("_node"), "_copies", "_text")
    found = settle(verified(texts.dropDuplicates(["_node"]), threshold, size), "links")
    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    roots = components(found.select(F.col("_node").alias("a"), F.col("_root").alias("b")).where("a <> b").distinct())
    classes = nodes.select("_node", "_rep", "_copies").join(links, "_node", "left").join(roots.select(F.col("node").alias("_node"), "label"), "_node", "left")
    classes = classes.select("_node", "_rep", F.coalesce("label", "_node").alias("_class"), (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    names = classes.groupBy("_class").agg(F.min("_rep").alias("class_id"))
    named = classes.join(names, "_class").select("_node", "_class", "class_id", "n_links")
    return rows.select("_id", "_key", "_node").join(named, "_node").select("_id", "_key", "_class", "class_id", "n_links")


def one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with the columns it came with: the smallest id, null ids last.

    Rows that repeat both id and text are one document and come once.
    """
    found = similar_classes(df, id_col, text_col, **options).select("_id", "_key", "_class")
    first = found.groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))).alias("first"))
    keep = settle(first.select("first.id", "first.key"), "kept")
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), text_key(whole_text(text_col)).alias("_key"))
    kept = rows.join(keep, F.expr("_key = key AND _id <=> id"), "left_semi")
    if not found.groupBy("_id", "_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_key"])
    return kept.select("_row.*")
