"""Document fingerprints: bottom-k sketches of word shingle hashes, mergeable across parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import by_bytes, pick

#: Bits of a kept hash, and the hexadecimal digits it takes in a fingerprint (so text order is number order).
BITS, DIGITS = 40, 10
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """64-bit hashes of each text's runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = pc.list_flatten(split)
    real = pc.not_equal(words, "")
    owner = pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    kinds = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    values = kinds[coded.indices.to_numpy()] if len(kinds) else np.zeros(0, np.uint64)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))) if len(texts) else np.zeros(0, np.int64)
    runs = np.zeros(len(values), np.uint64)
    for offset in range(min(size, len(values))):
        runs[: len(values) - offset] = runs[: len(values) - offset] * STEP + values[offset:]
    runs = mixed(runs)
    out, start = [], 0
    for end in ends:
        if end - start >= size:
            out.append(runs[start : end - size + 1])
        elif end > start:
            short = np.uint64(0)
            for v in values[start:end]:
                short = np.uint64((int(short) * int(STEP) + int(v)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def bottom(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distinct hashes, in order."""
    return np.unique(hashes >> np.uint64(64 - BITS))[:k]


def merge(first: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """Sketch of the union of what two sketches were made of."""
    return np.union1d(first, second)[:k]


def resemblance(first: np.ndarray, second: np.ndarray, k: int) -> float:
    """Estimated Jaccard similarity; exact below ``k`` shingles, and 1 for two empty sets."""
    both = np.sort(np.concatenate((first, second)), kind="stable")
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    distinct = both[np.concatenate(([True], ~twice))]
    kept = min(k, len(distinct))
    return float(np.count_nonzero(twice & (both[1:] <= distinct[kept - 1]))) / kept


def distinct_count(sketch: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * float(1 << BITS) / (float(sketch[k - 1]) + 1.0)


def containment(first: np.ndarray, second: np.ndarray, k: int) -> float:
    """Estimated share of the first set that is in the second; 1 for an empty first set."""
    if not len(first):
        return 1.0
    union = distinct_count(merge(first, second, k), k)
    return min(1.0, resemblance(first, second, k) * union / distinct_count(first, k))


def written(sketch: np.ndarray) -> str:
    return "".join(f"{v:0{DIGITS}x}" for v in sketch.tolist())


def parsed(text: str) -> np.ndarray:
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 256, size: int = 5) -> DataFrame:
    """``_id, fingerprint, shingles`` (estimated distinct shingles) of every row, without a shuffle.

    Null and empty texts have the empty fingerprint. Equal texts have equal fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4 << 20):
            kept = [bottom(h, k) for h in shingle_hashes(batch.column("_text"), size)]
            yield pa.record_batch(
                [batch.column("_id"), pa.array(map(written, kept), pa.string()), pa.array([distinct_count(s, k) for s in kept], pa.float64())],
                names=["_id", "fingerprint", "shingles"],
            )

    return pick(df, id_col, text_col).mapInArrow(run, "_id long, fingerprint string, shingles double")


def merged(df: DataFrame, key: Column, k: int = 256) -> DataFrame:
    """Fingerprints of groups: the ``k`` smallest hashes of each group's fingerprints, for parts of any number."""
    digits = F.lit(DIGITS)
    starts = F.sequence(F.lit(1), F.length("fingerprint"), digits)
    hashes = F.transform(starts, lambda at: F.substring(F.col("fingerprint"), at, digits))
    rows = df.where("fingerprint <> ''").select(key.alias("key"), F.explode_outer(hashes).alias("hash")).distinct()
    smallest = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("hash"))).where(F.col("place") <= k)
    return smallest.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias("fingerprint"))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in descending key order over partitions, each partition closed by the first row of the next.

    Splitters (one per partition) deal the keys out; the rows that open a partition, one per
    partition, are sent to the one before as well (``_last`` true). The text is shuffled once. Rows
    with one key are ordered by a hash of the text; null keys come last.
    """
    spark = df.sparkSession
    rows = pick(df, id_col, text_col, _key=F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("_key", F.array(*map(F.lit, shares)), F.lit(10_000 + 100 * parts))).first()[0] if shares else []
    cuts = sorted(set(found or []))
    part = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("_key")))
    rows = rows.withColumn("_part", part.cast("int"))
    opening = {r["_part"]: r["_key"] for r in rows.groupBy("_part").agg(F.max("_key").alias("_key")).collect()}  # one row per partition
    order = sorted(opening, reverse=True)
    closed = {opening[after]: order[i] for i, after in enumerate(order[1:] + order[:1])} if order else {}
    ends = rows.where(F.col("_key").isin(list(closed))) if closed else rows.where("false")
    back = F.create_map(*(F.lit(x) for pair in closed.items() for x in pair)) if closed else F.create_map(F.lit(0), F.lit(0))
    ends = ends.withColumn("_part", F.element_at(back, F.col("_key")).cast("int")).withColumn("_last", F.lit(True))
    dealt = rows.withColumn("_last", F.lit(False)).unionByName(ends)
    return dealt.repartitionById(parts, "_part").sortWithinPartitions("_part", "_last", F.desc("_key"), F.desc(F.xxhash64("_text")), F.desc("_text"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 256, size: int = 5) -> DataFrame:
    """Fingerprints of every text and of the text whose last third gives way to the next document's start.

    The next document is the one with the next smaller key (after the last: the first). Returns
    ``_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, and
    estimates from the same sketches: ``shingles`` (distinct ones of the text), ``contained_edited`` and
    ``contained_next`` (share of them in the edited text, in the next document; 1 for a text without any).
    """
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shingles", "contained_edited", "contained_next"]

    def rows_of(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last, which is only the next of the one before."""
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            cut = len(text) // 3
            edited.append(text[: len(text) - cut] + after[:cut])
        own = [bottom(h, k) for h in shingle_hashes(pa.array(texts, pa.large_string()), size)]
        new = [bottom(h, k) for h in shingle_hashes(pa.array(edited, pa.large_string()), size)]
        return pa.record_batch(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array(map(len, texts[:-1]), pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(map(written, own[:-1]), pa.string()),
                pa.array(map(written, new), pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, new, strict=False)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                pa.array([distinct_count(a, k) for a in own[:-1]], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(own, new, strict=False)], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, closed = [], [], False
        for batch in by_bytes(batches, 2 << 20):
            for i, text, last in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), batch.column("_last").to_pylist(), strict=True):
                if not closed:
                    ids.append(i)
                    texts.append(text)
                closed = closed or last
            if len(texts) > 1:
                yield rows_of(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    schema = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shingles double, contained_edited double, contained_next double"
    return with_next(df, id_col, text_col).select("_id", "_text", "_last").mapInArrow(run, schema)
