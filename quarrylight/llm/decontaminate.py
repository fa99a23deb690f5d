"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check; exact bounds for what lies beyond the radius."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import by_bytes, pick, short_batches, whole_text
from quarrylight.session import settle

#: Text of benchmark items that one pass holds in every task; more items take more passes.
PASS_BYTES = 16 << 20


def plain(word: str) -> str:
    """Lower case, without what is neither letter nor digit at both ends."""
    if word.isalnum():
        return word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


def plain_words(text: str) -> list[str]:
    return [w for w in map(plain, text.split()) if w]


def radius_for(length: int, size: int, least: float, spare: float = 2.33) -> int:
    """Bits in which the fingerprints of an item and of a window just similar enough may differ.

    A run of new words at an edge keeps the similarity at ``least`` with the most words changed. If a
    share c of the words changes, a bit flips with probability acos(1 - c) / pi; ``spare`` standard
    deviations above the mean hold all but about one in a hundred of such windows, and windows that
    are more alike with fewer exceptions.
    """
    changed = max(length - size + 1, 1) * (1 - least) / (1 + least) / length
    flips = math.acos(1 - changed) / math.pi
    return min(64, math.ceil(64 * flips + spare * math.sqrt(64 * flips * (1 - flips))))


def simhash(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit SimHash of the windows of ``length`` words at the sorted ``starts``: per bit the majority over a window's words."""
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        low = starts[done]
        upto = int(np.searchsorted(starts, low + (1 << 13)))
        some = starts[done:upto] - low
        words = np.ascontiguousarray(hashes[low : low + some[-1] + length])
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        out[done:upto] = np.packbits(2 * (sums[some + length] - sums[some]) > length, axis=1).view(np.uint64).ravel()
        done = upto
    return out


class HammingIndex:
    """All stored fingerprints within ``radius``: of ``radius + 1`` blocks of bits one must agree exactly."""

    def __init__(self, stored: np.ndarray, radius: int):
        self.stored, self.radius, self.tables = stored, radius, []
        edges = np.linspace(0, 64, min(radius + 1, 64) + 1).astype(int)
        for low, high in zip(edges, edges[1:], strict=False):
            shift, mask = np.uint64(low), np.uint64((1 << int(high - low)) - 1)
            values = (stored >> shift) & mask
            order = np.argsort(values, kind="stable")
            self.tables.append((shift, mask, values[order], order))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``asked``, place in the store) of distance at most ``radius``, nearest first."""
        pairs = []
        for shift, mask, values, order in self.tables:
            value = (asked >> shift) & mask
            low, high = np.searchsorted(values, value), np.searchsorted(values, value, side="right")
            counts = high - low
            left = np.repeat(np.arange(len(asked)), counts)
            right = order[np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
            near = np.bitwise_count(asked[left] ^ self.stored[right]) <= self.radius
            pairs.append(left[near] * len(self.stored) + right[near])
        both = np.unique(np.concatenate(pairs))
        left, right = both // len(self.stored), both % len(self.stored)
        order = np.argsort(np.bitwise_count(asked[left] ^ self.stored[right]), kind="stable")
        return left[order], right[order]


class Items:
    """Benchmark items by length in words, ready to be met by windows of the same length."""

    def __init__(self, rows: list[tuple[int, str]], size: int, least: float, radius: int | None = None, shared: dict[str, int] | None = None):
        """``shared`` tells how many different items of the whole benchmark hold a shingle, if more than one; these rows alone tell it where it is left out.

        ``radius`` is that of the fingerprint search; left out, it follows from each item's length and ``least``.
        """
        self.size, self.least = size, least
        worded = [(i, plain_words(text)) for i, text in rows]
        worded = [(i, words) for i, words in worded if words]
        self.code = {w: n for n, w in enumerate(dict.fromkeys(w for _, words in worded for w in words))}
        coded = [[self.code[w] for w in words] for _, words in worded]
        self.pairs = np.unique(np.array([a * len(self.code) + b for codes in coded for a, b in zip(codes, codes[1:], strict=False)], np.int64))
        self.plains: dict[str, str] = {}
        if shared is None:
            self.spread = Counter(s for codes in dict.fromkeys(map(tuple, coded)) for s in self.shingles(codes))
        else:
            self.spread = {tuple(self.code[w] for w in s.split(" ")): n for s, n in shared.items()}
        grouped = defaultdict(list)
        for i, words in worded:
            grouped[len(words)].append((i, words))
        self.by_length, self.indexes = [], []
        self.telling: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)  # shingle to places in by_length and in its items
        for length, group in sorted(grouped.items()):
            known = np.zeros(len(self.code) + 1 if length < size else 0, bool)  # words of items below the shingle size
            sets, needs, totals = [], [], []
            for n, (_, words) in enumerate(group):
                codes = [self.code[w] for w in words]
                if length < size:
                    known[codes] = True
                sets.append(self.shingles(codes))
                needs.append(self.words_needed(sets[-1], length))
                totals.append(self.weight(sets[-1]))
                for shingle in self.tells(sets[-1], totals[-1]):
                    self.telling[shingle].append((len(self.by_length), n))
            self.by_length.append((length, needs, known, [i for i, _ in group], sets, totals))
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for _, words in group for w in words], np.uint64)
            reach = radius_for(length, size, least) if radius is None else radius
            self.indexes.append(HammingIndex(simhash(hashes, np.arange(len(group)) * length, length), reach))

    def shingles(self, codes: list[int]) -> set[tuple[int, ...]]:
        size = min(self.size, len(codes))
        return {tuple(codes[i : i + size]) for i in range(len(codes) - size + 1)}

    def weight(self, shingles) -> float:
        """A shingle that several different items share weighs as much less."""
        return sum(1.0 / self.spread.get(s, 1) for s in shingles)

    def words_needed(self, shingles: set, length: int) -> int:
        """Words of the item that any window similar enough holds: the fewest, heaviest shingles that suffice."""
        have, total = 0.0, self.weight(shingles)
        for n, w in enumerate(sorted((1.0 / self.spread.get(s, 1) for s in shingles), reverse=True), 1):
            have += w
            if have >= self.least * total - 1e-9:
                return n + min(self.size, length) - 1
        return length

    def tells(self, shingles: set, total: float) -> list[tuple[int, ...]]:
        """The fewest, heaviest shingles of an item without all of which no window is similar enough."""
        have, out = 0.0, []
        for shingle in sorted(shingles, key=lambda s: (self.spread.get(s, 1), s)):
            if have > (1 - self.least + 1e-6) * total:
                break
            have += 1.0 / self.spread.get(shingle, 1)
            out.append(shingle)
        return out

    def plain_all(self, words: list[str]) -> list[str]:
        """``plain`` of every word, remembered between batches for a hundred thousand or so."""
        if len(self.plains) > 1 << 17:
            self.plains.clear()
        known = self.plains
        return [p if (p := known.get(w)) is not None else known.setdefault(w, plain(w)) for w in words]

    def possible(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle starts whose neighbours all are neighbours in some item; the same with repeats of the next one left out."""
        outside, last = len(self.code), len(codes) - self.size
        held = np.zeros(len(codes), bool)
        if last < 0:
            return held, held
        paired = np.zeros(len(codes), bool)
        both = np.flatnonzero((codes[1:] != outside) & (codes[:-1] != outside))
        paired[both[np.isin(codes[both] * outside + codes[both + 1], self.pairs)]] = True
        equal = np.append(codes[1:] == codes[:-1], False)
        held[: last + 1] = np.logical_and.reduce([paired[n : n + last + 1] for n in range(self.size - 1)] or [codes[: last + 1] != outside])
        told = held.copy()
        told[:last] &= ~np.logical_and.reduce([equal[n : n + last] for n in range(self.size)])
        return held, told

    def similarity(self, window: list[int], item: set) -> float:
        """Weighted Jaccard; what the item does not have weighs as much as its own shingles do on average."""
        shingles, total = self.shingles(window), self.weight(item)
        common = shingles & item
        return self.weight(common) / (total + (len(shingles) - len(common)) * total / len(item))

    def matches(self, texts: pa.Array, beyond: bool = True) -> list[dict[int, tuple[float, int]]]:
        """For each text the items found in it, with the best similarity and the word it starts at.

        Without ``beyond`` only what the fingerprints tell, to see how much of all that is.
        """
        found: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(texts))]
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        coded = pc.list_flatten(split).dictionary_encode()
        kinds = self.plain_all(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy()
        real = np.array([bool(w) for w in kinds], bool)[place] if kinds else np.zeros(0, bool)
        owner, place = pc.list_parent_indices(split).to_numpy()[real], place[real]
        if not len(place):
            return found
        outside = len(self.code)
        codes = np.array([self.code.get(w, outside) for w in kinds], np.int64)[place]
        first: dict[str, int] = {}
        lowest = np.array([first.setdefault(w, n) for n, w in enumerate(kinds)], np.int64)  # one number for spellings that are the same word
        words = np.where(codes != outside, codes, -1 - lowest[place])
        counts = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(counts)  # where the text ends
        begins = ends - counts
        for length, _, known, ids, _, _ in self.by_length:
            if length >= self.size:
                break
            # Items below the shingle size: the whole item in a row, once in each text.
            starts = np.flatnonzero(known[codes])
            starts = starts[starts + length <= ends[owner[starts]]]
            spelled = codes[starts[:, None] + np.arange(length)]
            whole = known[spelled].all(axis=1)
            starts, spelled = starts[whole], spelled[whole]
            _, once = np.unique(np.column_stack([owner[starts], spelled]), axis=0, return_index=True)
            for start, shingle in zip(starts[once].tolist(), map(tuple, spelled[once].tolist()), strict=True):
                for _, n in self.telling.get(shingle, ()):
                    found[owner[start]].setdefault(ids[n], (1.0, start - int(begins[owner[start]])))
        held, told = self.possible(codes)
        sums = np.concatenate([[0], np.cumsum(told, dtype=np.int32)])
        at = np.flatnonzero(held)
        at = at[at + self.size <= ends[owner[at]]]
        met = defaultdict(list)
        for part in range(0, len(at), 1 << 14):
            some = at[part : part + (1 << 14)]
            for start, shingle in zip(some.tolist(), map(tuple, codes[some[:, None] + np.arange(self.size)].tolist()), strict=True):
                for item in self.telling.get(shingle, ()):
                    met[owner[start], *item].append(start)
        if not met:
            return found
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in kinds], np.uint64)[place]
        grouped = defaultdict(list)
        for (text, group, _), starts in met.items():
            grouped[text, group] += starts
        for (text, group), starts in grouped.items():
            length, needs, _, ids, sets, _ = self.by_length[group]
            begin, end = int(begins[text]), int(ends[text])
            width = min(length, end - begin)
            starts = self.around(sums, np.array(starts), begin, end, width, min(needs))
            for start, n in self.alike(hashes, starts, width, self.indexes[group]):
                best = found[text].get(ids[n], (0.0, 0))[0]
                if best < 1.0 and (like := self.similarity(words[start : start + width].tolist(), sets[n])) >= self.least - 1e-9 and like > best:
                    found[text][ids[n]] = (like, start - begin)
        for (text, group, n), starts in met.items() if beyond else ():
            length, needs, _, ids, sets, totals = self.by_length[group]
            begin, end = int(begins[text]), int(ends[text])
            told = found[text].get(ids[n], (0.0, 0))
            if told[0] < 1.0:
                # A text with fewer words is one window as a whole.
                best = self.nearest(words, held, sums, np.array(starts), begin, end, min(length, end - begin), needs[n], sets[n], totals[n])
                if best and best[0] > told[0]:
                    found[text][ids[n]] = best
        return found

    def around(self, sums, met, begin, end, length, need) -> np.ndarray:
        """Starts of the windows that hold a shingle of ``met`` and enough shingles that items could have (the last one may have been told as a repeat)."""
        room = length - self.size + 1
        covered = np.zeros(end - begin + 1, np.int32)
        np.add.at(covered, np.maximum(met - room + 1, begin) - begin, 1)
        np.add.at(covered, np.minimum(met, end - length) - begin + 1, -1)
        starts = begin + np.flatnonzero(np.cumsum(covered) > 0)
        return starts[sums[starts + room] - sums[starts] >= need - self.size]

    def alike(self, hashes, starts, length, index: HammingIndex) -> Iterator[tuple[int, int]]:
        """Windows and items of one length whose fingerprints are within the radius, nearest first in each part; pairs at a time are bounded."""
        part = max(1, min(4096, (1 << 22) // len(index.stored)))
        for n in range(0, len(starts), part):
            some = starts[n : n + part]
            left, right = index.within(simhash(hashes, some, length))
            yield from zip(some[left].tolist(), right.tolist(), strict=True)

    def nearest(self, words, held, sums, met, begin, end, length, need, item, total) -> tuple[float, int] | None:
        """The window around the starts ``met`` of a text's telling shingles that is most similar to the item, if any is similar enough."""
        room = length - self.size + 1
        starts = self.around(sums, met, begin, end, length, need)
        if not len(starts):
            return None
        low, high = starts[0], starts[-1] + room
        weights = np.zeros(high - low)
        for n in np.flatnonzero(held[low:high]).tolist():
            if (shingle := tuple(words[low + n : low + n + self.size].tolist())) in item:
                weights[n] = 1.0 / self.spread.get(shingle, 1)
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        most = (sums[starts + room - low] - sums[starts - low]) / total
        best = (0.0, 0)
        for n in np.argsort(-most, kind="stable").tolist():
            if most[n] < max(self.least, best[0]) - 1e-6 or best[0] == 1.0:
                break
            like = self.similarity(words[starts[n] : starts[n] + length].tolist(), item)
            if like >= self.least - 1e-9 and like > best[0]:
                best = (like, int(starts[n]) - begin)
        return best if best[0] else None


def item_words(rows: DataFrame) -> DataFrame:
    """``_id, _text`` and ``_words``, the plain words of the text with a space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([" ".join(plain_words(text)) for text in batch.column("_text").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("_id"), batch.column("_text"), words], names=["_id", "_text", "_words"])

    return rows.mapInArrow(run, "_id long, _text string, _words string")


def shared_shingles(worded: DataFrame, size: int) -> DataFrame:
    """``_shingle, _items, _blocks``: the shingles of several different items, how many these are and the blocks they are in."""
    words = worded.where("_words <> ''").select("_words", "_block").distinct().select(F.split("_words", " ", -1).alias("_words"), "_block")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - F.lit(size - 1), F.lit(1)))
    shingles = F.array_distinct(F.transform(starts, lambda n: F.array_join(F.slice("_words", n, size), " ")))
    told = words.select(F.explode_outer(shingles).alias("_shingle"), "_block").groupBy("_shingle").agg(F.count("*").alias("_items"), F.collect_set("_block").alias("_blocks"))
    return told.where("_items > 1")


def passes(items: DataFrame, id_col: str, text_col: str, size: int, least: float) -> list[Items]:
    """The items, in as many blocks as their size asks for; each block stays under ``PASS_BYTES`` or so.

    Items of the same words are in one block. How many items share a shingle is counted over all blocks.
    """
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = math.ceil(total / PASS_BYTES)
    if not blocks:
        return []
    worded = item_words(rows).withColumn("_block", F.pmod(F.xxhash64("_words"), F.lit(blocks)))
    shared = shared_shingles(worded, size)
    if blocks > 1:
        worded, shared = settle(worded, "items"), settle(shared, "shared-shingles")
    out = []
    for b in range(blocks):
        told = {r["_shingle"]: r["_items"] for r in shared.where(F.array_contains("_blocks", F.lit(b).cast("long"))).select("_shingle", "_items").collect()}
        out.append(Items([(r["_id"], r["_text"]) for r in worded.where(F.col("_block") == b).orderBy("_id", "_text").collect()], size, least, shared=told))
    return out


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = 5, least: float = 0.8,
) -> DataFrame:
    """``_id, hits`` of every document: the items it holds as ``array<struct<item_id, similarity, word>>``.

    Every window of as many words as an item is met with the items of that length, and a document with
    fewer words than an item is met with it as one window. A similar window
    holds at least one of the shingles that tell an item, so only windows around these are looked at,
    and those that hold too few shingles of items to reach the similarity are set aside (exact
    bounds). All others get a SimHash of their words; multi-index blocks give every item whose
    fingerprint is within a radius that follows from length and similarity (``radius_for``), and the
    weighted Jaccard similarity of word shingles decides: ``least`` or more. Items that a document's
    fingerprints did not tell as they are, are compared with the windows beyond the radius as well, by weight of
    shingles (exact bounds), so nothing similar enough is lost. A shingle
    weighs 1 over the number of different items (by their words) in the whole benchmark that hold it,
    one the item does not have as much as the item's own on average. Words
    are compared in lower case without punctuation around them. Items are the stated query set, met
    in blocks of bounded size; documents are read once per block and never shuffled. Null and empty
    texts have no hits; items without words match nothing, items shorter than a shingle must occur
    as they are; of equal items each is told.
    """
    hit = "array<struct<item_id: bigint, similarity: double, word: int>>"
    rows = pick(docs, id_col, text_col)
    blocks = passes(items, item_id, item_text, size, least)
    if not blocks:
        return rows.select("_id", F.array().cast(hit).alias("hits"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for shared in stored:
                for told, found in zip(hits, shared.value.matches(batch.column("_text")), strict=True):
                    told += [{"item_id": i, "similarity": s, "word": w} for i, (s, w) in found.items()]
            told = [sorted(h, key=lambda x: x["item_id"]) for h in hits]
            yield pa.record_batch([batch.column("_id"), pa.array(told, kind)], names=["_id", "hits"])

    context = docs.sparkSession.sparkContext
    stored = [context.broadcast(block) for block in blocks]
    return rows.mapInArrow(run, f"_id long, hits {hit}")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    short_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    stored = [context.broadcast(block) for block in passes(items, item_id, item_text, size, least)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            keep = np.ones(batch.num_rows, bool)
            for shared in stored:
                keep &= np.array([not found for found in shared.value.matches(pc.fill_null(batch.column(text_col), ""))], bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
