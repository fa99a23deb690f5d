"""Suffix-array dedup: byte strings that an earlier document has are cut out, exactly.

Only suffixes that can matter are sorted. Every string of ``LENGTH`` bytes holds one anchor, the
gram of ``GRAM`` bytes with the smallest hash in it, wherever it occurs; so equal strings have equal
anchors at equal places, and the strings (windows) of one anchor are a run. Runs that are equal as a
whole are settled by their first document. Where only part of a run can be equal, at the borders of
repeated passages, the suffix at its anchor goes into the suffix array: range-partitioned by sampled
splitters, each bucket sorted by multikey quicksort, neighbours compared, also across buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import by_bytes, pick
from quarrylight.session import settle

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
#: Lengths of the bytes on either side of a gram whose hashes a run carries, with the bits of each.
SIDES = ((3, 12), (9, 10), (17, 10))
#: Rows that are compared together.
ROWS = 1 << 16
#: Bytes of one piece of a long text, and of the pieces that are hashed together.
PIECE, TOGETHER = 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15
#: A place packs start, tag of the text and length of the run.
TAG_BITS, RUN_BITS = 10, 6
LAST = (1 << 63) - 1
#: The multikey quicksort leaves parts of this many rows to a plain sort by all words left.
LEAF = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a buffer, from sums over powers of an odd base modulo 2^64."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling._powers) < n:
            for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Rolling._powers[: n - 1], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Rolling._inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * Rolling._inverse[:n])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    covered, low = 1, values
    while covered * 2 <= width:
        low = np.minimum(low[:-covered], low[covered:])
        covered *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - covered :])


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about ``TOGETHER`` bytes: bytes, and per piece its text, its place there and its length.

    Pieces of a longer text overlap by one byte less than a window, so each window is in one piece.
    """
    held, size = [], 0

    def joined():
        owner, offset, parts = zip(*held, strict=True)
        return np.frombuffer(b"".join(parts), np.uint8), np.array(owner), np.array(offset), np.array([len(p) for p in parts])

    for owner, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[start : start + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > TOGETHER and held:
                yield joined()
                held, size = [], 0
            held.append((owner, start, part))
            size += len(part)
    if held:
        yield joined()


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All runs: the text's number, start, length, gram hash, hash of the run's bytes, packed hashes of both sides.

    The low six bits of a run's hash are the place of its anchor.
    """
    found = {k: [] for k in ("owner", "start", "run", "gram", "whole", "sides")}
    for data, owner, offset, sizes in pieces(texts):
        rolling = Rolling(data)
        grams = rolling.grams(GRAM)
        places = np.arange(len(grams), dtype=np.uint64)
        low = sliding_minimum((grams & ~np.uint64(0x3FFFFF)) | places, WINDOW) & np.uint64(0x3FFFFF)
        first = np.cumsum(sizes) - sizes
        counts = sizes - LENGTH + 1
        piece = np.repeat(np.arange(len(sizes)), counts)
        window = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts) + first[piece]
        anchor = low[window].astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
        run = np.diff(np.append(begin, len(window)))
        start, anchor, piece = window[begin], anchor[begin], piece[begin]
        end = start + run - 1 + LENGTH
        found["owner"].append(owner[piece])
        found["start"].append(start - first[piece] + offset[piece])
        found["run"].append(run)
        found["gram"].append(grams[anchor])
        whole = rolling.between(start, end) ^ mixed((run * 64 + anchor - start).astype(np.uint64))
        found["whole"].append(whole & ~np.uint64(63) | (anchor - start).astype(np.uint64))
        sides = np.zeros(len(start), np.uint64)
        for length, bits in SIDES:
            for a, b in ((anchor - length, anchor), (anchor + GRAM, anchor + GRAM + length)):
                there = (a >= first[piece]) & (b <= first[piece] + sizes[piece])
                hashed = rolling.between(np.where(there, a, 0), np.where(there, b, 0)) % np.uint64((1 << bits) - 1) + np.uint64(1)
                sides = sides << np.uint64(bits) | np.where(there, hashed, np.uint64(0))
        found["sides"].append(sides)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def place_of(start: np.ndarray, tag: np.ndarray, run: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << TAG_BITS | tag.astype(np.int64)) << RUN_BITS | run.astype(np.int64)


def place_parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, tag and run of packed places."""
    return place >> (TAG_BITS + RUN_BITS), place >> RUN_BITS & ((1 << TAG_BITS) - 1), place & ((1 << RUN_BITS) - 1)


def side_hashes(packed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Left and right hash of each length in ``SIDES``; 0 where the text does not reach that far."""
    out, low = [], packed.view(np.uint64)
    for _, bits in reversed(SIDES):
        mask = np.uint64((1 << bits) - 1)
        right, left = low & mask, low >> np.uint64(bits) & mask
        out.append((left, right))
        low = low >> np.uint64(2 * bits)
    return out[::-1]


def earlier_here(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rows whose keys a row of a smaller document has as well, among the rows given."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort((doc, *keys))
    fresh = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    lowest = doc[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > lowest
    return out


SPANS = "_doc long, _tag int, _start long, _end long"


def spans_batch(columns: list[np.ndarray], last) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    told = [pa.array(c).cast(kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.record_batch([*told, last(len(told[0]), pa.int64())], names=["_doc", "_tag", "_start", "_end", "_anchor"])


def joined_spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans with those that touch made one."""
    if not len(doc):
        return [doc, tag, start, end]
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    group = np.cumsum(fresh)
    stride = int(end.max()) + 1
    reach = np.maximum.accumulate(group * stride + end)
    fresh[1:] |= group[1:] * stride + start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return [doc[first], tag[first], start[first], reach[last] - group[last] * stride]


COLUMNS = ["_gram", "_whole", "_doc", "_place", "_sides"]


def run_rows(docs: DataFrame) -> DataFrame:
    """``_gram, _whole, _doc, _place, _sides`` of all runs.

    Of equal runs a batch tells only those of its first document, so a passage that every document
    has is a row or two per batch. The others are spans already: their place is negative, ``_whole``
    is their end and their gram only spreads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 8 << 20):
            found = anchors([t.encode() for t in batch.column("_text").to_pylist()])
            doc, tag = (batch.column(n).to_numpy()[found["owner"]] for n in ("_doc", "_tag"))
            gram, whole = found["gram"].astype(np.uint64), found["whole"].astype(np.uint64).view(np.int64)
            settled = earlier_here(doc, whole)
            *at, end = joined_spans(doc[settled], tag[settled], found["start"][settled], (found["start"] + found["run"] - 1 + LENGTH)[settled])
            none = np.zeros(len(end), np.int64)
            place = place_of(*(x[~settled] for x in (found["start"], tag, found["run"])))
            columns = [
                (np.concatenate([gram[~settled], mixed((at[0] + at[2]).astype(np.uint64))]) >> np.uint64(32)).astype(np.uint32).view(np.int32),
                np.concatenate([whole[~settled], end]),
                np.concatenate([doc[~settled], at[0]]),
                np.concatenate([place, -1 - place_of(at[2], at[1], none)]),
                np.concatenate([found["sides"][~settled].astype(np.uint64).view(np.int64), none]),
            ]
            yield pa.record_batch([pa.array(c) for c in columns], names=COLUMNS)

    return docs.mapInArrow(run, "_gram int, _whole long, _doc long, _place long, _sides long")


def compared_runs(rows: DataFrame, width: int) -> DataFrame:
    """Spans of runs that an earlier document has whole, and runs that may be so in part (with ``_anchor``).

    Of the latter start and end are those of the windows, and the anchor is the place of the gram.

    Rows arrive by gram, then run, then document. A run's rows after its first document are spans.
    Of grams with one kind of run nothing else is left; of the others the first document's runs are
    open, unless the bytes on both sides of the gram show that no two of them share a window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)  # first-document rows of the last run, while its gram has no other
        last, several = None, False  # gram, run and first document seen last; whether its gram has told rows

        def told(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            return spans_batch(joined_spans(doc, tag, start, end), pa.nulls)

        def open_told(rows: np.ndarray) -> pa.RecordBatch:
            start, tag, run = place_parts(rows[:, 3])
            return spans_batch([rows[:, 2], tag, start, start + run], lambda n, kind: pa.array(start + (rows[:, 1] & 63), kind))

        for rows in row_blocks(batches):
            settled = rows[rows[:, 3] < 0]
            if len(settled):
                start, tag, _ = place_parts(-1 - settled[:, 3])
                yield told(settled[:, 2], tag, start, settled[:, 1])
            rows = rows[rows[:, 3] >= 0]
            if not len(rows):
                continue
            before = np.array([last if last is not None else (rows[0, 0] - 1, 0, 0)])
            gram_new = np.diff(np.concatenate([before[:, 0], rows[:, 0]])) != 0
            run_new = gram_new | (np.diff(np.concatenate([before[:, 1], rows[:, 1]])) != 0)
            first = np.where(run_new, np.arange(len(rows)), -1)
            np.maximum.accumulate(first, out=first)
            lowest = np.where(first >= 0, rows[np.maximum(first, 0), 2], before[0, 2])
            spans = rows[rows[:, 2] > lowest]
            if len(spans):
                start, tag, run = place_parts(spans[:, 3])
                yield told(spans[:, 2], tag, start, start + run - 1 + LENGTH)
            gram = np.cumsum(gram_new)  # 0: the gram of the batch before
            kinds = np.bincount(gram[run_new], minlength=gram[-1] + 1)
            opening = rows[:, 2] == lowest
            mine, of = rows[opening], gram[opening]
            carried = several or len(held) > 0
            out = []
            if kinds[0] and carried:  # another kind of run for the gram of the batch before
                out += [held, mine[of == 0]]
                held, several = held[:0], True
            elif several:
                out.append(mine[of == 0])
            elif gram[-1] == 0 or (of == 0).any():
                held = np.concatenate([held, mine[of == 0]])
            inner = of > 0
            if inner.any():
                held, several = held[:0], False
                mine, of = mine[inner], of[inner]
                ends = of == gram[-1]
                more = kinds[of] > 1
                kind = np.cumsum(run_new)[opening][inner]
                out.append(shareable(mine[more], of[more], kind[more], ends[more]))
                if kinds[gram[-1]] > 1:
                    several = True
                else:
                    held = mine[ends]
            out = np.concatenate(out) if out else held[:0]
            if len(out):
                yield open_told(out)
            last = (rows[-1, 0], rows[-1, 1], lowest[-1])

    rows = rows.repartition(width, "_gram").sortWithinPartitions("_gram", "_whole", "_doc")
    return rows.mapInArrow(run, SPANS + ", _anchor long")


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The sorted rows as arrays of ``ROWS`` rows or so, however they were sent."""
    held, size = [], 0
    for batch in batches:
        held.append(np.column_stack([batch.column(n).to_numpy().astype(np.int64) for n in COLUMNS]))
        size += len(held[-1])
        if size >= ROWS:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def shareable(rows: np.ndarray, gram: np.ndarray, kind: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Open rows with only the windows that another kind of run of their gram can share.

    The bytes a window has to the left of the gram must stand there in the other run as well, and
    so on the right. A side that no other run agrees with at some length is shared over fewer bytes
    than that. Rows in ``whole`` keep all windows, as not all runs of their gram are here.
    """
    start, tag, run = place_parts(rows[:, 3])
    anchor = start + (rows[:, 1] & 63)
    reach = [np.full(len(rows), LENGTH - GRAM) for _ in range(2)]
    for (length, bits), hashes in zip(reversed(SIDES), reversed(side_hashes(rows[:, 4].copy())), strict=True):
        for side, hashed in enumerate(hashes):
            reach[side] = np.where(shared(gram, hashed.astype(np.int64), kind, bits), reach[side], length - 1)
    left, right = (np.where(whole, LENGTH - GRAM, r) for r in reach)
    low, high = np.maximum(start, anchor - left), np.minimum(start + run, anchor - (LENGTH - GRAM) + right + 1)
    out = rows.copy()
    out[:, 3] = place_of(low, tag, np.maximum(high - low, 0))
    out[:, 1] = (rows[:, 1] & ~np.int64(63)) | (anchor - low)
    return out[high > low]


def shared(gram: np.ndarray, side: np.ndarray, kind: np.ndarray, bits: int) -> np.ndarray:
    """Rows whose side (not 0) another kind of run of the same gram has."""
    key = gram.astype(np.int64) << bits | side
    order = np.lexsort((kind, key))
    k, v = key[order], kind[order]
    fresh = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    ends = np.append(fresh[1:], len(k)) - 1
    out = np.empty(len(key), bool)
    out[order] = np.repeat(v[fresh] != v[ends], ends - fresh + 1) if len(k) else False
    return out & (side > 0)


def suffix_rows(open_docs: DataFrame) -> DataFrame:
    """The suffixes at the anchors of the open runs: ``_suffix`` from the gram on, ``_left`` before it.

    ``_low`` and ``_high`` bound how far left of the gram the run's windows start. Runs of one text
    that agree in all of this are one row with the places of their anchors, ``_at``. Bytes beyond
    the text are 0; no window of the row reaches them.
    """
    names, lists = ["_suffix", "_left", "_low", "_high", "_doc", "_tag", "_at"], pa.list_(pa.int64())
    before = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2 << 20):
            texts = batch.column("_text").cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            edge = b"\0" * LENGTH
            data = np.frombuffer(edge + edge.join(texts.to_pylist()) + edge, np.uint8)
            base = np.cumsum(sizes + LENGTH) - sizes
            owner, runs = pc.list_parent_indices(batch.column("_runs")).to_numpy(), batch.column("_runs").flatten()
            start, end, anchor = (runs.field(n).to_numpy() for n in ("_start", "_end", "_anchor"))
            # Texts whose tags agree by chance share a list, so a place may lie behind the end.
            end = np.minimum(end, sizes[owner] - LENGTH + 1)
            owner, start, end, anchor = (x[(end > start) & (anchor >= start)] for x in (owner, start, end, anchor))
            if not len(owner):
                continue
            at = base[owner] + anchor
            low, high = anchor - end + 1, anchor - start
            around = Rolling(data).between(at - before, at + LENGTH) ^ mixed((low * 64 + high).astype(np.uint64))
            order = np.lexsort((anchor, owner, around))
            fresh = np.flatnonzero(np.concatenate([[True], (around[order][1:] != around[order][:-1]) | (owner[order][1:] != owner[order][:-1])]))
            first = order[fresh]
            view = np.lib.stride_tricks.sliding_window_view
            pieces_ = [np.ascontiguousarray(view(data, LENGTH)[at[first]]), np.ascontiguousarray(view(data, before)[at[first] - before])]
            sent = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary()) for x in pieces_]
            numbers = [pa.array(x[first], pa.int32()) for x in (low, high)]
            doc, tag = (batch.column(n).to_numpy()[owner[first]] for n in ("_doc", "_tag"))
            places = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(order)).astype(np.int32)), pa.array(anchor[order]))
            yield pa.record_batch([*sent, *numbers, pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), places.cast(lists)], names=names)

    return open_docs.mapInArrow(run, "_suffix binary, _left binary, _low int, _high int, _doc long, _tag int, _at array<long>")


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian words: the characters of the multikey quicksort."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row but the first shares with the row before."""
    equal = rows[1:] == rows[:-1]
    return np.where(equal.all(axis=1), rows.shape[1], equal.argmin(axis=1))


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows: three-way partition on one word, and on to the next word for the equal part."""
    order, todo, done = np.arange(len(words)), [(0, len(words), 0)], words.shape[1]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == done:
            continue
        rows = order[low:high]
        if high - low <= LEAF:
            order[low:high] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        column = words[rows, depth]
        pivot = np.partition(column[:: max(1, len(column) // 63)], 31)[31] if len(column) > 63 else column[0]
        less, equal = column < pivot, column == pivot
        order[low:high] = np.concatenate([rows[less], rows[equal], rows[~(less | equal)]])
        a, b = low + int(less.sum()), low + int(less.sum() + equal.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def sorted_buckets(suffixes: DataFrame, width: int) -> DataFrame:
    """Spans of windows that an earlier document has, and windows left to compare across buckets.

    Spark samples the splitters of the range partitioning (salted, so that a suffix that very many
    texts share is cut as well). A bucket is sorted by multikey quicksort and neighbours are
    compared: windows that start ``a`` bytes left of the gram are equal where suffixes share
    ``LENGTH - a`` bytes and the ``a`` bytes before them. What shares that much with the first or
    last suffix of a bucket may go on in the next one: there the windows of the first document come
    back with their bytes in ``_window``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = list(batches)
        if not sent or not sum(b.num_rows for b in sent):
            return
        table = pa.Table.from_batches(sent).combine_chunks()
        suffix, left = (np.frombuffer(b"".join(table[n].to_pylist()), np.uint8).reshape(len(table), -1) for n in ("_suffix", "_left"))
        order = multikey_quicksort(as_words(suffix))
        suffix, left = suffix[order], left[order]
        doc, tag, low, high = (table[n].to_numpy()[order] for n in ("_doc", "_tag", "_low", "_high"))
        places = table["_at"].combine_chunks().take(pa.array(order))
        row, place = pc.list_parent_indices(places).to_numpy(), pc.list_flatten(places).to_numpy()
        first = np.searchsorted(row, np.arange(len(order)))
        many = np.append(first[1:], len(row)) - first
        together = common_prefixes(suffix)
        before = np.zeros(len(order), np.uint64)  # hash of the a bytes before the gram
        found, cross = [], []
        for a in range(LENGTH - GRAM + 1):
            if a:
                before = (before + left[:, -a].astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
            here = np.flatnonzero((low <= a) & (a <= high))
            if not len(here):
                continue
            group = np.concatenate([[0], np.cumsum(together < LENGTH - a)])
            late = earlier_here(doc[here], before[here], group[here])
            at_edge = (group[here] == 0) | (group[here] == group[-1])
            for which, into in ((here[late], found), (here[~late & at_edge], cross)):
                n = many[which]
                at = np.repeat(first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                into.append((row[at], place[at] - a, np.full(len(at), a)))
        for pieces_, windows in ((found, False), (cross, True)):
            if not pieces_:
                continue
            at, start, a = (np.concatenate(x) for x in zip(*pieces_, strict=True))
            if windows:
                both = np.concatenate([left[at], suffix[at]], axis=1)
                index = (LENGTH - GRAM - a)[:, None] + np.arange(LENGTH)
                bytes_ = np.ascontiguousarray(np.take_along_axis(both, index, axis=1))
                told = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(at), [None, pa.py_buffer(bytes_)]).cast(pa.binary())
                columns = [doc[at], tag[at], start, start + LENGTH]
            else:
                columns = joined_spans(doc[at], tag[at], start, start + LENGTH)
                told = pa.nulls(len(columns[0]), pa.binary())
            batch = spans_batch(columns, pa.nulls)
            yield pa.record_batch([*batch.columns[:4], told], names=["_doc", "_tag", "_start", "_end", "_window"])

    salted = suffixes.repartitionByRange(width, "_suffix", F.xxhash64("_doc", "_left"))
    return salted.mapInArrow(run, SPANS + ", _window binary")


def across_buckets(windows: DataFrame) -> DataFrame:
    """Spans of the windows that an earlier document has in another bucket."""
    lowest = windows.groupBy("_window").agg(F.min("_doc").alias("_lowest"))
    return windows.join(lowest, "_window").where("_doc > _lowest").select("_doc", "_tag", "_start", "_end")


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, n_bytes, spans, kept`` of every row: the bytes left, and the runs of bytes taken out.

    A byte goes when a string of 50 bytes over it also starts in a row with a smaller key; strings
    are judged on the whole input and never cross rows. Rows with the same key don't take from each
    other; a null key (or the largest long) counts as larger than all others and comes back as null;
    null texts are empty; texts under 50 bytes stay as they are. Texts are bytes here, so a cut may
    fall inside a character.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(df, id_col, text_col)
    rows = rows.select(F.coalesce("_id", F.lit(LAST)).alias("_doc"), F.pmod(F.xxhash64("_text"), F.lit(1 << TAG_BITS)).cast("int").alias("_tag"), "_text")
    keys = ["_doc", "_tag"]
    found = settle(compared_runs(run_rows(rows), width), "runs")
    opened = found.where("_anchor is not null").groupBy(keys).agg(F.collect_list(F.struct("_start", "_end", "_anchor")).alias("_runs"))  # of one text
    suffixes = settle(suffix_rows(rows.join(opened, keys).select("_doc", "_tag", "_text", "_runs")), "suffixes")
    buckets = settle(sorted_buckets(suffixes, width), "buckets")
    parts = [found.where("_anchor is null").drop("_anchor"), buckets.where("_window is null").drop("_window"), across_buckets(buckets.where("_window is not null"))]
    spans = reduce(DataFrame.unionByName, parts).groupBy(keys).agg(F.collect_list(F.struct("_start", "_end")).alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, taken, kept = [], [], []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                data = text.encode()
                merged = []
                for start, end in sorted((s["_start"], s["_end"]) for s in spans or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                sizes.append(len(data))
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                taken.append([{"start": a, "end": b} for a, b in merged])
            ids = pc.if_else(pc.equal(batch.column("_doc"), LAST), pa.scalar(None, pa.int64()), batch.column("_doc"))
            yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(taken, kind), pa.array(kept, pa.binary())], names=["_id", "n_bytes", "spans", "kept"])

    whole = rows.join(spans, keys, "left").select("_doc", "_text", "_spans")
    return whole.mapInArrow(cut, "_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
