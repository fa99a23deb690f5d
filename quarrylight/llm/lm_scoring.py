"""LM scoring: marginal probability of a text over all segmentations of its words into subwords."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import by_bytes, pick
from quarrylight.session import settle

#: The token that ends a text; no word is empty, so it can't clash.
END = ""
LN10 = math.log(10.0)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log weights from the scores the file states.

    The file's scores order the pieces by use; a piece of rank r weighs 1 / (r + 10). Word-start
    marks are dropped (a word is segmented by itself) and equal pieces add up.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[str, float] = {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lstrip("▁")
        score = model.get_score(i)
        if piece and score > -1e8:
            weights[piece] = weights.get(piece, 0.0) + 1.0 / (10.0 - score)
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


class Lattice:
    """All segmentations of a word into pieces; a character outside the vocabulary is a piece of its own."""

    def __init__(self, scores: dict[str, float], stop: float = 0.25, unknown: float = 1e-4):
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.unknown = math.log(unknown) - math.log(1_114_112)
        self.step, self.stop = math.log1p(-stop), math.log(stop) - math.log1p(-stop)

    def edges(self, word: str) -> list[list[tuple[int, str, float]]]:
        """For every end position, the pieces that end there: start, piece and log weight."""
        scores, prefixes, n = self.scores, self.prefixes, len(word)
        ends: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if word[i] not in scores:
                ends[i + 1].append((i, "", self.unknown + self.step))
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in prefixes:
                    break
                score = scores.get(piece)
                if score is not None:
                    ends[j].append((i, piece, score + self.step))
        return ends

    def forward(self, ends) -> list[float]:
        """Log-space forward recursion: log of the summed weight of all ways to reach each position."""
        at = [0.0]
        for arriving in ends[1:]:
            terms = [at[i] + w for i, _, w in arriving]
            top = max(terms)
            at.append(top if len(terms) == 1 else top + math.log(sum(math.exp(t - top) for t in terms)))
        return at

    def marginal(self, word: str) -> float:
        """Natural log of the word's probability, the stop after its last piece included."""
        return self.forward(self.edges(word))[-1] + self.stop

    def expected(self, word: str, into: dict[str, float]) -> None:
        """Add the expected number of times each piece is used in the word."""
        ends = self.edges(word)
        alpha = self.forward(ends)
        n, total = len(word), alpha[-1]
        beta = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            reach = beta[j]
            for i, piece, w in ends[j]:
                t = w + reach
                have = beta[i]
                beta[i] = t if have == -math.inf else (max(have, t) + math.log1p(math.exp(-abs(have - t))))
                if piece:
                    into[piece] = into.get(piece, 0.0) + math.exp(alpha[i] + t - total)


def packed(owner: np.ndarray, slots: np.ndarray, texts: int) -> list[bytes]:
    """Each text's places in order, as differences of seven bits a byte; the last byte of one is below 128."""
    width = int(slots.max()) + 1 if len(slots) else 1
    keys = np.sort(owner * width + slots)
    owner, slots = keys // width, keys % width
    steps = np.diff(slots, prepend=0)
    fresh = np.diff(owner, prepend=-1) != 0
    steps[fresh] = slots[fresh]
    sizes = 1 + sum((steps >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for n in range(5):
        more = sizes > n
        out[(ends - sizes)[more] + n] = ((steps[more] >> (7 * n)) & 127) | ((sizes[more] > n + 1) << 7)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=sizes, minlength=texts).astype(np.int64))])
    return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def unpacked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text each token is of and the token's place, from what ``packed`` made."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    within = np.arange(len(data)) - np.repeat(first, last - first + 1)
    steps = np.add.reduceat((data & 127).astype(np.int64) << (7 * within), first) if len(last) else last
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[last]
    sums = np.cumsum(steps)
    fresh = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner, sums - np.repeat(sums[fresh] - steps[fresh], np.diff(fresh, append=len(owner)))


def tokenized(rows: DataFrame, batch_bytes: int) -> DataFrame:
    """Blocks of texts as two kinds of rows: one per distinct word of a block, one per text.

    Word rows: ``_block, _slot, _word, _n`` (occurrences in training texts). Text rows: ``_block,
    _id, _held, _slots`` (the places of its tokens among the block's words, sorted and packed; common
    words have low places). A word that every text has is one row per block, so no word is hot later.
    """
    names = ["_block", "_slot", "_word", "_n", "_id", "_held", "_slots"]
    schema = "_block long, _slot int, _word string, _n long, _id long, _held boolean, _slots binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(by_bytes(batches, batch_bytes)):
            block = task << 32 | number
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("_text")))
            words = pc.list_flatten(split).dictionary_encode()
            slots, kinds = words.indices.to_numpy(), words.dictionary
            blank = pc.index(kinds, pa.scalar("", kinds.type)).as_py()
            owner = pc.list_parent_indices(split).to_numpy()
            if blank >= 0:  # what stands before a leading or after a trailing separator
                keep = slots != blank
                slots, owner = slots[keep], owner[keep]
            held = batch.column("_held").to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(slots, minlength=len(kinds)), kind="stable")[: len(kinds) - (blank >= 0)]
            place = np.zeros(len(kinds), np.int64)
            place[order] = np.arange(len(order))
            slots = place[slots]
            counts = np.bincount(slots[~held[owner]], minlength=len(order))
            n, m = len(order), batch.num_rows
            yield pa.record_batch(
                [pa.array([block] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), kinds.take(pa.array(order)), pa.array(counts, pa.int64())]
                + [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.binary())],
                names=names,
            )
            yield pa.record_batch(
                [pa.array([block] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())]
                + [batch.column("_id"), batch.column("_held"), pa.array(packed(owner, slots, m), pa.binary())],
                names=names,
            )

    return rows.mapInArrow(run, schema)


def expected_counts(words: DataFrame, path: str) -> dict[str, float]:
    """Expected uses of each piece over the distinct training words: at most one sum per vocabulary piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, sums = Lattice(vocabulary(path)), {}
        for batch in batches:
            for word in batch.column("_word").to_pylist():
                lattice.expected(word, sums)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["_piece", "_uses"])

    uses = words.where("_c > 0").select("_word").mapInArrow(run, "_piece string, _uses double")
    return dict(uses.groupBy("_piece").agg(F.sum("_uses")).collect())  # bounded by the vocabulary file


def refined(path: str, uses: dict[str, float], strength: float) -> dict[str, float]:
    """The file's weights moved towards the expected uses; ``strength`` is what the file counts for."""
    total = sum(uses.values()) + strength
    return {p: math.log((uses.get(p, 0.0) + strength * math.exp(s)) / total) for p, s in vocabulary(path).items()}


def score_texts(
    df: DataFrame, path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 8 << 20, strength: float = 1000.0
) -> DataFrame:
    """Log10 probability of every text, learned from the rows that ``held_out`` doesn't mark.

    Words are lower-cased (A-Z) and split at ASCII white space; one end follows. A word's lattice has
    every segmentation into vocabulary pieces and, beside them, the whole word as seen in training:
    P(w) = (c + a * L(w)) / (N + a + 1), where L is the marginal over segmentations and ``a`` is the
    number of words seen once (what new words are expected to weigh). The end has no segmentation and
    P = (c + 1) / (N + a + 1). Sums to one over all words, and a text is the product.

    Returns ``_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; one row per input
    row. Null and empty texts are one end; repeated rows count and are scored each; with no training
    rows everything is new. Words and their counts stay in tables; only sums per vocabulary piece
    and three totals reach the driver.
    """
    rows = pick(df, id_col, text_col, _held=F.coalesce(held_out, F.lit(False)))
    blocks = settle(tokenized(rows, batch_bytes), "lm-blocks")
    words = blocks.where("_slot is not null").groupBy("_word").agg(F.sum("_n").alias("_c"))
    words = settle(words, "lm-words")
    seen = words.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.count_if(F.col("_c") > 0).alias("v"), F.count_if(F.col("_c") == 1).alias("once")
    ).first()
    ends = blocks.where("_slots is not null and not _held").count()
    n, v, new = seen["n"] + ends, seen["v"] + (ends > 0), float(max(seen["once"], 1))
    scores = df.sparkSession.sparkContext.broadcast(refined(path, expected_counts(words, path), strength))
    per = math.log10(n + v + 1)
    whole = math.log10(n + new + 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(scores.value)
        for batch in batches:
            counts = batch.column("_c").to_numpy().astype(np.float64)
            logs = np.array([lattice.marginal(w) / LN10 for w in batch.column("_word").to_pylist()], np.float64) + math.log10(new)
            with np.errstate(divide="ignore"):
                logs = np.logaddexp(np.log(counts), logs * LN10) / LN10 if len(logs) else logs
            yield pa.record_batch([batch.column("_word"), batch.column("_c"), pa.array(logs - whole)], names=["_word", "_c", "_log"])

    valued = words.mapInArrow(mark, "_word string, _c long, _log double")
    values = blocks.where("_slot is not null").select("_block", "_slot", "_word").join(valued, "_word").select(F.col("_block").alias("_of"), "_slot", "_c", "_log")
    texts = blocks.where("_slots is not null").select("_block", "_id", "_held", "_slots")
    end = (math.log10(ends + 1) - per, math.log10(ends + 1) - whole, ends > 0)

    def total(texts: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        size = int(values["_slot"].max()) + 1 if len(values) else 0
        known, base, full = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        at = values["_slot"].to_numpy()
        c = values["_c"].to_numpy()
        known[at], base[at], full[at] = c > 0, np.log10(c + 1.0) - per, values["_log"].to_numpy()
        owner, slots = unpacked(list(texts["_slots"]))
        tokens, held = (np.bincount(owner, w, minlength=len(texts)) for w in (None, known[slots]))
        sums = [np.bincount(owner, w, minlength=len(texts)) for w in (base[slots], full[slots])]
        frame = pd.DataFrame({"n_tokens": tokens + 1, "n_known": held.astype(np.int64) + end[2], "train_tokens": n, "base_score": sums[0] + end[0], "score": sums[1] + end[1]})
        frame.insert(0, "held_out", texts["_held"].to_numpy())
        frame.insert(0, "_id", pd.array(texts["_id"], dtype="Int64"))
        return frame

    schema = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("_block").cogroup(values.groupBy("_of")).applyInPandas(total, schema)
