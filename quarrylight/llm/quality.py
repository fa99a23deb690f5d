"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import by_bytes, pick, short_batches

PASSAGE_WORDS = 64
#: Byte classes: lower case, upper case, digits, control, beyond ASCII, and every other ASCII character by itself.
_OTHERS = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASSES = 5 + len(_OTHERS)
CLASS_OF = np.full(256, 4, np.int64)
CLASS_OF[:33] = CLASS_OF[127] = 3
for _b in range(33, 127):
    CLASS_OF[_b] = 0 if chr(_b).islower() else 1 if chr(_b).isupper() else 2 if chr(_b).isdigit() else 5 + _OTHERS.index(_b)
FEATURES = CLASSES + 4


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of passages of each text (at least one)."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = pc.list_flatten(split)
    real = pc.not_equal(words, "")
    owner = pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)]
    words = words.filter(real)
    per_text = np.bincount(owner, minlength=len(texts))
    counts = np.maximum(1, -(-per_text // PASSAGE_WORDS))
    first_word = np.concatenate([[0], np.cumsum(per_text)])[owner] if len(owner) else np.zeros(0, np.int64)
    passage = np.concatenate([[0], np.cumsum(counts)])[owner] + (np.arange(len(owner)) - first_word) // PASSAGE_WORDS if len(owner) else first_word
    total = int(counts.sum())
    lengths = pc.binary_length(words).to_numpy().astype(np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    seen = np.bincount(np.repeat(passage, lengths) * CLASSES + CLASS_OF[data], minlength=total * CLASSES).reshape(total, CLASSES)
    size = np.maximum(1, seen.sum(axis=1))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    n = np.bincount(passage, minlength=total)
    distinct = np.bincount(np.unique(passage * max(1, len(codes)) + codes) // max(1, len(codes)), minlength=total) if len(codes) else n
    again = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    repeated = np.bincount(passage[1:][again], minlength=total)
    shape = [distinct / np.maximum(1, n), repeated / np.maximum(1, n), size / np.maximum(1, n) / 10.0, np.minimum(n, PASSAGE_WORDS) / PASSAGE_WORDS]
    return np.column_stack([np.sqrt(seen / size[:, None]), *shape]).astype(np.float32), counts


@dataclass
class AttentionModel:
    """h = tanh(Wx + b); a = softmax(w . (tanh(Vh) * sigmoid(Uh))) over the passages; score = sigmoid(c . sum(a h) + d)."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.weights, np.concatenate([[0], np.cumsum(bags)[:-1]])
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), bags))
        a = e / np.repeat(np.add.reduceat(e, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": sigmoid(z @ p["c"] + p["d"])}

    def scores(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)["score"]

    def gradients(self, x: np.ndarray, bags: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, bags)
        starts = np.concatenate([[0], np.cumsum(bags)[:-1]])
        out = (f["score"] - labels) / len(labels)
        dz = np.repeat(out[:, None] * p["c"], bags, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), bags))
        gate = de[:, None] * p["w"]
        dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "w": (de[:, None] * f["t"] * f["g"]).sum(axis=0), "c": f["z"].T @ out, "d": out.sum(keepdims=True),
        }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_bags(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, hidden: int = 16, gates: int = 8, steps: int = 200, rate: float = 0.03, decay: float = 1e-3) -> AttentionModel:
    """Adam on the mean log loss of whole bags; without bags the model says one half for everything."""
    draw = np.random.default_rng(7)
    shapes = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,), "c": (hidden,), "d": (1,)}
    weights = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k == "w" else np.zeros(s) for k, s in shapes.items()}
    if not len(bags):
        return AttentionModel(weights, np.zeros(FEATURES), np.ones(FEATURES))
    model = AttentionModel(weights, x.mean(axis=0), x.std(axis=0) + 0.02)
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in model.gradients(x, bags, labels).items():
            g = g + decay * weights[k] * (len(shapes[k]) == 2 or k in "wc")
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def encoded(rows: DataFrame) -> DataFrame:
    """``_id, _n, _x``: the number of passages of each text and their features, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            x, counts = passages(batch.column("_text"))
            flat = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]) * FEATURES), pa.array(x.reshape(-1)))
            yield pa.record_batch([batch.column("_id"), pa.array(counts, pa.int32()), flat.cast(pa.list_(pa.float32()))], names=["_id", "_n", "_x"])

    return rows.select("_id", "_text").mapInArrow(run, "_id long, _n int, _x array<float>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 2048, most_passages: int = 128) -> AttentionModel:
    """Learn from at most ``most_docs`` labelled documents (in hash order of the key) that ``usable`` allows.

    Only the fit is bounded: documents of more than ``most_passages`` passages are left out of it,
    so the driver holds at most ``most_docs * most_passages`` feature rows. Several labels of one
    key are averaged (1 from one half up); null labels and keys are not used.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable)
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most_docs)  # bounded: at most most_docs rows of two numbers
    rows = pick(docs, id_col, text_col).join(F.broadcast(chosen), "_id")
    bags = encoded(rows).where(F.col("_n") <= most_passages).join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "_n").limit(most_docs).toArrow()
    x = pc.list_flatten(bags["_x"]).to_numpy().astype(np.float64).reshape(-1, FEATURES)
    return fit_bags(x, bags["_n"].to_numpy().astype(np.int64), bags["_label"].to_numpy())


def score(df: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, score, predicted`` of every row: all passages of the whole text are encoded and weighed.

    Null and empty texts are one passage without words. Nothing but the text goes into a score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            found = model.scores(*passages(batch.column("_text")))
            yield pa.record_batch([batch.column("_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    return pick(df, id_col, text_col).mapInArrow(run, "_id long, score double, predicted int")


def accepted(df: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """The rows the model predicts 1 for, with the columns they came with."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1 << 20):
            texts = pc.fill_null(batch.column(text_col), "")
            yield batch.filter(pa.array(model.scores(*passages(texts)) >= 0.5))

    return df.mapInArrow(run, df.schema)
