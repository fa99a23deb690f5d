"""Token counts: batched encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import pick

SPACE = "▁"  # how the vocabulary writes a space; fixed by the library


@lru_cache(maxsize=2)
def encoder(path: str):
    """``(encode, splits)``: lengths of a list of texts, and whether texts may be cut before a word."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
        # A cut is exact if no piece spans it and the space it removes is what the library puts in front.
        splits = not any(SPACE in p.lstrip(SPACE) for p in pieces) and model.normalize(" a  b\n") == f"{SPACE*2}a{SPACE*2}b\n"
        return (lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]), splits
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return (lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]), False


def safe_parts(text: str, most: int) -> list[str]:
    """The text in parts of about ``most`` characters, cut at a space that follows a non-space.

    The cut removes that one space, which the encoder adds again in front of the next part. A
    stretch without such a space stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most:
        at = cut_before(text, start + 1, start + most)
        if at < 0:
            at = cut_after(text, start + most)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    parts.append(text[start:])
    return parts


def cut_before(text: str, low: int, high: int) -> int:
    at = text.rfind(" ", low, high)
    while at >= low and text[at - 1] in (" ", SPACE):
        at = text.rfind(" ", low, at)
    return at if at >= low else -1


def cut_after(text: str, low: int) -> int:
    at = text.find(" ", low, len(text) - 1)
    while at >= 0 and text[at - 1] in (" ", SPACE):
        at = text.find(" ", at + 1, len(text) - 1)
    return at


def lengths(texts: list[str], path: str, batch_bytes: int, part_chars: int) -> list[int]:
    encode, splits = encoder(path)
    counts, parts, owners, held = [0] * len(texts), [], [], 0

    def flush():
        for owner, n in zip(owners, encode(parts), strict=True):
            counts[owner] += n
        parts.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in safe_parts(text, part_chars) if splits and len(text) > part_chars else [text]:
            size = len(part) if part.isascii() else len(part.encode())
            if held + size > batch_bytes and parts:
                flush()
                held = 0
            parts.append(part)
            owners.append(i)
            held += size
    if parts:
        flush()
    return counts


def count_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 18, part_chars: int = 1 << 15
) -> DataFrame:
    """``_id, n_bytes, n_tokens, over_limit`` for every row, in one pass without a shuffle.

    ``path`` is a vocabulary file every machine has. Texts are encoded whole: batches hold about
    ``batch_bytes``, and longer texts are cut where the cut can't change the count. Null and empty
    texts have 0 tokens; repeated rows are counted each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = lengths(batch.column("_text").to_pylist(), path, batch_bytes, part_chars)
            yield pa.record_batch([batch.column("_id"), batch.column("_bytes"), pa.array(counts, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    rows = pick(df, id_col, text_col).withColumn("_bytes", F.octet_length("_text").cast("long"))
    counted = rows.mapInArrow(run, "_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
