"""Secret scans: fixed shapes, and what a primed compressor finds new in a sensitive context."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quarrylight.llm.common import pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows them sensitive.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api", "key", "auth", "bearer", "credential", "signature", "private", "session", "cookie", "login")
CONTEXT = re.compile(rf"(?:{'|'.join(CONTEXT_WORDS)})[a-z_]*", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: What candidates are made of.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=.-"
#: Identifiers that code is full of; together with the text around a candidate they prime the compressor.
IDENTIFIERS = (
    "password username authorization authentication credentials access_token refresh_token client_secret client_id api_key secret_key "
    "private_key public_key session_id cookie signature certificate environment configuration settings default localhost production "
    "development database connection string endpoint service account request response header content application json https http www "
    "import export function return class public static final void const let var self this true false null none example 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each fixed shape, in code points, too short ones dropped."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes the candidate adds when the compressor already knows the identifiers and the text around it."""
    prime = zstandard.ZstdCompressionDict(f"{IDENTIFIERS}\n{after}\n{before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=19, dict_data=prime, write_content_size=False, write_dict_id=False)
    return len(squeeze.compress(candidate.encode())) - len(squeeze.compress(b""))


@lru_cache(1 << 14)
def random_bytes(kinds: int, length: int) -> int:
    """Bytes a random string of so many different symbols adds: long ones pack into the bits of a symbol."""
    return marginal_bytes("".join(random.Random(length).choices(SYMBOLS[:kinds], k=length)), "", "")


def bytes_at_random(candidate: str) -> float:
    """Bytes the candidate would add if it were random in its own symbols, one a character at most."""
    length, kinds = len(candidate), max(10, len(set(candidate)))
    return min(length, random_bytes(kinds, length) if length <= 4096 else random_bytes(kinds, 4096) * length / 4096)


def novel_spans(text: str, taken: list[tuple[int, int, str]], least: float, reach: int, around: int) -> list[tuple[int, int, str]]:
    """Strings close behind a sensitive word, or behind a secret found there, that hardly compress."""
    spans, done = [], 0
    for word in CONTEXT.finditer(text):
        limit, at = word.end() + reach, max(done, word.end())
        while (near := CANDIDATE.search(text, at, limit + 16)) and near.start() < limit:
            start, end = CANDIDATE.match(text, near.start()).span()  # the run may go on behind the reach
            value, at, done = text[start:end], end, max(done, end)
            if any(a < end and start < b for a, b, _ in taken):
                limit = end + reach
            elif marginal_bytes(value, text[max(0, start - around) : start], text[end : end + around]) >= least * bytes_at_random(value):
                spans.append((start, end, "novel"))
                limit = end + reach  # keys of many lines
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, reach: int = 60, around: int = 400) -> DataFrame:
    """``_id, n_assign, n_access, n_hex, base_spans, spans`` for every row, in one pass without a shuffle.

    Spans are ``kind:start:end`` in code points. ``novel`` spans are strings of 16 characters or more
    within ``reach`` of a sensitive word, or of the end of a secret found there, that add, when the compressor is primed with ``around`` characters on both sides
    and a list of identifiers, at least ``least`` of the bytes that a random string of as many
    characters and different symbols adds (of one byte a character, if that is less); strings that a base
    span covers are not told twice. Null and empty texts have no spans; texts are scanned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column("_text").to_pylist():
                found = base_spans(text)
                base.append(found)
                lower = text.lower()
                more.append(found + (novel_spans(text, found, least, reach, around) if any(w in lower for w in CONTEXT_WORDS) else []))
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS[:3]]
            texts = [pa.array(map(joined, spans), pa.string()) for spans in (base, more)]
            yield pa.record_batch([batch.column("_id"), *counts, *texts], names=["_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return pick(df, id_col, text_col).mapInArrow(run, "_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")
