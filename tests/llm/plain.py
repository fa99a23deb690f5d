"""Plain versions of the operators, one document at a time, and rows that are hard to handle."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_id", T.StringType()),
        T.StructField("_text", T.StringType()), T.StructField("_row", T.IntegerType()), T.StructField("size", T.IntegerType()),
        T.StructField("_key", T.StringType()), T.StructField("copies", T.StringType()), T.StructField("hits", T.StringType()),
    ]
)


def prose(seed, n, words=400):
    draw = random.Random(seed)
    return " ".join("w%d" % draw.randrange(words) for _ in range(n))


def hard_texts():
    passage = prose(99, 70)
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (1, base), (2, near), (3, base), (3, base), (4, base.replace(" ", "  ")), (5, None), (None, base), (6, ""), (7, "   \n\t "),
        (8, "one two"), (9, prose(2, 30) + " " + passage + " " + prose(3, 30)), (10, prose(4, 10) + " " + passage), (11, "é" * 60 + " " + passage),
        (None, None), (12, prose(5, 30_000)), (13, "ab " * 4000), (14, 'token = "abcdef0123456789abcdef0123456789" x'), (15, prose(6, 90) + "\nshared line\n" + prose(7, 9)),
        (16, "\nshared line"), (17, "x" * 3000), (18, "a<s>b</s>  c▁▁d \n\n e"), (15, prose(8, 20)), (19, "ab " * 4001),
    ]


def hard_rows():
    rows = []
    for n, (key, text) in enumerate(hard_texts()):
        source = None if n % 7 == 3 else f"src{n % 5}"
        rows.append((key, text, None if n % 4 == 0 else "en", source, len(text or ""), f"x{n}", "clash", n, 3, "k", "many", "none"))
    return rows


def hard_frame(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def fold(key, parts):
    return zlib.crc32(("" if key is None else str(key)).encode()) % parts


def unigram(rows, held):
    counts = Counter()
    for key, text in rows:
        if not held(key):
            counts.update([*words((text or "").encode().lower().decode()), b""])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for key, text in rows:
        w = [*words((text or "").encode().lower().decode()), b""]
        out.append((key, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)))
    return out


def classes(rows, threshold=0.8):
    """Class (smallest row number) and links of every row; rows without words are copies of each other."""
    sets = [shingles(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(rows))], links


def cut_substrings(rows, size=50):
    first = {}
    big = 1 << 63
    for key, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - size + 1):
            first[data[s : s + size]] = min(first.get(data[s : s + size], big), big - 1 if key is None else key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - size + 1):
            if first[data[s : s + size]] < (big - 1 if key is None else key):
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, y in zip(data, gone) if not y)
        spans = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def site_lines(rows, least):
    """Kept text of ``(key, text, site)`` rows."""
    sites, first = defaultdict(set), {}
    for key, text, site in rows:
        for line in (text or "").split("\n"):
            line = line.strip(" ")
            if line:
                sites[line].add(site or "")
                if key is not None:
                    first[line] = min(first.get(line, key), key)
    out = []
    for key, text, _ in rows:
        keep = []
        for line in (text or "").split("\n"):
            bare = line.strip(" ")
            gone = bare and len(sites[bare]) >= least and bare in first and (key is None or key > first[bare])
            if not gone:
                keep.append(line)
        out.append((key, "\n".join(keep)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
