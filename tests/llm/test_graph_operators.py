"""Whitening, link trust and conversation repair against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import catalog, link_trust, turn_lattice, turn_repair, whitening
from quarrylight.llm.catalog import URL_RULES

# ---------------------------------------------------------------- whitening

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("_x", T.StringType()), T.StructField("_id", T.IntegerType())])


def plain_whitening(vectors, wanted=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x], dtype=float)
    cov = d.T @ d / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:wanted]
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x], values[order], d @ axes[:, order] / np.sqrt(values[order]), np.trace(cov)


def test_whitening_against_dense_eigenvectors(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    ids = sorted(vectors)
    deviation, values, white, trace = plain_whitening([vectors[i] for i in ids])
    got = catalog.QUERIES["op11_jacobi_davidson"](spark, folder).collect()
    assert len(got) == 32 * len(ids)
    mine = np.zeros_like(white)
    for r in got:
        row, place = ids.index(r["vec_id"]), r["component"] - 1
        mine[row, place] = r["whitened"]
        assert r["deviation"] == deviation[row] and r["n"] == len(ids)
        assert r["explained"] == pytest.approx(values[place] / trace, rel=1e-10)
        assert r["identity_error"] < 1e-10
    signs = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * signs - white).max() < 1e-8


def test_whitening_leaves_out_what_is_no_vector(spark):
    draw = random.Random(3)
    good = [[draw.gauss(0, 3) for _ in range(5)] for _ in range(40)]
    rows = [(i, v, "clash", 1) for i, v in enumerate(good)] + [(1, good[1], None, 1), (None, good[2], None, 2)]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    frame = spark.createDataFrame(rows + [(100 + i, v, None, 0) for i, v in enumerate(bad)], VECTORS).repartition(3)
    got = whitening.whiten(frame).collect()
    kept = [v for _, v, *_ in rows]
    deviation, values, white, trace = plain_whitening(kept)
    assert len(got) == len(kept) * 5 and {r["component"] for r in got} == {1, 2, 3, 4, 5}
    assert sum(r["_id"] is None for r in got) == 5 and sum(r["_id"] == 1 for r in got) == 10
    assert sorted({r["deviation"] for r in got}) == sorted(set(deviation)) and all(r["n"] == len(kept) for r in got)
    assert sorted(abs(r["whitened"]) for r in got) == pytest.approx(sorted(np.abs(white).ravel()), abs=1e-8)


def test_whitening_of_flat_tables(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)], None, 0) for i in range(6)], VECTORS)
    got = whitening.whiten(frame).collect()
    assert {r["component"] for r in got} == {1} and {abs(r["whitened"]) for r in got} == {1.0}
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], None, 0)] * 3, VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, None, 0), (2, [], None, 0)], VECTORS)).count() == 0


def test_jacobi_davidson_restarts_and_ties():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((900, 260)) * np.linspace(3, 1, 260)
    cov = x.T @ x / 900
    values, vectors = whitening.jacobi_davidson(lambda b: cov @ b, 260, 12, block=20)
    want, axes = np.linalg.eigh(cov)
    assert np.abs(values - want[::-1][:12]).max() < 1e-12
    assert np.abs(np.abs((vectors * axes[:, ::-1][:, :12]).sum(axis=0)) - 1).max() < 1e-12
    equal = np.diag([5.0, 5.0, 5.0, 2.0, 1.0, 0.0])
    values, vectors = whitening.jacobi_davidson(lambda b: equal @ b, 6, 4, block=5)
    assert values == pytest.approx([5, 5, 5, 2]) and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_minres_solves_projected_equations():
    draw = np.random.default_rng(1)
    a = draw.standard_normal((30, 30))
    a = (a + a.T) / 2
    q, _ = np.linalg.qr(draw.standard_normal((30, 3)))
    off = lambda t: t - q @ (q.T @ t)
    rhs = off(draw.standard_normal((30, 2)))
    shift = np.array([0.3, -0.7])
    t = whitening.minres(lambda b: a @ b, shift, rhs, off, 200)
    assert np.abs(off(a @ t - t * shift) - rhs).max() < 1e-6 and np.abs(q.T @ t).max() < 1e-10


def test_large_entries_stay_exact():
    x = np.array([[1 << 61, 5], [(1 << 61) - 3, 9]], dtype=np.int64)
    sums = np.array([int(x[0, 0]) + int(x[1, 0]), 14], dtype=object)
    assert whitening.centred(x, 2, sums).tolist() == [[1.5, -2.0], [-1.5, 2.0]]
    assert whitening.deviations(x, 2, sums).tolist() == [9 + 16, 9 + 16]


# ---------------------------------------------------------------- links

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("trust", T.IntegerType())])


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_ranks(pages, damping=0.85):
    links, seeds = defaultdict(float), {"trust": defaultdict(list), "distrust": defaultdict(list)}
    for _, url, html in pages:
        host, path = split_url(url)
        if not host:
            continue
        verdict = plain_rule(host, path)[1]
        seeds["trust"][host].append(verdict == "allow")
        seeds["distrust"][host].append(verdict == "block")
        html = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ", html or "")
        for to in re.findall(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]*)""", html):
            if to.startswith("//"):
                to = split_url("x:" + to)[0]
            elif "://" in to:
                to = split_url(to)[0]
            else:
                to = "" if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", to) else host
            if to and to != host:
                links[host, to] += 1
    nodes = sorted({h for pair in links for h in pair} | set(seeds["trust"]))
    at = {h: i for i, h in enumerate(nodes)}
    out = {}
    for walk in ("trust", "distrust"):
        m = np.zeros((len(nodes), len(nodes)))
        for (a, b), n in links.items():
            i, j = (at[a], at[b]) if walk == "trust" else (at[b], at[a])
            m[i, j] += n
        for i in range(len(nodes)):
            m[i] = m[i] / max(m[i].sum(), 1)
        s = np.array([np.mean(seeds[walk].get(h, [0])) for h in nodes])
        out[walk] = np.linalg.solve(np.eye(len(nodes)) - damping * m.T, s)
    return {h: (out["trust"][at[h]], out["distrust"][at[h]]) for h in nodes}


def linked_pages():
    def page(*to):
        return "<html><!-- <a href='http://hidden.net/'> --><script>'<a href=\"http://hidden.net/\">'</script>" + "".join(f'<a class="x" href="{t}">t</a>' for t in to)

    return [
        (1, "http://good.example.net/en/1", page("http://friend.info/x", "/en/2", "//Friend.info")),
        (2, "http://good.example.net/en/2", page("/en/1")),
        (3, "https://friend.info/", page("https://second.info:80/a?b", "mailto:x@y", "#top")),
        (4, "http://bad.net/x", page("http://worse.net/")),
        (5, "http://feeder.info/a", page("http://bad.net/", "HTTP://BAD.NET/2", "http://worse.net/q")),
        (6, "http://feeder.info/b", page("http://bad.net/y")),
        (7, "http://behind.info/b", page("http://feeder.info/y", "/own")),
        (8, "http://x.example.com/de/1", None), (9, "http://x.example.com/en/1", ""), (9, "http://x.example.com/en/1", ""),
        (10, "http://lonely.example.com/fr/?q", page()), (11, None, page("http://friend.info/")), (12, "no scheme", None), (None, "http://a.org/fr/x", None),
        (13, "http://A.ORG", page("http://other.org/fr")), (14, "http://example.net/en/", None), (15, "http://notexample.net/en/", None), (16, "http://u.net?x=/de/", None),
        (17, "ftp://w.example.com/de/://b", page("x" * 30_000)), (18, "http://second.info:80/", None), (19, "", None), (20, "://", None),
    ]


def test_link_trust_against_solved_equations(spark):
    pages = linked_pages()
    frame = spark.createDataFrame([(*p, "clash", 1) for p in pages], PAGES).repartition(3)
    got = link_trust.filter_urls(frame, URL_RULES, tolerance=1e-9).collect()
    ranks = plain_ranks(pages)
    want = []
    for key, url, _ in pages:
        host, path = split_url(url)
        rule, verdict = plain_rule(host, path)
        trust, distrust = ranks.get(host, (0.0, 0.0))
        want.append((key, host, path, rule, verdict or ("block" if distrust - trust >= 0.5 else "allow")))
        if rule is None:
            mine = next(r for r in got if r["page_id"] == key)
            assert mine["trust"] == pytest.approx(trust, abs=1e-6) and mine["distrust"] == pytest.approx(distrust, abs=1e-6)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=repr) == sorted(want, key=repr)
    by_host = {r["host"]: r["verdict"] for r in got if r["rule"] is None}
    assert by_host["feeder.info"] == "block" and by_host["friend.info"] == "allow" and by_host["x.example.com"] == "allow"
    assert link_trust.filter_urls(spark.createDataFrame([], PAGES), URL_RULES).count() == 0


def test_url_query_covers_every_page(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r["page_id"]: r for r in catalog.QUERIES["op12_link_trust"](spark, folder).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = split_url(p["url"])
        rule, verdict = plain_rule(host, path)
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if rule else ["allow", "block"])


# ---------------------------------------------------------------- conversations

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("audit", T.StringType()), T.StructField("_at", T.IntegerType())])
LEADS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def shortest(turns):
    """Cheapest edits, least letters first, by a search over (cost, letters); turns are (role, text, fault)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, i, state, out = heapq.heappop(heap)
        if i > len(turns):
            return cost, letters, out
        if (i, state) in seen:
            continue
        seen.add((i, state))
        talk = {r: to for r, to in LEADS[state].items() if r != "s"}
        names = {"u": "user", "a": "assistant"}
        if i == len(turns):
            if state in (0, 3):
                heapq.heappush(heap, (cost, letters, i + 1, state, out))
        else:
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state, out))
            if fault in (None, "truncated"):
                more = 3 if fault else 0
                if role[:1] in LEADS[state]:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, LEADS[state][role[:1]], (*out, f"{role}:{text}")))
                for r, to in talk.items():
                    heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, to, (*out, f"{names[r]}:{text}")))
        for r, to in talk.items():
            heapq.heappush(heap, (cost + 3, letters + "I", i, to, (*out, f"{names[r]}:")))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def plain_repair(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    found = {}
    for conv, turns in by.items():
        key = lambda t: hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], key(t)))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, out = shortest([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), out
    return found


def told(rows):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


def test_repair_query_against_search(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: result for conv, (result, _) in plain_repair(plain_damage(rows)).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert told(catalog.QUERIES["op13_auction_repair"](spark, folder).collect()) == {conv: want.get(conv, nothing) for conv, *_ in rows}


def hard_turns():
    draw = random.Random(5)
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", " \t\n"), (1, None, "system", "S."), (1, 9, None, None), (2, 0, "user", None), (3, 0, "", "x."), (3, 1, "User", "y!"), (3, 2, "assistant", "z?"), (None, 1, "user", "q?"), (None, 1, "assistant", "a."), (None, None, "assistant", "b."), (4, 5, "tool", "t" * 50_000), (4, 1 << 62, "assistant", "t\x0b\x0c"), (4, -(1 << 62), "user", "é?"), (5, 0, "system", "only."), (6, 3, "user", "tie."), (6, 3, "assistant", "tie."), (6, 3, "assistant", "other."), (7, 1, "assistant", "a\nb."), (7, 2, "user", "c:d.")]
    rows += [(8, t, draw.choice(["user", "assistant", "user", "assistant", "system", "x"]), draw.choice(["", "Yes.", "no", f"text {t}.", f"cut {t}"])) for t in range(700)]
    rows += [(9, 4, "user", "same.")] * 300
    return rows


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_repair_of_hard_turns(spark, coalesce):
    """With coalescing off a long conversation lies in several tasks as runs of its own."""
    rows = hard_turns()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURNS).repartition(5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        placed = turn_repair.placed_turns(frame)
        if coalesce == "false":
            assert placed.where("_conv = 8").select(F.shiftright("_at", 33).alias("p")).distinct().count() > 1
        got = told(turn_repair.repair(frame).collect())
        turns = turn_repair.repaired_turns(frame).collect()
    finally:
        spark.conf.set(name, before)
    want = plain_repair(rows)
    assert got == {conv: result for conv, (result, _) in want.items()}
    mine = defaultdict(list)
    for r in sorted(turns, key=lambda r: r["turn"]):
        mine[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {k: tuple(v) for k, v in mine.items()} == {k: out for k, (_, out) in want.items() if out}


def test_repair_of_an_empty_table(spark):
    assert turn_repair.repair_damaged(spark.createDataFrame([], TURNS)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = turn_repair.repair_damaged(spark.createDataFrame([(dropped, 0, "user", "x", None, 0)], TURNS)).collect()
    assert told(got) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_lattice_against_search():
    draw = random.Random(11)
    names = {0: "s", 1: "u", 2: "a", 3: "x"}
    for _ in range(400):
        odd = draw.random()
        codes = bytes((draw.randrange(4) if draw.random() < odd else 1 + i % 2) + draw.choice([0, 0, 0, 0, 4, 8, 12]) for i in range(draw.choice([0, 1, 2, 5, 9, 17, 40])))
        turns = [(names[c & 3], "", "blank" if c & 8 else "truncated" if c & 4 else None) for c in codes]
        cost, letters = turn_lattice.cheapest(codes)
        assert (cost, letters.translate(str.maketrans("JS", "IR"))) == shortest(turns)[:2]


def test_prices_of_an_auction_are_feasible_and_tight():
    codes = bytes([1, 5, 2, 9, 3, 2, 1, 6])
    lattice = turn_lattice.Lattice([turn_lattice.turn_arcs(c) for c in codes], turn_lattice.AT_END, True)
    lattice.auction(0)
    assert all(lattice.price[a] <= cost + lattice.price[b] for a, arcs in enumerate(lattice.arcs) for cost, b, _ in arcs)
    assert 0 in lattice.leading_to_end(lambda cost, a, b: lattice.price[a] == cost + lattice.price[b])
