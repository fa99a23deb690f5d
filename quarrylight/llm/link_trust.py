"""URL filters: host and path rules first, then trust and distrust carried along links between hosts.

Hosts that have pages allowed by a rule are trusted seeds, hosts that have blocked pages are blocked
seeds; a seed weighs the share of its pages the rules decide that way. Trust is personalised PageRank
along links, distrust the same against them (who links to blocked hosts is suspect). Ranks are in units
of one full seed and not divided by the number of hosts, so one threshold serves any size: a host that no
other reaches has exactly its own shares.

* A null url, or one without ``://``, has an empty host and path, meets no rule and is allowed.
* Null html has no links. Comments, scripts and styles hold none either.
* Repeated pages count as often as they occur; null ``page_id`` is a key like any other.
* Empty tables give empty results. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.session import settle

#: ``(verdict, host, path)``: fits the host and its subdomains where the url's path starts with ``path``.
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]*)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    rest = F.coalesce(after_scheme(F.col(url)), F.lit(""))
    return pages.withColumns({"_host": host_of(rest), "_path": path_of(rest)})


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct ``rule, verdict``; null where none fits.

    The rules are part of the plan, so they are a list for a configuration, not a table of millions.
    """
    fits = []
    for verdict, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        here = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        fits.append(F.when(here, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: how often pages of a host link to a host; relative links lead to the page's own.

    Pairs are counted on the map side, so neither a hot host nor a hot target gathers its pages.
    """
    visible = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), HIDDEN, " ")
    links = pages.where("_host <> ''").select(F.col("_host").alias("src"), F.explode_outer(F.regexp_extract_all(visible, F.lit(ANCHOR), 1)).alias("to"))
    to = F.col("to")
    across = F.when(to.startswith("//"), host_of(F.substring(to, 3, F.length(to)))).when(F.instr(to, "://") > 0, host_of(after_scheme(to)))
    other_scheme = to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    target = F.coalesce(across, F.when(~other_scheme, F.col("src")))
    return links.where(to.isNotNull()).select("src", target.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _shares(links: DataFrame) -> DataFrame:
    """Both walks: ``walk, node, dst, share`` where the shares of a node's steps add up to one."""
    both = links.select(F.lit("trust").alias("walk"), F.col("src").alias("node"), "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("node"), F.col("src").alias("dst"), "n")
    )
    total = both.groupBy("walk", "node").agg(F.sum("n").alias("total"))
    return both.join(total, ["walk", "node"]).select("walk", "node", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, trust, distrust)``; hosts no mass reaches are left out.

    Solves ``r = seed + damping * sum(share * r)`` for both walks at once: personalised PageRank in units of what one
    full seed gives itself. Links within a host tell nothing of others and aren't walked; mass that reaches a
    host without links ends there. Each round is one join and one aggregation; its ranks are a written table, so a
    lost executor costs one round at most. Ends when no rank moves by more than ``tolerance``.
    """
    shares = settle(_shares(links.where("src <> dst")), "host-shares")
    walks = F.array(*(F.struct(F.lit(w).alias("walk"), F.col("host").alias("node"), F.col(w).alias("seed")) for w in ("trust", "distrust")))
    given = settle(seeds.select(F.explode(walks).alias("s")).select("s.*").where("seed > 0"), "host-seeds")
    ranks = given.select("walk", "node", F.col("seed").alias("rank"))
    while True:
        came = shares.join(ranks, ["walk", "node"]).groupBy("walk", F.col("dst").alias("node")).agg((damping * F.sum(F.col("share") * F.col("rank"))).alias("rank"))
        zero = F.lit(0.0)
        parts = given.select("walk", "node", F.col("seed").alias("rank"), zero.alias("was")).unionByName(came.withColumn("was", zero))
        parts = parts.unionByName(ranks.select("walk", "node", zero.alias("rank"), F.col("rank").alias("was")))
        after = settle(parts.groupBy("walk", "node").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "host-ranks")
        ranks = after.select("walk", "node", "rank")
        if after.where(F.abs(F.col("rank") - F.col("was")) > tolerance).isEmpty():
            break
    by_walk = [F.coalesce(F.max(F.when(F.col("walk") == w, F.col("rank"))), F.lit(0.0)).alias(w) for w in ("trust", "distrust")]
    return ranks.groupBy(F.col("node").alias("host")).agg(*by_walk)


def judge_hosts(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 0.5) -> DataFrame:
    """``host, trust, distrust, blocked``: blocked where distrust exceeds trust by ``threshold`` or more."""
    ruled = with_host_and_path(pages).withColumn("_fits", longest_rule(F.col("_host"), F.col("_path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("_fits.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.where("_host <> ''").groupBy(F.col("_host").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(host_links(ruled), seeds, damping, tolerance)
    return ranks.withColumn("blocked", F.col("distrust") - F.col("trust") >= threshold)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 0.5) -> DataFrame:
    """Every page with ``host, path, rule, verdict, trust, distrust``.

    Pages a rule decides never meet the host table; the others join it by host, where adaptive
    execution broadcasts a small table and splits a hot host of a large one.
    """
    pages = pages.select("page_id", "url", "html")
    hosts = settle(judge_hosts(pages, rules, damping, tolerance, threshold), "host-verdicts")
    placed = with_host_and_path(pages.select("page_id", "url"))
    placed = placed.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), longest_rule(F.col("_host"), F.col("_path"), rules).alias("_fits"))
    nothing = F.lit(None).cast("double")
    ruled = placed.where("_fits IS NOT NULL").select("page_id", "host", "path", "_fits.rule", "_fits.verdict", nothing.alias("trust"), nothing.alias("distrust"))
    open_pages = placed.where("_fits IS NULL").join(hosts, "host", "left")
    verdict = F.when(F.col("blocked"), "block").otherwise("allow")
    rank = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    return ruled.unionByName(open_pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), rank("trust"), rank("distrust")))
