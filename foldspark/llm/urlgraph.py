"""URL filters: rules by host and path, else trust and distrust propagated over the host link graph.

Rules: a rule (host, path, verdict) fits a host and all its subdomains where the url's path starts with the rule's. The longest fitting rule wins (host and
path together; of equal length block before allow).

Method for urls that no rule fits: host edges come from the absolute and protocol-relative links of the pages' href attributes. Trust is personalised PageRank along
the edges from trusted seeds, distrust the same along the reversed edges from blocked ones. A seed is a host of whose urls the rules allow, or block, more than ``seed_share``; its
weight is that share, each vector's weights sum to one, and every round gives the seeds their restart share anew. Mass that reaches a host without out-edges is dropped. A host is blocked
whose distrust is at least ``floor`` of one wholly blocked host's weight (distrust times the sum of all blocked seeds' shares, which does not change as other hosts are added) and more than
``ratio`` times its trust; any other is allowed. Links within a host are no edges.

Only DataFrame functions: pages are scanned once for rules and once for links, and meet only per-host aggregates. Rank vectors are as long as the host list, written to the
shared folder every few rounds. Hosts join to pages by an equi-join; a host with more than a thousandth of all urls is dealt over several keys.

Defined cases: a url that is null or has no ``://`` has empty host and path; no rule fits it and it is allowed (the empty host has no edges and is no seed). Only the first ``://`` counts: where
``?`` or ``#`` follows the host the path is empty, whatever comes behind. A null html has no links. A rule given twice with both verdicts blocks. Repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm.shared import Scratch, hot_join

DAMPING = 0.85
ROUNDS = 12
#: Rounds between two writes of the rank vectors.
CUT = 4
#: Least distrust, in units of one wholly blocked seed host.
FLOOR = 1e-4
RATIO = 1.0
#: A host with more than this share of its urls allowed (or blocked) by rules is a seed.
SEED_SHARE = 0.5
#: Rules up to this number become one expression; more are joined by host suffix.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^"'\s>]*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where the host is not followed by ``/``."""
    # the last group takes what is there, nothing too, so that the match never moves on to a later ://
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _order(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Longest first; of equal length block first, then by name."""
    return sorted({(h, p, v) for h, p, v in rules}, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))


def _inline(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in rules]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, rules, strict=True)], F.lit(None).cast("string"))
    said = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, rules, strict=True)], F.lit(None).cast("string"))
    return urls.withColumn("rule", rule).withColumn("said", said)


def _joined(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same by an equi-join of the distinct hosts' suffixes with the rules; a host keeps the rules that may fit its urls, in order."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, h, p, v) for i, (h, p, v) in enumerate(rules)], "k int, suffix string, p string, v string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = urls.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix")
    own = own.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "suffix", "p", "v"))).alias("own"))
    first = F.get(F.filter("own", lambda x: F.col("path").startswith(x["p"])), 0)
    out = urls.join(own, "host", "left").withColumn("hit", first)
    return out.withColumn("rule", F.concat("hit.suffix", "hit.p")).withColumn("said", F.col("hit.v")).drop("own", "hit")


def apply_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (host, path, ...) with rule and said (the rule's verdict), both null where no rule fits."""
    order = _order(rules)
    if not order:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("said", F.lit(None).cast("string"))
    return _inline(urls, order) if len(order) <= INLINE_RULES else _joined(urls, order)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): links between different hosts, each with its share of the source's linked hosts by number of links."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = links.select("src", host_of(link).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, *, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank over ``edges`` (src, dst, n) from ``seeds`` (host, weight; weights sum to one)."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = scratch.table(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    rank = seeds.select("host", F.col("weight").alias("rank"))
    for k in range(rounds):
        moved = rank.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
        moved = moved.unionByName(seeds.select("host", (F.lit(1 - damping) * F.col("weight")).alias("rank")))
        rank = moved.groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % CUT == CUT - 1:
            rank = scratch.table(rank, "rank")
    return rank


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    floor: float = FLOOR,
    ratio: float = RATIO,
    seed_share: float = SEED_SHARE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages`` (page_id, url, html); ``rules``: (host, path, verdict)."""
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    judged = apply_rules(pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    hosts = judged.groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"), F.count("*").alias("n"))
    hosts = scratch.table(hosts, "hosts")
    edges = scratch.table(host_edges(pages), "edges")
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    ranks, totals = [], {}
    for name, column, graph in (("trust", "allowed", edges), ("distrust", "blocked", flipped)):
        share = F.col(column) / F.col("n")
        seeds = hosts.where((F.col(column) > 0) & (share > seed_share)).select("host", share.alias("w"))
        totals[name] = float(seeds.agg(F.sum("w")).first()[0] or 1.0)
        seeds = scratch.table(seeds.select("host", (F.col("w") / F.lit(totals[name])).alias("weight")), "seeds")
        ranks.append(propagate(graph, seeds, scratch, damping=damping, rounds=rounds).withColumnRenamed("rank", name))
    scores = scratch.table(reduce(lambda x, y: x.join(y, "host", "full"), ranks).na.fill(0.0, ["trust", "distrust"]), "scores")
    out = hot_join(judged, scores, ["host"], hosts, ["page_id", "path"]).na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") * F.lit(totals["distrust"]) >= floor) & (F.col("distrust") > ratio * F.col("trust"))
    verdict = F.coalesce("said", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    scratch.keep(scores)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"))
