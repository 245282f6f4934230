"""Operator 6: URL filters by rules and by trust that spreads over the link graph.

A rule has a host and a path prefix; the longest that fits a URL decides. Other
URLs are judged by their host: personalised PageRank spreads trust from hosts
with allowed pages along links, and distrust from hosts with blocked pages
against them (who links to a bad host is suspect). Hosts link by the addresses in
their pages, absolute or without a scheme (a relative one stays on its host), and
every subdomain with its parent, down to names of two labels; parents and link
targets are nodes whether they have pages or not. A host whose distrust exceeds
its trust, and the threshold, is blocked.

The links of a host with very many are dealt into parts, and its score goes to
each part, so that no task gets all links of a hub.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, read, staged

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DAMPING = 0.85
#: Rounds between two looks at the growth of the scores.
ROUNDS = 8
#: Rounds end when the sum of all scores grew by at most this in the last ``ROUNDS``; what is left to come is less.
TOLERANCE = 1e-6
#: A host is blocked if its distrust is over its trust and over this.
THRESHOLD = 0.05
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links of one host that go to one part.
PART = 4096
#: Links of a task in a round; a small graph needs few tasks, whatever the session's partitions.
LINKS_PER_TASK = 200_000
_LINK = r"""(?i)\b(?:href|src)\s{0,8}=\s{0,8}["']?(?:[a-z][a-z0-9+.-]{0,19}:)?//([^/?#"'\s<>]++)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*+)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)) if text is None else text.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return text, verdict


def _edges(hosted: DataFrame) -> DataFrame:
    """(source, target, weight): links between different hosts, and subdomains with their parents, both ways."""
    linked = hosted.where((F.col("host") != "") & F.col("html").contains("//")).select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("target"))
    links = linked.select(F.col("host").alias("source"), F.translate("target", _UPPER, _LOWER).alias("target")).groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    links = staged(links.where("source <> target"), "links")
    hosts = hosted.select("host").where("host <> ''").union(links.select("target")).distinct()
    named = hosts.where(~F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$|^\[")).select(F.split("host", r"\.").alias("labels")).where("size(labels) > 2")
    from_label = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda i: F.struct(from_label(i).alias("host"), from_label(i + 1).alias("parent")))
    kin = named.select(F.explode(steps).alias("s")).select("s.host", "s.parent").distinct()
    both = kin.select(F.col("host").alias("source"), F.col("parent").alias("target"), F.lit(1.0).alias("weight")).union(kin.select("parent", "host", F.lit(1.0)))
    return links.union(both).groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def _by_host(scores: DataFrame) -> DataFrame:
    return scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"))


def host_scores(judged: DataFrame, edges: DataFrame, verdicts_only: bool = False) -> DataFrame:
    """host, trust, distrust of every host that has some.

    Both run in one frame of (host, kind, score): an edge carries kind 0 forward and kind 1 backward. Seeds are
    the shares of a host's pages that a rule allows or blocks. Every score is within ``TOLERANCE`` of its limit; with
    ``verdicts_only`` the rounds end as soon as what is still to come can change no host's verdict.
    """
    share = judged.where("host <> ''").groupBy("host").agg(*[(F.sum(F.when(F.col("rule_verdict") == v, 1).otherwise(0)) / F.count(F.lit(1))).alias(k) for v, k in (("allow", "t"), ("block", "d"))])
    seeds = share.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("seed")), F.struct(F.lit(1).alias("kind"), F.col("d").alias("seed")))).alias("x")).select("host", "x.kind", "x.seed").where("seed > 0")
    spark = judged.sparkSession
    both = edges.select("source", "target", "weight", F.lit(0).alias("kind")).union(edges.select("target", "source", "weight", F.lit(1)))
    both = staged(both, "edges")
    total = both.groupBy("source", "kind").agg(F.sum("weight").alias("total"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    total = staged(total, "totals")
    seeds = staged(seeds, "seeds")
    part = F.pmod(F.xxhash64("target"), F.col("parts")).cast("int")
    steps = staged(both.join(total, ["source", "kind"]).select(F.col("source").alias("host"), "kind", part.alias("part"), "target", (F.col("weight") / F.col("total")).alias("share")), "steps")
    wide = total.where("parts > 1").select(F.col("source").alias("host"), "kind", "parts")
    hubs, tasks = not wide.isEmpty(), min(partitions(spark), math.ceil(max(1, both.count()) / LINKS_PER_TASK))
    dealt = lambda scores: scores.join(wide, ["host", "kind"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))) if hubs else scores.withColumn("part", F.lit(0))
    start = seeds.select("host", "kind", (F.col("seed") * (1 - DAMPING)).alias("score"))
    mass = lambda df: df.agg(F.sum("score")).first()[0] or 0.0
    scores, total = start, mass(start)
    # from the start no score ever falls, so the growth of the sum is the L1 change; beyond ``most`` rounds less than the tolerance is to come, whatever the sum's rounding shows
    most = math.ceil(math.log(TOLERANCE / max(total / (1 - DAMPING), TOLERANCE)) / math.log(DAMPING))
    for _ in range(0, most, ROUNDS):
        for _ in range(ROUNDS):
            moved = steps.join(dealt(scores), ["host", "kind", "part"]).select(F.col("target").alias("host"), "kind", (F.col("score") * F.col("share") * DAMPING).alias("score"))
            scores = moved.union(start).groupBy("host", "kind").agg(F.sum("score").alias("score")).coalesce(tasks)
        scores = staged(scores, "scores")
        before, total = total, mass(scores)
        if total - before <= TOLERANCE:
            break
        if verdicts_only:
            # each further ``ROUNDS`` add at most this share of what the last ones did, to all hosts together
            rest = (total - before) * DAMPING**ROUNDS / (1 - DAMPING**ROUNDS)
            t, d = F.col("trust"), F.col("distrust")
            if _by_host(scores).where(~((t >= d + rest) | (d + rest <= THRESHOLD) | ((d > t + rest) & (d > THRESHOLD)))).isEmpty():
                break
    return _by_host(scores)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A URL that is null or lacks ``://`` has an empty host and path, no rule, and is allowed. Null html has no
    links. Repeated rows are all returned, and each counts as a page of its host, its links too. Rules of equal
    length: the first by verdict, host and path. Equal trust and distrust allow. An empty table gives an empty
    result. Extra columns, whatever their names, are not read. Texts of any length are read whole.
    """
    host, path = host_path(F.col("url"))
    hosted = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = hosted.select("page_id", "host", "path", text.alias("rule"), verdict.alias("rule_verdict"))
    scores = host_scores(judged.select("host", "rule_verdict"), _edges(hosted.select("host", "html")), verdicts_only=True)
    bad = scores.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > THRESHOLD)).select("host", F.lit("block").alias("by_host"))
    return judged.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "by_host", F.lit("allow")).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages", "page_id", "url", "html"))
