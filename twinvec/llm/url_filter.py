"""URL filter: explicit rules, and trust propagated over the host graph.

A rule (host/path) fits its host and all subdomains when the url's path starts
with its path; the longest rule wins. Pages without a rule take the verdict of
their host. Hosts gain trust by personalised PageRank along links from hosts
with allowed pages, and distrust along reversed links from hosts with blocked
pages; the seeds of either kind sum to 1, by their pages. A host is blocked when its distrust exceeds its trust by more than `margin`. Links
are the absolute and protocol-relative references in the html, and, weighing
less, both ways between a host and its domain, its last two labels, which is a node
also where no page has it as host.

DataFrame operations only. A round is a join of the links with the ranks and sums by host,
both of which Spark splits or combines before the shuffle where one host has a large share of the
links. Null url or html: empty host and path, no links.
Repeated rows keep a row each. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinvec.llm.common import ascii_lower, written

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING, ROUNDS, SITE_WEIGHT = 0.7, 10, 0.25
SITE = r"([^.]+\.[^.]+)$"
MARGIN = 1e-12
_WHITE = r"[\x20\x09-\x0D]"
HREF = rf"""(?i)\bhref{_WHITE}*={_WHITE}*["']?(?:https?:)?//([^/?#"'\x20\x09-\x0D>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return ascii_lower(raw), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last one set wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, html) and the hosts -> (src, dst, w), w the share of src's links."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("to"))
    links = links.select("src", ascii_lower(F.col("to")).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    site = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", SITE, 1).alias("dst"), F.lit(SITE_WEIGHT).alias("n")).where("dst <> '' and src <> dst")
    site = site.union(site.select("dst", "src", "n"))
    e = written(links.union(site).groupBy("src", "dst").agg(F.sum("n").alias("n")), "links")
    out = written(e.groupBy("src").agg(F.sum("n").alias("out")), "out")
    back = written(e.groupBy(F.col("dst").alias("d")).agg(F.sum("n").alias("in")), "in")
    e = e.join(out, "src").join(back, F.col("dst") == F.col("d"))
    return e.select("src", "dst", (F.col("n") / F.col("out")).alias("fwd"), (F.col("n") / F.col("in")).alias("rev"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, every: int = 5) -> DataFrame:
    """seeds (host, t0, d0) -> (host, trust, distrust). Hosts that are neither
    seed nor linked do not appear. Both ranks move in one join a round."""
    moves = edges.select("src", "dst", F.col("fwd").alias("f"), F.lit(0.0).alias("r")).union(
        edges.select(F.col("dst"), F.col("src"), F.lit(0.0), F.col("rev"))
    )
    moves = written(moves, "moves")
    rank = base = seeds.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    if moves.isEmpty():
        return base
    for k in range(rounds):
        sent = moves.join(rank, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (damping * F.col("f") * F.col("trust")).alias("trust"), (damping * F.col("r") * F.col("distrust")).alias("distrust")
        )
        told = base.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
        rank = sent.union(told).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (k + 1) % every == 0:
            rank = written(rank, "rank")
    return rank


def judge(pages: DataFrame, rules=RULES, margin: float = MARGIN, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """-> page_id, host, path, rule, verdict, trust, distrust."""
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    votes = p.groupBy("host").agg(
        F.sum((F.col("rule_verdict") == "allow").cast("double")).alias("t0"), F.sum((F.col("rule_verdict") == "block").cast("double")).alias("d0")
    )
    votes = written(votes.select("host", F.coalesce("t0", F.lit(0.0)).alias("t0"), F.coalesce("d0", F.lit(0.0)).alias("d0")), "votes")
    every = votes.agg(F.sum("t0").alias("t"), F.sum("d0").alias("d")).first()
    hosts = votes.select("host", (F.col("t0") / (every.t or 1.0)).alias("t0"), (F.col("d0") / (every.d or 1.0)).alias("d0"))
    rank = propagate(hosts, host_edges(p, hosts.where("host <> ''")), damping, rounds)
    rank = written(rank.where("trust > 0 or distrust > 0"), "rank")
    out = p.select("page_id", "host", "path", "rule", "rule_verdict").join(rank, "host", "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(d > t + margin, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), t.alias("trust"), d.alias("distrust"))
