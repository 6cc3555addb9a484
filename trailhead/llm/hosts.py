"""URL filters: rules by host and path, and trust and distrust propagated over the host link graph. DataFrame functions only.

Hosts with pages that rules allow are trusted seeds, hosts with pages that rules block are distrusted seeds. Personalised PageRank
runs from the trusted seeds along links and from the blocked seeds against them; a page without a rule gets its host's
verdict: block where distrust exceeds trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailhead.llm.common import cut, discard

#: (verdict, host/path) rules of the op7 query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Ranks that differ by this share of themselves count as equal; a share, as ranks shrink where there are more hosts.
EQUAL = 1e-12
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null. Rules are a bounded parameter: an expression each."""
    fits = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        on = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        fits.append(F.when(on, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts, counted per pair before anything is joined. Relative links stay on their host."""
    found = pages.select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).where("src <> dst and src <> '' and dst <> ''")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def pagerank(links: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(host, rank): personalised PageRank over links (src, dst, n) from seeds (host, w), whose weights sum to 1.

    A round is one join on the source host and one sum per target with map-side combine; ranks are written every few rounds.
    Rank that reaches a host without links out is not dealt on. Without links, ranks are (1 - damping) * w.
    """
    base = seeds.select("host", (F.col("w") * (1 - damping)).alias("rank"))
    if links.isEmpty():
        return base
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    shares = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all") * damping).alias("share")), "pr-links")
    base = cut(base, "pr-seeds")
    ranks, kept = base, None
    for i in range(rounds):
        sent = shares.join(ranks.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        ranks = sent.union(base).groupBy("host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % every == 0 or i + 1 == rounds:
            ranks = cut(ranks, "pr-ranks")
            if kept is not None:
                discard(kept)
            kept = ranks
    return ranks


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html", ratio: float = 1.0, rounds: int = 20) -> DataFrame:
    """One row per row of pages: key, host, path, rule (or null), verdict (allow or block), trust, distrust.

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest fitting rule gives the verdict. Else
    a page is blocked where its host's distrust exceeds ratio times its trust by more than the share EQUAL, and allowed otherwise. A null
    url, or one without ://, has an empty host and path and is allowed unless a rule fits; null html has no links. An empty table gives no rows.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("__html"))
    rows = rows.withColumn("__fit", rule_for(F.col("host"), F.col("path"), rules))
    links = cut(host_links(rows, "host", "__html"), "host-links")
    votes = rows.where("host <> ''").groupBy("host").agg(*[F.sum(F.coalesce((F.col("__fit.verdict") == v).cast("long"), F.lit(0))).alias(v) for v in ("allow", "block")])
    votes = cut(votes, "host-votes")
    total = votes.agg(*[F.greatest(F.lit(1), F.coalesce(F.sum(v), F.lit(0))).alias(v) for v in ("allow", "block")]).first()
    seed = {v: votes.where(F.col(v) > 0).select("host", (F.col(v) / F.lit(float(total[v]))).alias("w")) for v in ("allow", "block")}
    trust = pagerank(links, seed["allow"], rounds).withColumnRenamed("rank", "trust")
    distrust = pagerank(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seed["block"], rounds).withColumnRenamed("rank", "distrust")
    scores = votes.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])
    out = rows.drop("__html").join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("__fit.verdict", F.when(F.col("distrust") * (1 - EQUAL) > ratio * F.col("trust"), "block").otherwise("allow"))
    return out.select(F.col(key), "host", "path", F.col("__fit.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
