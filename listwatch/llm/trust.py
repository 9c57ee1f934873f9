"""URL filters by link-graph propagation, in built-in functions only.

Rules decide the urls that they fit; the longest rule wins.  Other urls are judged by their host.
Trust flows from hosts that the rules allow along the links between hosts (personalised PageRank):
a host divides what it has among the hosts it links to.  Distrust flows from hosts that they block
against the links, to whoever links there, and counts by the share of a host's own links that lead
to distrusted hosts: the expected visits to blocked hosts, damped at each step, of a walk along links that starts
at the host.  It does not shrink with the number of hosts that link to a blocked one.  A host is
blocked when its distrust reaches a threshold and exceeds its trust.

Seeds are shares: a host of which a rule covers every tenth page is a tenth of a seed.  Scores are
seed + damping * (what flows in).  A full seed has at least 1, and without links scores are the seeds.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from listwatch.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; without ``://`` empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def _longest(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    found = [F.when(r.fits(host, path), F.lit(value(r))) for r in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


@dataclass(frozen=True)
class TrustFilter:
    """``damping`` is that of the PageRank, rounds go on until no score moves by more than ``tolerance``; ``limit`` blocks.

    A null url, or one without ``://``, has the empty host and path, fits no rule and is allowed; the
    empty host takes part in no link.  Null html has no links.  Repeated pages count repeatedly in
    their host's seed shares; repeated links weigh more.  Links that begin with ``//`` name a host
    like those with a scheme; relative links and links to the own host are no edges.  Other columns are ignored.
    """

    rules: tuple[Rule, ...]
    damping: float = 0.85
    tolerance: float = 1e-6
    limit: float = 0.5
    id: str = "page_id"

    def judge(self, pages: DataFrame) -> DataFrame:
        """id, host, path, rule, verdict, trust and distrust (of the host) per page."""
        rows = pages.select(F.col(self.id).alias("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        name = lambda r: r.host + r.path
        rows = rows.withColumns({"rule": _longest(self.rules, F.col("host"), F.col("path"), name),
                                 "ruled": _longest(self.rules, F.col("host"), F.col("path"), lambda r: r.verdict)})
        rows = staged(rows, "urls")
        hosts = staged(self.scores(rows, self.links(pages)), "hosts")
        blocked = (F.col("distrust") >= self.limit) & (F.col("distrust") > F.col("trust"))
        verdict = F.coalesce("ruled", F.when(blocked, "block").otherwise("allow"))
        # Both sides are plain scans, so a host with many pages is split at run time.
        return rows.join(hosts, "host", "left").select(
            F.col("id").alias(self.id), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")

    def links(self, pages: DataFrame) -> DataFrame:
        """(source, target, weight) between different hosts."""
        found = pages.select(host_of(F.col("url")).alias("source"), F.explode(
            F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
        link = F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), "link")).otherwise(F.col("link"))
        found = found.select("source", host_of(link).alias("target"))
        return (found.where("source <> '' and target <> '' and source <> target")
                .groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")))

    def scores(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """host, trust, distrust for every host of a page or a link."""
        links = staged(links, "links")
        share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
        own = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("barred"))
        linked = links.select(F.col("target").alias("host")).distinct().join(own, "host", "left_anti")
        verdict = _longest(self.rules, F.col("host"), F.lit("/"), lambda r: r.verdict)
        linked = linked.select("host", F.when(verdict == "allow", 1.0).otherwise(0.0).alias("allowed"),
                               F.when(verdict == "block", 1.0).otherwise(0.0).alias("barred"))
        seeds = own.union(linked)
        seeds = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "allowed", F.lit("distrust"), "barred"))
                             .alias("kind", "seed"))
        sums = links.groupBy("source").agg(F.sum("weight").alias("all"))
        shares = links.join(sums, "source").withColumn("share", F.col("weight") / F.col("all"))
        flows = shares.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "share")
        flows = staged(flows.union(shares.select(F.lit("distrust"), "target", "source", "share")), "flows")
        state = staged(seeds.withColumn("score", F.col("seed")), "state")
        while True:
            received = (flows.join(state.select("kind", "host", "score"), ["kind", "host"])
                        .groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("in")))
            new = F.col("seed") + self.damping * F.coalesce("in", F.lit(0.0))
            state = state.join(received, ["kind", "host"], "left").select(
                "kind", "host", "seed", F.col("score").alias("old"), new.alias("score"))
            state = staged(state, "state")
            change = state.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
            if change is None or change <= self.tolerance:
                break
        value = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
        return state.groupBy("host").agg(value("trust").alias("trust"), value("distrust").alias("distrust"))
