"""URL verdicts by rules, and by trust and distrust that spread over links between hosts.

Rules decide where one fits.  For other pages the host decides: the share of its pages that rules allow is its trust,
the share that they block its distrust.  Trust follows links (personalised PageRank from the trusted hosts), distrust
goes back along them, for linking to a blocked host speaks against one.  A host is blocked where distrust exceeds trust
by a threshold.  All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.shared import cut, hinted

#: (verdict, host, start of the path); a rule fits its host and all subdomains.
Rule = tuple[str, str, str]
DAMPING = 0.85
#: Propagation ends once no host's value changes by more in a round, as a share of its pages.
RESIDUAL = 1e-4
#: Rounds after which what they have added is summed up.
FOLD = 8
#: Distrust less trust, as a share of a host's pages, from which a host is blocked.
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (of equal length: the first given), as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links of a host's pages name another host.  Relative links stay on the host and don't count."""
    target = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select("host", F.explode(target).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return links.select(F.col("host").alias("src"), dst.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, links: DataFrame, residual: float = RESIDUAL) -> DataFrame:
    """host, trust, distrust, propagated from the seeds' own (columns host, trust, distrust) until a round adds no host more
    than the residual.

    A round passes on what the last one added, so rounds end: each adds at most DAMPING times as much in all.  A host
    that no link touches keeps its own.  Values are relative to a host's own share: the jump has weight 1.  A host with
    very many links is one key of the edges only, whose partitions AQE splits; what it receives is summed in each task first.
    """
    forward = links.select("src", "dst", "n", F.lit("trust").alias("kind"))
    backward = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind"))
    edges = forward.union(backward)
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("of"))
    edges = cut(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.lit(DAMPING) * F.col("n") / F.col("of")).alias("weight")))
    own = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "value"))
    total = added = cut(own.filter("value > 0").select("kind", "host", "value"))
    n, rounds = 0 if edges.isEmpty() else added.count(), 0
    while n:
        sent = added.withColumnRenamed("host", "src")
        sent = edges.join(hinted(sent, n), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
        added = cut(sent)
        total = total.unionByName(added)
        rounds += 1
        if rounds % FOLD == 0:
            total = cut(total.groupBy("kind", "host").agg(F.sum("value").alias("value")))
        n, most = added.agg(F.count(F.lit(1)), F.coalesce(F.max("value"), F.lit(0.0))).first()
        if most <= residual:
            break
    hosts = total.select("host").union(seeds.select("host")).distinct()
    sums = total.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("trust", "distrust")])
    return hosts.join(sums, "host", "left").select("host", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, residual: float = RESIDUAL) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has an empty host and path, no rule, no links, and is allowed.  A null html has
    no links.  Of rules of equal length the first given wins; at the threshold itself a host is blocked.  Repeated rows
    repeat, and count as pages each; other columns are ignored; an empty table gives an empty result.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"))
    share = [F.avg((F.coalesce("ruled", F.lit("")) == v).cast("double")).alias(k) for v, k in (("allow", "trust"), ("block", "distrust"))]
    seeds = ruled.filter("host <> ''").groupBy("host").agg(*share)
    hosts = cut(propagated(seeds, host_links(parsed), residual))
    by_host = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    # one row for each host: where hosts are too many to be sent to all, a large host's pages are split by AQE
    return ruled.join(hinted(hosts, hosts.count()), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), "trust", "distrust")
