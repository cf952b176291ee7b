"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Rules are (host, path) pairs; a rule fits its host and all subdomains if the url's path starts with the rule's
path, and the longest fitting rule decides.  Pages without a rule get their host's verdict: personalised
PageRank carries trust along links from hosts with allowed pages, reversed PageRank carries distrust from hosts
with blocked pages to the hosts that link to them; a host whose distrust exceeds its trust by ``threshold`` or more
is blocked.  Seeds are the shares of a host's pages that rules allow or block, so scores do not depend on size.
A wholly blocked host gives itself a distrust of 1 - damping, and one that links to such hosts only gets 0.85 of it;
``THRESHOLD`` is half of that unit.  Rounds go on until no score moves by ``TOLERANCE``; links of a host to itself are
solved in each round and not iterated, which leaves the scores as they are.

All steps are DataFrame operations.  Edges are counted per pair of hosts before they are shuffled further; a
relative link points to the page's own host, and a host without links keeps its score.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed;
null html has no links; repeated rows are repeated; empty tables give empty results.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, TOLERANCE = 0.85, 1e-6
THRESHOLD = 0.5 * (1 - DAMPING)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; as many comparisons as there are rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): number of links between hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'>\s]+)"), 1)
    targets = F.transform(links, lambda x: F.when(F.contains(x, F.lit("://")) | F.startswith(x, F.lit("//")), host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("x:"), x)).otherwise(x))).otherwise(F.lit(None)))
    edges = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(targets).alias("to"))
    return edges.groupBy("src", F.coalesce("to", "src").alias("dst")).agg(F.count("*").alias("n")).filter("src != '' and dst != ''")


def host_scores(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, trust, distrust) of every host that has a page or is linked to; at most ``rounds`` rounds if given."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    ruled = pages.select(host.alias("host"), matched_rule(host, path, rules)["verdict"].alias("v")).filter("host != ''")
    seeds = ruled.groupBy("host").agg(F.avg((F.coalesce(F.col("v"), F.lit("")) == "allow").cast("double")).alias("t0"), F.avg((F.coalesce(F.col("v"), F.lit("")) == "block").cast("double")).alias("b0"))
    edges = materialise(host_edges(pages, url_col, html_col), "edges")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    edges = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("w"))
    hosts = seeds.join(edges.select(F.col("dst").alias("host")).distinct(), "host", "full_outer").select("host", F.coalesce("t0", F.lit(0.0)).alias("t0"), F.coalesce("b0", F.lit(0.0)).alias("b0"))
    lone = hosts.join(edges.select(F.col("src").alias("host")).distinct(), "host", "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("w"))
    edges = materialise(edges.union(lone), "edges")
    own = edges.filter("src = dst").select(F.col("src").alias("host"), F.col("w").alias("own"))
    state = hosts.join(own, "host", "left").select("host", "t0", "b0", F.coalesce("own", F.lit(0.0)).alias("own"), F.col("t0").alias("t"), F.col("b0").alias("b"))
    state, edges = materialise(state, "hosts"), edges.filter("src != dst")
    for _ in itertools.count() if rounds is None else range(rounds):
        trust = edges.join(state.select(F.col("host").alias("src"), "t"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("t") * F.col("w")).alias("t1"))
        distrust = edges.join(state.select(F.col("host").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("b") * F.col("w")).alias("b1"))
        new = state.join(trust, "host", "left").join(distrust, "host", "left")
        t = ((1 - damping) * F.col("t0") + damping * F.coalesce("t1", F.lit(0.0))) / (1 - damping * F.col("own"))
        b = ((1 - damping) * F.col("b0") + damping * F.coalesce("b1", F.lit(0.0))) / (1 - damping * F.col("own"))
        new = materialise(new.select("host", "t0", "b0", "own", t.alias("t"), b.alias("b"), (F.abs(t - F.col("t")) + F.abs(b - F.col("b"))).alias("step")), "hosts")
        discard(state)
        state = new
        if (state.agg(F.max("step")).first()[0] or 0.0) < TOLERANCE:
            break
    return state.select("host", F.col("t").alias("trust"), F.col("b").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule (null without one), verdict, trust, distrust."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    scores = host_scores(pages, rules, url_col=url_col, html_col=html_col).withColumnRenamed("host", "__host")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("__m", matched_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(scores, F.col("host") == F.col("__host"), "left")
    by_host = F.when(F.coalesce(F.col("distrust") - F.col("trust") >= threshold, F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("__m.rule").alias("rule"), F.coalesce("__m.verdict", by_host).alias("verdict"), "trust", "distrust")
