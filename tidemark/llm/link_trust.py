"""URL filters: rules on hosts and paths, and trust propagated over the graph of links between hosts.

Method
    Links are read from the pages' HTML (absolute and scheme-relative ``href`` values) and become weighted edges
    between hosts. Trust is a personalised PageRank that restarts at trusted seeds and follows links; distrust
    is one that restarts at blocked seeds and follows links backwards, so that who links to blocked hosts is
    distrusted. A host is blocked if its distrust is at least ``MARGIN`` times its trust and above ``FLOOR`` times
    the restart weight of a seed. Seeds are the hosts of pages that a rule allows or blocks, and hosts of the block
    list with their subdomains.

Rules
    A rule is a host and a path, with a verdict. It fits its host and all subdomains if the page's path starts with
    the rule's; of several the longest wins. A page that no rule fits has its host's verdict.

Defined cases
    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A to Z lower-cased; the path
    goes on to ``?``, ``#`` or the end. Without ``://``, or for a null url, both are empty. Null html has no links.
    Hosts without links keep their restart weight alone. Ranks below 5e-13 are dropped; a verdict needs over 1e-2. Repeated rows are judged alike and count as links each.
    Other columns are not looked at. An empty table gives an empty result.

Scale
    Edges are summed before the shuffle and a host's pages never meet in one task: ranks are sums by host, and a
    round's state is written to the shared folder. Ranks are rounded so that the order of sums decides nothing.
    Scores only grow from round to round and what is still to be handed on shrinks by ``DAMPING``: rounds go on until
    all hosts together gain less than ``TOLERANCE``, or as many as bring any restart weight below it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import materialize

# The rules of the query, as host/path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BLOCKED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.com"]
DAMPING, TOLERANCE, MARGIN, FLOOR, DIGITS = 0.85, 1e-10, 2.0, 0.1, 12
# After so many rounds a restart weight of 1 has less than TOLERANCE left to hand on.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple[F.Column, F.Column]:
    """Host and path of a url column."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, UPPER, LOWER), path


def _fits(rule: str) -> F.Column:
    host, path = rule.split("/", 1)
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, said`` per row, and ``html``."""
    host, path = url_parts("url")
    out = pages.select("page_id", "url", "html").withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    by_length = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in reversed(by_length):
        rule, said = F.when(_fits(text), F.lit(text)).otherwise(rule), F.when(_fits(text), F.lit(verdict)).otherwise(said)
    return out.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), "html")


def host_edges(judged: DataFrame) -> DataFrame:
    """``src, dst, weight``: links from pages of one host to another."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))
    found = judged.select(F.col("host").alias("src"), F.explode(links).alias("dst")).withColumn("dst", F.translate("dst", UPPER, LOWER))
    return found.filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _total(scores: DataFrame) -> float:
    return scores.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total")).first().total


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRank: ``host, score`` over ``edges(src, dst, weight)`` from ``seeds(host, weight)``, scores of at most 1."""
    whole = edges.groupBy("src").agg(F.sum("weight").alias("whole"))
    steps = materialize(edges.join(whole, "src").select("src", "dst", (F.col("weight") / F.col("whole")).alias("share")), "host-steps")
    restart = seeds.select("host", (F.col("weight") * (1 - DAMPING)).alias("score"))
    now = materialize(restart, "host-scores")
    if steps.isEmpty():
        return now
    total = _total(now)
    for _ in range(ROUNDS + math.ceil(math.log(max(1.0, total)) / -math.log(DAMPING))):
        moved = steps.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score"))
        now = moved.unionByName(restart).groupBy("host").agg(F.round(F.sum("score"), DIGITS).alias("score"))
        now = materialize(now.filter("score > 0"), "host-scores")
        before, total = total, _total(now)
        if total - before <= TOLERANCE:
            break
    return now


def url_verdicts(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's trust and distrust, per row of ``pages``."""
    judged = ruled(pages, rules)
    listed = F.lit(False)
    for name in blocked_hosts:
        listed = listed | (F.col("host") == name) | F.col("host").endswith("." + name)
    pages_of = judged.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("said") == "allow").alias("good"), F.count_if(F.col("said") == "block").alias("bad"), F.count("*").alias("n"))
    hosts = materialize(pages_of.withColumn("listed", listed), "hosts")
    trusted = hosts.filter("good > 0 AND NOT listed").select("host", (F.col("good") / F.col("n")).alias("weight"))
    blocked = hosts.filter("bad > 0 OR listed").select("host", F.when(F.col("listed"), F.lit(1.0)).otherwise(F.col("bad") / F.col("n")).alias("weight"))
    edges = materialize(host_edges(judged), "host-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(edges, trusted).select("host", F.col("score").alias("trust"))
    distrust = propagate(back, blocked).select("host", F.col("score").alias("distrust"))
    scored = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0)
    worse = (F.col("distrust") >= MARGIN * F.col("trust")) & (F.col("distrust") > FLOOR * (1 - DAMPING))
    scored = materialize(scored.withColumn("host_verdict", F.when(worse, "block").otherwise("allow")), "host-verdicts")
    out = judged.drop("html").join(scored, "host", "left")
    verdict = F.coalesce("said", "host_verdict", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
