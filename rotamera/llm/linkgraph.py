"""URL filtering by rules and by trust that flows along links, in DataFrame functions only.

Rules decide the urls they fit, the longest first. For the others the host decides: pages that a
rule allows are trusted seeds of their host, pages that a rule blocks distrusted ones. Trust
follows links (personalised PageRank from the trusted seeds), distrust goes against them, from
a blocked host to those that link to it. A host is blocked if its distrust is more than
``THRESHOLD`` of both together; a host that neither reaches is allowed. Since a ratio decides,
however little mass there is, both walks go on until a step adds to no host more than
``TOLERANCE`` of what it has: then every host in reach is reached.

An edge is a pair of hosts with its number of links; hubs' edges are only joined to one row of the
hub, which Spark can split, and sums are aggregated before they shuffle. Both walks take each step in
the same job. Links that end nowhere lose their mass.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and
belongs to the host named by the empty text. Null html has no links. Relative links and links within a host
are no edges. Every row is judged on its own, repeated rows alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rotamera.llm.common import private
from rotamera.operators.grouping import lookup
from rotamera.session import cut_lineage

DAMPING = 0.85
TOLERANCE = 1e-9
STEPS = 12               # of the walk in OP10_SQL only
THRESHOLD = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]+)"""


def host_path(url: Column | str) -> tuple[Column, Column]:
    u = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(u, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. ``rules``: (verdict, host,
    path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, links) between different hosts."""
    found = F.filter(F.transform(
        F.regexp_extract_all(html, F.lit(LINK), F.lit(1)),
        lambda x: host_path(F.regexp_replace(x, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "x://"))[0]),
        lambda h: h != "")
    return (pages.where(F.col(html).contains("//"))
            .select(F.col(host).alias("src"), F.explode(found).alias("dst"))
            .where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst,
    links). Hosts that nothing reaches are left out."""
    both = edges.select(F.lit(True).alias("good"), "src", "dst", "links").unionByName(
        edges.select(F.lit(False).alias("good"), F.col("dst").alias("src"),
                     F.col("src").alias("dst"), "links"))
    total = both.groupBy("good", "src").agg(F.sum("links").alias("all"))
    moves = cut_lineage(both.join(total, ["good", "src"])
                        .select("good", "src", "dst", (F.col("links") / F.col("all")).alias("p")))
    start = cut_lineage(seeds.select("host", F.explode(F.array(
        F.struct(F.lit(True).alias("good"), F.col("trust").alias("x")),
        F.struct(F.lit(False).alias("good"), F.col("distrust").alias("x")))).alias("_s"))
        .select("host", "_s.good", "_s.x").where("x > 0"))
    # what the last step has added goes on, and a host's mass is the sum of all that came
    state = start.withColumn("new", F.col("x"))
    going, n = moves.count() > 0, 0
    while going:
        sent = (state.where("new > 0").withColumnRenamed("host", "src").join(moves, ["good", "src"])
                .select(F.col("dst").alias("host"), "good", (F.col("new") * F.col("p") * damping)
                        .alias("x")))
        state = (state.select("host", "good", "x", F.lit(0.0).alias("new"))
                 .unionByName(sent.withColumn("new", F.col("x")))
                 .groupBy("host", "good").agg(F.sum("x").alias("x"), F.sum("new").alias("new")))
        n += 1
        if n % 4 == 0:
            state = cut_lineage(state)
            going = not state.where(F.col("new") > F.col("x") * tolerance).isEmpty()
    return state.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("good"), F.col("x"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("x"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules, url: str = "url", html: str = "html",
          damping: float = DAMPING, threshold: float = THRESHOLD,
          tolerance: float = TOLERANCE) -> DataFrame:
    """``pages`` without ``html`` but with host, path, rule and verdict (``allow`` or ``block``)."""
    host, path = host_path(url)
    rule, verdict = matched(rules, F.col("host"), F.col("path"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = (pages.select(*rest, host.alias("host"), path.alias("path"))
            .select("*", rule.alias("rule"), verdict.alias("verdict")))
    seeds = rows.groupBy("host").agg(
        F.sum(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    scores = propagate(seeds, host_links(rows, "host", html), damping, tolerance)
    bad = scores.where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    # few hosts are bad, and one host may have a third of all pages: those go to the pages if
    # their number and width allow
    mark, = private(pages, "_bad")
    bad = cut_lineage(bad.select("host", F.lit("block").alias(mark)))
    width = 100 + (bad.agg(F.max(F.octet_length("host")).alias("w")).first()["w"] or 0)
    out = lookup(rows.drop(html), bad, ["host"], "left", width, ready=True)
    return out.select(*[c for c in rest if c != html], "host", "path", "rule",
                      F.coalesce("verdict", mark, F.lit("allow")).alias("verdict"))
