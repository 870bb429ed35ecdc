"""Secret scans with a ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds the (blob,
rule, version) triples already scanned; a run scans each blob it has not seen, once, under the
rules it has not had, and joins findings back to all paths with that content. A new version of
a rule makes all its pairs unseen again. Findings are kept beside the ledger, so a known blob at a
new path shows what was found in it before.

Offsets come from what a pattern splits a text into: the lengths of the gaps and matches before
a match add up to its start, by a running sum over the matches of one blob and rule.

Defined results: a null text counts as empty; an empty text has no findings. Equal texts share
findings, whatever their keys, also null ones. Offsets are in code points, ends exclusive.
Matches of a rule do not overlap; those of different rules may.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rotamera.llm.common import private, written
from rotamera.operators.grouping import lookup
from rotamera.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int               # characters that ``group`` must have
    group: int = 0
    version: int = 1
    literals: tuple = ()     # lower-case strings of which a text must hold one


# fixed values: the base rules, in the order that ties take, and two that add to them.
# Runs of one class need no filter afterwards: a run is long enough or it is not.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                   r"""([A-Za-z0-9+/_.=-]+)""", 6, 2,
         literals=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20, literals=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 10, literals=("private key-----",)),
)


def blob(text: str | Column) -> Column:
    """Content address of a text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(c, F.lit("")), 256))


def _spots(text: Column, low: Column, rule: Rule) -> Column:
    """Array of (gap, found, value): lengths of the gap before each match, of the match and
    of the group that must be long enough."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), F.length)
        .alias("gap"),
        F.transform(found, F.length).alias("found"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
        .alias("value"))
    need = F.lit(False)
    for x in rule.literals:
        need = need | low.contains(x)
    return F.when(need if rule.literals else text.rlike(rule.pattern), parts)


def ledger_of(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, version) for every blob under every rule."""
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))
                      for r in rules])
    return blobs.select("blob", F.explode(pairs).alias("_r")).select("blob", "_r.*")


def scan(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None,
         rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, entries): findings (blob, kind, version, start, end) of the unseen pairs of
    ``docs``, and the ledger entries (blob, kind, version) to append."""
    rows = docs.select(blob(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
    # copies fall away before the shuffle; what is left is one text per blob
    fresh = rows.groupBy("blob").agg(F.first("text").alias("text"))
    done = F.array().cast("array<string>")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(
            F.collect_set(F.concat_ws(":", "kind", "version")).alias("_done"))
        fresh = fresh.join(seen, "blob", "left")
        done = F.coalesce("_done", done)
    low = F.lower("text")
    todo = [~F.array_contains(done, f"{r.kind}:{r.version}") for r in rules]
    entries = fresh.select("blob", F.explode(F.filter(F.array(*[
        F.when(t, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")))
        for r, t in zip(rules, todo)]), lambda x: x.isNotNull())).alias("_r")).select("blob", "_r.*")
    each = F.array(*[F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
        F.lit(r.least).alias("least"), F.when(t, _spots(F.col("text"), low, r)).alias("spots"))
        for r, t in zip(rules, todo)])
    hits = (fresh.select("blob", F.explode(F.filter(each, lambda x: F.size(x["spots"]) > 0))
                         .alias("r"))
            .select("blob", "r.kind", "r.version", "r.least", F.posexplode("r.spots").alias("n", "s")))
    upto = F.sum(F.col("s.gap") + F.col("s.found")).over(
        W.partitionBy("blob", "kind").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow))
    findings = (hits.withColumn("end", upto).where(F.col("s.value") >= F.col("least"))
                .select("blob", "kind", "version",
                        (F.col("end") - F.col("s.found")).alias("start"), "end"))
    return findings, entries


def advance(docs: DataFrame, text: str = "text", ledger: DataFrame | None = None,
            stored: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after a run over ``docs``: what was ``stored`` under rule versions that still
    hold, with what the unseen pairs give, and the ledger with their entries. Both are written, so a
    blob is scanned once however often they are read, and serve as the next run's arguments. A known blob
    at a new path needs no scan: ``at_paths`` finds its stored findings."""
    found, entries = scan(docs, text, ledger, rules)
    found, entries = written(found, "findings"), written(entries, "ledger")
    if stored is not None:
        valid = F.concat_ws(":", "kind", "version").isin(*[f"{r.kind}:{r.version}" for r in rules])
        found = stored.where(valid).unionByName(found)
    return found, entries if ledger is None else ledger.unionByName(entries)


def at_paths(docs: DataFrame, per_blob: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of a table that has one row per blob; nulls for the others. The table
    goes to the rows if it is small, for one blob may stand at a third of all paths."""
    at, = private(docs, "_blob")
    table = cut_lineage(per_blob.withColumnRenamed("blob", at))
    width = 200 + (table.agg(F.max(sum(
        (F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t in ("string", "binary")),
        F.lit(0))).alias("w")).first()["w"] or 0)
    return lookup(docs.withColumn(at, blob(text)), table, [at], "left", width, ready=True).drop(at)


def spans(findings: DataFrame, rules=RULES) -> DataFrame:
    """(blob, found): each blob's findings as an array of (start, rank, kind, end), sorted."""
    rank = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)])
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
        "start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("found"))
