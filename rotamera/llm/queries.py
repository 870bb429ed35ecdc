"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rotamera.llm import (
    bpe, chat, itq, langid, lattice, lines, linkgraph, phrases, pii, repair,
    secrets, simhash, tiling)
from rotamera.llm.common import crc_mod, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = chat.formatted(turns.unionByName(extra), RANKS, PATTERN)
    return chat.read_back(rows, RANKS).drop("n_tokens")


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lattice.score(docs, crc_mod("doc_id", 7) == 2, RANKS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.select("doc_id", bpe.coder(spark, RANKS, PATTERN)("text").alias("_c")).select("doc_id", "_c.*")
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("back", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, removed="n_removed", total="n_lines")


def op6_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return tiling.matches(docs, items).select("doc_id", "item_id", "covered", "words")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = langid.fit(docs.where(~held))
    got = docs.select("doc_id", held.alias("held_out"), langid.predict(docs, model).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one ledger: over the documents of even id, then over all. The second scans
    only what the first has not seen and reports all paths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    earlier = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    findings, ledger = secrets.advance(docs.where(earlier))
    findings, _ = secrets.advance(docs, ledger=ledger, stored=findings)
    base = ("assign", "access", "hex")

    def told(found):
        return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(
            ":", x["kind"], x["start"], x["end"])))

    def many(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    per_blob = secrets.spans(findings).select(
        "blob", *[many(k).alias(f"n_{k}") for k in base],
        told(F.filter("found", lambda x: x["kind"].isin(*base))).alias("base"),
        told(F.col("found")).alias("spans"))
    rows = secrets.at_paths(docs, per_blob)
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


# fixed values: (verdict, host, path)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"),
             ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op10_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return linkgraph.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", pii.find("text").alias("found"))

    def told(found):
        return F.array_join(F.transform(found, lambda x: F.concat_ws(
            ":", x["kind"], x["start"], x["end"])), ",")

    def many(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[many(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(told(F.filter("found", lambda x: x["kind"].isin(*pii.BASE))), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = repair.repair(repair.damaged(turns)).withColumnRenamed("conv_id", "_conv")
    rows = turns.select("conv_id").distinct().join(
        got, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return rows.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_chat, op2_lattice, op3_byte_bpe, op4_simhash, op5_lines, op6_tiling, op7_langid,
    op8_secrets, op9_itq, op10_linkgraph, op11_phrases, op12_pii,
    op13_repair)}

# Line deduplication: each window is the text of its lines.
OP5_SQL = """
WITH split AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
spots AS (
    SELECT doc_id, l, unnest(range(greatest(len(l) - 2, 1))) AS pos FROM split
    WHERE text IS NOT NULL),
win AS (
    SELECT doc_id, pos, l[pos + 1:pos + 3] AS w FROM spots
    WHERE len(list_filter(l[pos + 1:pos + 3], lambda x: trim(x, ' ') <> '')) > 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM win),
cut AS (
    SELECT doc_id, list_distinct(flatten(list(range(pos, pos + len(w))))) AS gone
    FROM ranked WHERE k > 1 GROUP BY doc_id)
SELECT s.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
        list_filter(range(len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)), '')
    END AS text
FROM split s LEFT JOIN cut c ON s.doc_id = c.doc_id
"""


# Chat formatting: what the markers and escapes add up to.
OP1_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) + 4
        ELSE 16 + length(role) + len(regexp_extract_all(role, '{controls}')) END
        + length(text) + len(regexp_extract_all(text, '{controls}')) + 7 AS chars
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
        FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""".replace("{controls}", "|".join(re.escape(c) for c in ("\\", *chat.CONTROLS)))


def _secret_sql(rule: secrets.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
        string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS found,
        regexp_extract_all(t, '{pattern}', {rule.group}) AS value FROM texts"""


OP8_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
each AS ({" UNION ALL ".join(_secret_sql(r, n) for n, r in enumerate(secrets.RULES))}),
spots AS (
    SELECT doc_id, rank, kind, least, gaps, found, value, unnest(range(1, len(found) + 1)) AS i
    FROM each WHERE len(found) > 0),
spans AS (
    SELECT doc_id, rank, kind, length(found[i]) AS size,
        list_sum([length(x) for x in gaps[1:i]]) + list_sum([length(x) for x in found[1:i]])
            AS stop
    FROM spots WHERE length(value[i]) >= least),
told AS (
    SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign,
        count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
        string_agg(kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT, ','
            ORDER BY stop - size, rank) FILTER (WHERE rank < 3) AS base,
        string_agg(kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT, ','
            ORDER BY stop - size, rank) AS spans
    FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id
"""

OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) AS g
    FROM split, (VALUES (1), (2), (3)) AS sizes(k)),
f AS (SELECT lang, k, g, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (
    SELECT lang, g, n, cut, g[1:cut] AS head, g[cut + 1:] AS rest
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND n >= 10)),
cuts AS (
    SELECT p.lang, p.g, p.n AS a, p.cut, l.n AS l, r.n AS r,
        (1000000::HUGEINT * p.n * p.n // (l.n::HUGEINT * r.n))::BIGINT AS score
    FROM parts p JOIN f l ON l.lang = p.lang AND l.g = p.head JOIN f r ON r.lang = p.lang AND r.g = p.rest),
scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM scored WHERE len(g) = 3),
around AS (SELECT lang, g, max(a) AS a FROM longer GROUP BY ALL),
kept AS (
    SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.g = s.g
    WHERE o.a IS NULL OR 100 * o.a < 50 * s.a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""


def _spans_sql(rank: int, kind: str, pattern: str, group: int, valid: str) -> str:
    """Matches of one kind; ``v`` is the match or its group, which ends where the match does."""
    return f"""
    SELECT doc_id, rank, kind, stop - length(v) AS start, stop FROM (
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind, value[i] AS v, list_sum([length(x) for x in gaps[1:i]])
            + list_sum([length(x) for x in found[1:i]]) AS stop
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
            SELECT doc_id, string_split_regex(t, $${pattern}$$) AS gaps, regexp_extract_all(t, $${pattern}$$, 0) AS found,
                regexp_extract_all(t, $${pattern}$$, {group}) AS value FROM texts)))
    WHERE {valid}"""


_PLAIN = "regexp_replace(v, '[^0-9A-Z]', '', 'g')"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i::INT, 1)::INT
    ELSE (2 * substr({_DIGITS}, i::INT, 1)::INT) // 10 + (2 * substr({_DIGITS}, i::INT, 1)::INT) % 10 END
    for i in range(1, length({_DIGITS}) + 1)]) % 10 = 0"""
_TURNED = f"(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4))"
_MOD97 = f"""list_reduce([0] || [strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({_TURNED}, i::INT, 1)) - 1
    for i in range(1, length({_TURNED}) + 1)], lambda a, b: (a * CASE WHEN b < 10 THEN 10 ELSE 100 END + b) % 97) = 1"""
_CUE = r"(?i:\b{}\b(?:\x20(?:no|number))?)\x20?[.:#=]?\x20?"
_KINDS_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0,
     "len([x for x in string_split(v, '.') if length(ltrim(x, '0')) > 3 OR TRY_CAST(ltrim(x, '0') AS INT) > 255]) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) BETWEEN 10 AND 15"),
    ("login", r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/?#@"'<>]+@[A-Za-z0-9.-]+""", 0, "true"),
    ("iban", _CUE.format("iban") + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", 1, _MOD97),
    ("account", _CUE.format("(?:account|acct|passport|ssn)") + r"([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,})", 1, "true"))
OP12_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(n, *k) for n, k in enumerate(_KINDS_SQL))}),
told AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in pii.BASE)},
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)
            FILTER (WHERE rank < 4) AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id
"""

def _way(state: str, cost: str, edit: str, row: str) -> str:
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
            f"'t': {state}.t || {row}}} END")


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_USER, _ASSISTANT, _ROW = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || {} || ':' || text"


def _taken(state: str, role: str) -> list[str]:
    """A row that is kept or rerolled as ``role`` where it may stay."""
    return [f"CASE WHEN stays AND ini = '{role[0]}' THEN {_way(state, 'extra', 'K', _ROW.format('role'))} END",
            *([] if role == "system" else
              [f"CASE WHEN stays THEN {_way(state, '3 + extra', 'R', _ROW.format(repr(role)))} END"])]


# Each conversation's rows one after the other; per state the cheapest edits and what they leave.
OP13_SQL = rf"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
coded AS (
    SELECT *, xor(list_reduce([4294967295::BIGINT] || [ord(substr(key, i::INT, 1))::BIGINT for i in range(1, length(key) + 1)],
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))),
        4294967295::BIGINT) % 20 AS d FROM named),
damaged AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last, substr(role, 1, 1) AS ini FROM damaged),
rows AS (
    SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
        WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(ini) OVER (PARTITION BY conv_id ORDER BY rn) || ini AS pair FROM ranked),
told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
walk AS (
    SELECT conv_id, 0::BIGINT AS rn, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0,
        NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2,
        NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM told
    UNION ALL
    SELECT conv_id, rn, {_way('s0', '4', 'D', "''")},
        {_least(_way('s1', '4', 'D', "''"), *_taken('s0', 'system'))},
        {_least(_way('i2', '4', 'D', "''"), *_taken('s0', 'user'), *_taken('s1', 'user'), *_taken('i3', 'user'))},
        {_least(_way('i3', '4', 'D', "''"), *_taken('i2', 'assistant'))}
    FROM (SELECT *, {_least('s3', _way('i2', '3', 'I', _ASSISTANT))} AS i3 FROM (
        SELECT r.*, w.s0, w.s1, w.s3, {_least('w.s2', *(_way(f'w.{x}', '3', 'I', _USER) for x in ('s0', 's1', 's3')))} AS i2,
            fault NOT IN ('blank', 'duplicate') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra
        FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.rn + 1))),
ended AS (
    SELECT w.*, {_least('s0', 's3', _way('s2', '3', 'I', _ASSISTANT), _way('s1', '6', 'II', f'{_USER} || {_ASSISTANT}'))} AS best
    FROM walk w JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.rn)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
    coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

# All pairs of a label, and reachability.
OP9_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (
    SELECT a, b FROM pairs
    UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(low.m, vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""

_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_CASES = [(_FITS.format(h=h, p=p), h + p, v)
          for v, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))]
OP10_SQL = rf"""
WITH RECURSIVE cut AS (
    SELECT page_id, html, CASE WHEN instr(url, '://') > 0
        THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id, html, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
named AS (
    SELECT page_id, html, translate(raw, '{linkgraph.UPPER}', '{linkgraph.LOWER}') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
ruled AS (
    SELECT *, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in _CASES)} END AS rule,
        CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in _CASES)} END AS verdict FROM named),
links AS (
    SELECT host AS src, unnest(regexp_extract_all(html,
        '{linkgraph.LINK.replace("'", "''")}', 1)) AS link FROM ruled),
ends AS (
    SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{linkgraph.UPPER}',
        '{linkgraph.LOWER}') AS dst FROM links),
edges AS (
    SELECT src, dst, count(*) AS links FROM ends WHERE dst <> '' AND src <> dst GROUP BY ALL),
moves AS (
    SELECT true AS good, src, dst, links / sum(links) OVER (PARTITION BY src) AS p FROM edges
    UNION ALL
    SELECT false, dst, src, links / sum(links) OVER (PARTITION BY dst) FROM edges),
walk(k, host, good, x) AS (
    SELECT 0, host, verdict = 'allow', count(*)::DOUBLE FROM ruled WHERE verdict IS NOT NULL
    GROUP BY ALL
    UNION ALL
    SELECT k + 1, dst, good, sum(x * p * {linkgraph.DAMPING}) FROM (
        SELECT w.k, m.dst, w.good, w.x, m.p FROM walk w JOIN moves m
        ON w.good = m.good AND w.host = m.src WHERE w.k < {linkgraph.STEPS}) s
    GROUP BY k, dst, good),
bad AS (
    SELECT host FROM walk GROUP BY host
    HAVING sum(CASE WHEN good THEN 0 ELSE x END) > {linkgraph.THRESHOLD} * sum(x))
SELECT page_id, host, path, rule, coalesce(verdict,
    CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op5_lines": OP5_SQL, "op8_secrets": OP8_SQL,
                           "op9_itq": OP9_SQL, "op10_linkgraph": OP10_SQL,
                           "op11_phrases": OP11_SQL, "op12_pii": OP12_SQL,
                           "op13_repair": OP13_SQL}
