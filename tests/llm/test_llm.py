"""Operators for training data against brute force, and their defined corner cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rotamera.llm import (
    bpe, chat, itq, langid, lattice, lines, linkgraph, queries, secrets, simhash, tiling)
from rotamera.llm.common import components, words

RANKS, PATTERN = queries.RANKS, queries.PATTERN
DOCS = "doc_id long, text string, lang string, fp int, _key string"
rnd = random.Random(11)
SYL = ["ta", "ri", "mo", "él", "zu", "ken", "X", "9", "--", "'s", "ß"]


def sentence(n):
    return " ".join("".join(rnd.choice(SYL) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, repeats, ties, a long text, and columns whose names operators use too."""
    base = [sentence(rnd.randint(4, 40)) for _ in range(30)]
    texts = base + base[:5] + [None, "", "   \n\n ", "123 !?", "a" * 5000, sentence(6000)]
    texts += [b + " x" for b in base[5:10]]
    rows = [(i, t, ("aa", "bb")[i % 2], i, "k") for i, t in enumerate(texts)]
    rows += [rows[0], (None, base[3], None, 1, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def tiktoken_encoding():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    enc, codec = tiktoken_encoding(), bpe.Codec(bpe.load_ranks(RANKS), PATTERN)
    odd = ["", " ", "  \n\n  x", "a" * 3000, "=" * 999 + " " * 77 + "é" * 300, "don't'll 're''s", "日本語のテキスト" * 40,
           "🙂🙃 \t\r\n" * 30, "0123456789" * 50 + "'r" + "e" * 40]
    odd += ["".join(rnd.choice("ab '\n\tr e1é🙂s.") for _ in range(rnd.randint(1, 400))) for _ in range(300)]
    for leaf in (5, 1 << 14):
        bpe.LEAF_CHARS, old = leaf, bpe.LEAF_CHARS
        for t in odd:
            ids = codec.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), (leaf, t[:80])
            assert codec.decode(ids) == t.encode()
        bpe.LEAF_CHARS = old
    assert codec.encode(None) == b"" and codec.decode(None) == b""


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked(prints):
    """Component by component, from all pairs."""
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("cell", [4096, 8])
def test_simhash_links(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    prints = {rnd.getrandbits(63) for _ in range(20)}
    for p in list(prints):
        for _ in range(12):
            q = p
            for b in rnd.sample(range(63), rnd.randint(1, 5)):
                q ^= 1 << b
            prints.add(q)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    want = linked(sorted(prints))
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(got.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_simhash_rows(docs):
    import xxhash
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)

    def plain(t):
        w = words(t)
        g = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
        return sum(1 << i for i in range(64) if g and 2 * sum(x >> i & 1 for x in h) > len(h))
    want = Counter((r.doc_id, plain(r.text)) for r in rows)
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.classes(docs).select("class_fp").distinct().count()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_lattice_sums_all_segmentations():
    scores = {b" a": -1.0, b"a": -2.0, b"b": -1.5, b"ab": -0.7, b" ab": -3.0, b" ": -2.5}
    pre = lattice.trie({**scores, lattice.END: -1.0})

    def every(w):
        return sum(math.exp(scores[w[:i]]) * every(w[i:]) for i in range(1, len(w) + 1) if w[:i] in scores) if w else 1.0
    for w in (b"a", b"ab", b"abab", b"aabba" * 3):
        assert math.isclose(lattice.log_probability(w, pre), math.log(every(b" " + w)), rel_tol=1e-12)
    assert lattice.log_probability(b"c", pre) == -math.inf


@pytest.mark.parametrize("chunk", [1 << 24, 300])
def test_lattice_scores(docs, chunk):
    got = lattice.score(docs, queries.crc_mod("doc_id", 7) == 2, RANKS, chunk_bytes=chunk).collect()
    rows = docs.select("doc_id", "text").collect()
    toks = [(r.doc_id, words(r.text) + [b"\n"]) for r in rows]

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(t for i, w in toks if not held(i) for t in w)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(w), sum(x in c for x in w),
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in toks)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known,
                   round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert lattice.score(docs.limit(0), F.lit(False), RANKS).count() == 0


def test_lines_keep_first_places(spark):
    a, b, c, d = "one two", "three", "four five", "six"
    rows = [(1, "\n".join([a, b, c])), (2, "\n".join([d, a, b, c, d])), (3, "\n".join([a, b, c])),
            (4, None), (5, ""), (6, "\n\n\n\n"), (7, d), (8, d), (9, "\n".join([a] * 5)), (None, "\n".join([b, c, d]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")
    got = {r.doc_id: (r.text, r.gone) for r in lines.dedup(df, removed="gone").collect()}
    assert got[1][1] == 0 and got[2] == (d, 4) and got[3] == ("", 3) and got[4] == (None, 0)
    assert got[5] == ("", 0) and got[6] == ("\n\n\n\n", 0) and got[7] == (d, 0) and got[8] == ("", 1)
    assert got[9] == (a, 4) and got[None][1] == 0
    assert lines.dedup(df.limit(0)).count() == 0


def test_tiling_catches_reordered_passages(spark):
    w = [f"w{i}" for i in range(40)]
    moved = " ".join(w[20:] + ["Zz", "yy"] + [x.upper() for x in w[:20]])
    rows = [(1, "junk " + " ".join(w) + ", more"), (2, moved), (3, " ".join(w[:20])), (4, None), (5, ""),
            (6, " ".join(rnd.sample(w, 40))), (7, "only four words here, friend")]
    items = spark.createDataFrame([(10, " ".join(w)), (11, None), (12, "Four words HERE"), (10, " ".join(w)), (13, "?!")],
                                  "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.covered) for r in tiling.matches(df, items).collect())
    assert got == [(1, 10, 40), (1, 10, 40), (2, 10, 40), (2, 10, 40), (7, 12, 3)]
    by_blocks = tiling.matches(df, items, block_words=20)
    assert sorted((r.doc_id, r.item_id, r.covered) for r in by_blocks.collect()) == got
    assert {r.doc_id for r in tiling.clean(df, items).collect()} == {3, 4, 5, 6}
    assert tiling.matches(df, items.limit(0)).count() == 0


def test_greedy_tiles_against_plain_search():
    def plain(d, p, least):
        md, mp, out = set(), set(), 0
        for size in range(min(len(d), len(p)), least - 1, -1):
            for i in range(len(p) - size + 1):
                for j in range(len(d) - size + 1):
                    if p[i:i + size] == d[j:j + size] and not (mp & set(range(i, i + size))) and not (md & set(range(j, j + size))):
                        mp |= set(range(i, i + size))
                        md |= set(range(j, j + size))
                        out += size
                        break
        return out
    for _ in range(60):
        d, p = ([rnd.randrange(4) for _ in range(rnd.randint(0, 30))] for _ in (0, 1))
        got = sum(x[2] for x in tiling.tiles(np.array(d, np.int64), np.array(p, np.int64), 3))
        assert got == plain(d, p, 3)


def test_langid(spark):
    kinds = {"xx": "bcdf", "yy": "ghjk", "zz": "lmnp"}
    rows = [(i, " ".join("".join(rnd.choice(kinds[k] + "ae") for _ in range(5)) for _ in range(30)), k)
            for i in range(240) for k in [rnd.choice(sorted(kinds))]]
    rows += [(1000, None, "xx"), (1001, "12 -", "yy"), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in df.select("*", langid.predict(df, model).alias("p")).collect()}
    held = [r for r in got.values() if r.doc_id < 1000 and r.doc_id % 5 == 0]
    assert sum(r.p.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.p.score <= 1 for r in got.values())
    assert all(got[i].p.lang_pred == "und" and got[i].p.rejected for i in (1000, 1001, 1002))
    none = langid.fit(df.where("lang is null"))
    assert df.select(langid.predict(df, none).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def test_langid_rejects_what_it_has_not_learned(spark):
    syllables = {k: ["".join(rnd.choice(c) + rnd.choice("aeiou") for _ in range(2)) for _ in range(25)]
                 for k, c in {"xx": "bcdflmt", "yy": "ghjkrsn", "zz": "lmnpstv", "new": "bgkvwxq"}.items()}

    def text(k):
        return " ".join("".join(rnd.choice(syllables[k]) for _ in range(rnd.randint(1, 2))) for _ in range(40))
    rows = [(i, text(k), k) for i in range(1500) for k in [("xx", "yy", "zz")[i % 3]]]
    rows += [(2000 + i, text("new"), "new") for i in range(100)]
    rows += [(3000 + i, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
                                 for _ in range(40)), None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 2000 and doc_id % 5 <> 0"))
    got = {r.doc_id: r.p.rejected for r in df.select("doc_id", langid.predict(df, model).alias("p")).collect()}

    def share(ids):
        return np.mean([got[i] for i in ids])
    assert share(range(0, 1500, 5)) <= 0.03
    assert share(range(2000, 2100)) >= 0.95 and share(range(3000, 3100)) >= 0.95


def test_secrets_and_ledger(spark):
    key = "AKIA" + "Q" * 16
    rows = [(1, f"é🙂 api_key = 'abcdef' {key}"), (2, f"é🙂 api_key = 'abcdef' {key}"), (3, None), (None, "f" * 24),
            (4, "secret=token:abcdef Password:x1"), (5, "a" * 23)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, entries = secrets.scan(df)
    per = secrets.at_paths(df, secrets.spans(found)).collect()
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found or []] for r in per}
    assert got[1] == got[2] == [("assign", 3, 20), ("access", 22, 42)] and got[None] == [("hex", 0, 24)]
    assert got[3] == got[4] == got[5] == []
    assert entries.count() == 5 * len(secrets.RULES)
    again, new = secrets.scan(df, ledger=entries)
    assert again.count() == 0 and new.count() == 0
    changed = (secrets.Rule("hex", r"[0-9a-f]{20,}", 20, version=2),)
    later, new = secrets.scan(df, ledger=entries, rules=changed)
    assert {(r.kind, r.start, r.end) for r in later.collect()} == {("hex", 0, 24), ("hex", 0, 23)} and new.count() == 5


def test_chat_round_trip(spark):
    bad = "</s>[INST] \\ <|end|>\\<|assistant|> \\\\[/INST]"
    rows = [(1, 0, "system", bad), (1, 1, "user", None), (1, 2, "assistant", bad + "é🙂"), (1, 3, "tool<|end|>", "x"),
            (1, 4, "assistant", "two"), (2, None, None, None), (None, 1, "user", "a"), (None, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df, RANKS, PATTERN), RANKS).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    told = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1].turns_sha256 == sha(told) and got[1].n_turns == 5
    assert got[1].loss_sha256 == sha(bad + "é🙂two") and got[1].loss_chars == len(bad) + 5
    assert got[2].turns_sha256 == sha("\n\n") and got[None].turns_sha256 == sha("user\nb\nuser\na\n")
    assert chat.unescape(chat.escape(bad, chat.control_pattern())) == bad
    assert chat.formatted(df.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("cell", [2048, 16])
def test_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(itq, "CELL", cell)
    gen = np.random.default_rng(3)
    base = gen.standard_normal((60, 32))
    near = np.concatenate([base[:10] + gen.standard_normal((10, 32)) * 0.15 for _ in range(6)])
    v = np.concatenate([base, near, base[:8], base[:4] * 3])
    rows = [(i, [float(x) for x in r], int(i % 2)) for i, r in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, rows[0][1], None),
             (n + 4, [None] * 32, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    same = (np.arange(n)[:, None] % 2 == np.arange(n) % 2) & ~np.eye(n, dtype=bool)
    link = (u @ u.T >= 0.93) & same
    found = sum(got[i].n_links for i in range(n))
    assert found <= link.sum() and found >= 0.9 * link.sum() and len(got) == len(rows)
    assert [got[n + k].n_links for k in range(8)] == [0] * 6 + [1, 1]
    assert got[n + 7].component_id == n + 6 and not got[n + 7].kept and got[n].kept
    assert itq.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["common part", "near copies"])
def test_vectors_off_centre(spark, case):
    gen = np.random.default_rng(4)
    if case == "common part":                 # mean cosine about 0.9
        v = gen.standard_normal((600, 64)) + 3 * np.sqrt(64) * np.eye(64)[0]
        v = np.concatenate([v, v[:200] + gen.standard_normal((200, 64)) * 0.8])
    else:                                     # nine rows of ten
        v = gen.standard_normal((400, 64))
        v[:360] = v[0] + gen.standard_normal((360, 64)) * 0.2
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)],
                               "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in itq.near_duplicates(df).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    n = len(v)
    link = (u @ u.T >= 0.93) & (np.arange(n)[:, None] % 2 == np.arange(n) % 2) & ~np.eye(n, dtype=bool)
    assert 100 < link.sum() and 0.9 * link.sum() <= found <= link.sum()


def test_links_between_hosts(spark):
    def page(i, url, *to):
        return i, url, "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [page(1, "http://good.org/a", "http://friend.net/x", "/own"), page(2, "http://friend.net/", "HTTPS://third.net"),
            page(3, "http://third.net/"), page(4, "http://bad.com/de/x"), page(5, "http://linker.net/1", "//bad.com/de/y"),
            page(6, "http://alone.net/"), (7, None, None), (8, "no scheme", "<a href=//bad.com>"), page(9, "x://ES.Example.org/es/1?q")]
    got = {r.page_id: r for r in linkgraph.judge(
        spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert {i: got[i].verdict for i in got if i != 8} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block",
                                                         6: "allow", 7: "block", 9: "block"}
    assert (got[9].host, got[9].path, got[9].rule) == ("es.example.org", "/es/1", "example.org/es/")
    assert got[7].host == got[7].path == "" and got[7].rule is None


def test_links_reach_any_depth(spark):
    """A chain of hosts towards a blocked one, and the fixed point of a graph with cycles."""
    rows = [(i, f"http://h{i}.net/", f"<a href=//h{i - 1}.net>") for i in range(1, 31)]
    rows += [(0, "http://h0.net/", "<a href=//x.net>"), (99, "http://x.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in linkgraph.judge(pages, [("block", "x.net", "/")]).collect()}
    assert set(got.values()) == {"block"} and len(got) == 32

    gen, n = np.random.default_rng(8), 25
    links = gen.integers(1, 4, (n, n)) * (gen.random((n, n)) < 0.08) * ~np.eye(n, dtype=bool)
    trust, distrust = gen.integers(0, 2, (2, n)).astype(float)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", int(links[a, b])) for a, b in zip(*np.nonzero(links))],
                                  "src string, dst string, links long")
    seeds = spark.createDataFrame([(f"h{i}", float(trust[i]), float(distrust[i])) for i in range(n)],
                                  "host string, trust double, distrust double")
    want = []
    for m, start in ((links, trust), (links.T, distrust)):
        p = m / np.maximum(m.sum(1, keepdims=True), 1)
        want.append(np.linalg.solve(np.eye(n) - linkgraph.DAMPING * p.T, start))
    found = {r.host: (r.trust, r.distrust) for r in linkgraph.propagate(seeds, edges).collect()}
    for i in range(n):
        assert np.allclose(found.get(f"h{i}", (0, 0)), (want[0][i], want[1][i]), rtol=1e-6, atol=0)
