"""Phrase mining, personal data and conversation repair against brute force, and their corner cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rotamera.llm import phrases, pii, repair

rnd = random.Random(23)


# --- phrases ------------------------------------------------------------------

def mined(rows, least=10, top=2000, half=50):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in total.items():
        c = {p: v for p, v in f[lang].items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in c.items():
            if any(100 * b >= half * a for q, b in c.items() if len(q) > len(p) and p in zip(q, q[1:])):
                continue
            cuts = [(10**6 * a * a // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    words = ["The", "of", "ÉTÉ", "été", "a", "x y", "日本", "\x00", "b-c", "IN", "um", "zu", "🙂"]
    rows = []
    for i in range(120):
        t = "".join(rnd.choice(words) + rnd.choice([" "] * 9 + ["\t ", ". ", "\n", "; ", "!?"])
                    for _ in range(rnd.randint(0, 60)))
        rows.append((t, ("en", "fr", None)[i % 3]))
    rows += [rows[0]] * 15 + [(None, "en"), ("", None), ("   \n\n", "zz"), ("one two three " * 4000, "zz"),
                             ("new york city. " * 30 + "new york. " * 5, "und")]
    return rows


def test_phrases_equal_plain_counting(spark, corpus, monkeypatch):
    want = mined(corpus)
    for shard in (1 << 23, 200):        # a shard for all, and one for nearly every text
        monkeypatch.setattr(phrases, "SHARD", shard)
        df = spark.createDataFrame([(*r, 1, "k") for r in corpus], "text string, lang string, word int, shard string")
        got = sorted(tuple(r) for r in phrases.mined(df.repartition(3)).collect())
        assert got == want and len(got) > 40


def test_phrases_top_and_thresholds(spark, corpus):
    df = spark.createDataFrame(corpus, "text string, lang string")
    got = sorted(tuple(r) for r in phrases.mined(df, least=3, top=7, half=101).collect())
    assert got == mined(corpus, 3, 7, 101)


def test_phrases_of_nothing(spark):
    assert phrases.mined(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.mined(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**9, 4 * 10**9, 5 * 10**9), (10**15, 10**15, 10**15)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases._score("a", "l", "r")).collect()]
    assert got == [10**6 * a * a // (left * r) for a, left, r in ((3 * 10**9, 4 * 10**9, 5 * 10**9), (10**15,) * 3)]


def test_double_array():
    rng = np.random.default_rng(4)
    for top, n, k in ((1, 3, 2), (5, 8, 2), (100, 500, 2), (300, 5000, 3), (70_000, 60_000, 2)):
        columns = [np.minimum(rng.zipf(1.2, n), top) - 1 for _ in range(k)]
        seen, times = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        trie = phrases.DoubleArray(seen)
        assert (trie.count(columns) == times).all()
        other = [rng.integers(0, 4 * top, n) for _ in range(k)]
        known = set(map(tuple, seen.tolist()))
        accepted = np.isin(trie.walk(other), trie.leaf)
        assert accepted.tolist() == [x in known for x in zip(*(c.tolist() for c in other))]


# --- personal data ------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
            r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20/?#@"'<>]+@[A-Za-z0-9.-]+""")


def searched(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
            fits = {1: lambda: all(len(p) < 9 and int(p) <= 255 for p in m[0].split(".")),
                    2: lambda: 14 <= len(digits) <= 19 and luhn % 10 == 0, 3: lambda: 10 <= len(digits) <= 15}
            if fits.get(kind, lambda: True)():
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_spans_equal_a_search():
    bits = ["a", "b.c", "@", "@x.co", "1", "23", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004",
            "+1 (988) 555-2485", "+49", "10.0.0.1", "256.1.1.1", ".", "..", "-", " ", "é", "🙂", "://",
            "http://u:p@h.de", "%", "+", "255.255", "007.1.2.3", "_", "\n", "(", ")", "1.2.3.4.5.6.7.8.9"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert [x for x in pii.spans(t) if x[1] < 5] == searched(t), t


def test_cues():
    def named(t):
        return [(pii.KINDS[k], t[a:b]) for a, k, b in pii.spans(t)]
    assert named("IBAN: DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert named("iban DE88370400440532013000, lessn 123456, ssn12 999999") == []
    assert named("Account no: 123-456-789; SSN 078-05-1120") == [("account", "123-456-789"), ("account", "078-05-1120")]
    assert named("PASSPORT number #C1234567") == [("account", "C1234567")]


def test_long_texts_cost_in_proportion():
    for unit in ("a", "1", "@", "1.", "+1", "a@", "://", "1 ", "iban ", "+1("):
        assert isinstance(pii.spans(unit * 100_000), list)


def test_find_in_a_table(spark):
    texts = [None, "", "🙂 a@b.co", "x", "🙂 a@b.co", "call +1 (988) 555-2485 " * 3000]
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start int")
    got = {r.doc_id: [tuple(x) for x in r.found] for r in
           df.select("*", pii.find("text").alias("found")).collect()}
    assert got == {i: [(pii.KINDS[k], a, b) for a, k, b in pii.spans(t)] for i, t in enumerate(texts)}
    assert got[2] == [("email", 2, 8)] and len(got[5]) == 3000
    assert df.limit(0).select(pii.find("text")).count() == 0


# --- repair -------------------------------------------------------------------

GRAMMAR = re.compile("(s?(ua)+)?")


def repaired(rows):
    """What ``repair`` gives for one conversation's rows in order, holding all cheapest edits of
    every state."""
    seen, faults = set(), []
    for _, role, text in rows:
        full = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not full else "duplicate" if (role, text) in seen
                      else "truncated" if full[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        out = set(ways)
        for _ in range(3):
            ways = {(step[i, s], c + 3, e + "I", r + (names[i] + ":",)) for s, c, e, r in ways for i in "ua"
                    if (i, s) in step}
            out |= ways
        return cheapest(out)

    def cheapest(ways):
        low = {}
        for s, c, _, _ in ways:
            low[s] = min(c, low.get(s, c))
        return {w for w in ways if w[1] == low[w[0]]}

    ways = {(0, 0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = set()
        for s, c, e, r in inserted(ways):
            new.add((s, c + 4, e + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            c += 3 if fault else 0
            if role and (role[0], s) in step:
                new.add((step[role[0], s], c, e + "K", (*r, f"{role}:{text}")))
            for i in "ua":
                if (i, s) in step:
                    new.add((step[i, s], c + 3, e + "R", (*r, f"{names[i]}:{text}")))
        ways = cheapest(new)
    cost, audit, left = min(w[1:] for w in inserted(ways) if w[0] in (0, 3))
    assert GRAMMAR.fullmatch("".join(x[0] for x in left))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
            "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(left).encode()).hexdigest()}


@pytest.fixture(scope="module")
def turns():
    roles = ["user", "assistant"] * 3 + ["system", "tool", "", None, "uncle", "sage"]
    texts = [None, "", "  \n", "yes", "yes.", "no!\n ", "ok?\n", "x y", "z. ", " "]
    rows = [(conv, rnd.choice([None] + [t] * 12), rnd.choice(roles), rnd.choice(texts))
            for conv in [*range(70), None] for t in range(rnd.randint(1, 9))]
    return rows + [(900, t % 50, rnd.choice(roles), rnd.choice(texts) or f"t{t}.") for t in range(300)] + [
        (901, None, "user", "same.")] * 20 + [(902, 0, "user", "long. " * 50_000), (902, 1, "assistant", "end.")]


def groups(turns):
    out = defaultdict(list)
    for conv, turn, role, text in turns:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
            for c, r in out.items()}


def test_repair_equals_plain_search(spark, turns):
    want = {c: repaired(r) for c, r in groups(turns).items()}
    df = spark.createDataFrame([(*r, 1, "x") for r in turns],
                               "conv_id long, turn long, role string, text string, at int, letter string")
    for block in (4096, 3):
        got = {r.conv_id: r.asDict() for r in repair.repair(df.repartition(5), block=block).collect()}
        assert got.keys() == want.keys()
        for c in want:
            assert {k: got[c][k] for k in want[c]} == want[c], c


def test_rules_do_not_change_matrices():
    for _ in range(60):
        letters = "".join(rnd.choice(repair.LETTERS) for _ in range(rnd.randint(1, 40)))
        rules = [tuple(rnd.choice(repair.LETTERS) for _ in range(2)) for _ in range(4)]
        rules += [(chr(0x100), chr(0x101)), (chr(0x102), "X")]
        plain, packed = (repair.Stretch(repair.Matrices(r), letters) for r in ((), rules))
        assert (plain.cost == packed.cost).all()
        for i, j in itertools.product(range(4), repeat=2):
            if plain.cost[i, j] < repair.NEVER:
                assert plain.edits(i, j) == packed.edits(i, j)


def test_grammar_takes_frequent_pairs_first(spark):
    df = spark.createDataFrame([("BCBCBCBC",), ("BCBC",), ("BCX",), ("BCX",)], "letters string")
    assert repair.grammar(df)[0] == ("B", "C")
    assert repair.grammar(df.limit(0)) == []


def test_damage(spark):
    import zlib
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, map(tuple, repair.damaged(df).collect()))) == sorted(map(repr, want))


def test_no_rows_after_damage(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
