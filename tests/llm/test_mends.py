"""Second runs, clashing column names, long runs, item types, and the pipeline's stages against brute force."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rotamera.llm import bpe, langid, lines, linkgraph, queries, secrets, simhash, tiling
from rotamera.llm.common import private
from test_llm import linked, tiktoken_encoding

rnd = random.Random(31)
CLASH = ("_text_hash", "_cut_key", "_cut", "_cut_hash", "cut", "_th", "_key", "_hash", "_keep_key", "_keep_hash", "_blob",
         "blob", "_bad", "_gone", "_language", "pos", "h1", "_L")


def clashing(df):
    """``df`` with columns named as the operators' own, each holding its name and the key."""
    key = df.columns[0]
    return df.withColumns({c: F.concat(F.lit(c + ":"), F.col(key).cast("string")) for c in CLASH})


def untouched(rows):
    return all(r[c] == (None if r[0] is None else f"{c}:{r[0]}") for r in rows for c in CLASH)


def test_private_names(spark):
    df = spark.createDataFrame([], "a int, _B int, __b int")
    assert private(df, "_b", "_b", "c", "A") == ["___b", "____b", "c", "_A"]


def test_operators_leave_clashing_columns_alone(spark):
    passage = "one line\ntwo line\nthree line"
    docs = spark.createDataFrame([(1, passage), (2, passage + "\nmore"), (3, None), (3, "password = hunter22"), (4, "")],
                                 "doc_id long, text string")
    plain, wide = lines.dedup(docs, removed="gone"), lines.dedup(clashing(docs), removed="gone")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, wide.select(*plain.columns).collect()))
    assert untouched(wide.collect())
    kept = simhash.keep_one(clashing(docs))
    assert untouched(kept.collect())
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(
        map(repr, simhash.keep_one(docs).collect()))
    found, _ = secrets.advance(clashing(docs))
    at = secrets.at_paths(clashing(docs), secrets.spans(found)).collect()
    assert untouched(at) and [r.doc_id for r in at if r.found] == [3]
    pages = spark.createDataFrame([(1, "http://a.com/x", '<a href="http://b.example.org/es/">')],
                                  "page_id long, url string, html string")
    rules = queries.URL_RULES
    assert untouched(linkgraph.judge(clashing(pages), rules).collect())


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:4]], ids=lambda s: s[0])
def test_stages_return_the_columns_they_get(spark, tmp_path, stage):
    docs = spark.createDataFrame([(i, f"some words here number {i} and on.", "en", "s", 30) for i in range(40)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, "nothing of that kind stands in it")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage[1](spark, clashing(docs), str(tmp_path))
    assert out.columns == clashing(docs).columns and untouched(out.collect())


# --- secrets: a second run ----------------------------------------------------

def at(docs, found):
    return {r.doc_id: [(x.kind, x.start, x.end) for x in r.found or []]
            for r in secrets.at_paths(docs, secrets.spans(found)).collect()}


def test_a_known_secret_shows_at_a_new_path(spark):
    text = "x password = hunter22 y AKIA" + "A1" * 9
    first = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    second = first.unionByName(spark.createDataFrame([(9, text), (10, "secret: abcdef0"), (11, "")], first.schema))
    one, ledger = secrets.advance(first)
    assert secrets.scan(first, ledger=ledger)[0].count() == 0
    two, ledger = secrets.advance(second, ledger=ledger, stored=one)
    whole, _ = secrets.advance(second)
    assert at(second, two) == at(second, whole) and at(second, two)[9] == at(second, two)[1] != []
    assert ledger.count() == ledger.distinct().count()
    newer = tuple(secrets.Rule(r.kind, r.pattern, r.least, r.group, 2 if r.kind == "access" else 1, r.literals)
                  for r in secrets.RULES)
    three, ledger = secrets.advance(second, ledger=ledger, stored=two, rules=newer)
    assert at(second, three) == at(second, whole)
    assert three.where("kind = 'access' and version = 1").count() == 0
    none, entries = secrets.advance(first.limit(0))
    assert none.count() == 0 and entries.count() == 0


# --- byte pairs: long runs ----------------------------------------------------

def test_long_runs_equal_the_library():
    enc, codec = tiktoken_encoding(), bpe.Codec(bpe.load_ranks(queries.RANKS), queries.PATTERN)
    for t in ("=" * 70_001, "a" * 60_001, " " * 99_999, "ab" * 40_000, "é" * 20_000, "=" * 4097 + "x" + "-" * 9999,
              "".join(rnd.choice("abcé") for _ in range(50_000))):
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
    for c in "=a ":
        ids = codec.encode(c * 1_000_000)
        assert codec.decode(ids) == c.encode() * 1_000_000
    for _ in range(200):
        data = bytes(rnd.choice(b"ab=- ") for _ in range(rnd.randint(1, 60)))
        assert codec.merge_long(data) == codec.merge(data)


# --- tiling: item types -------------------------------------------------------

@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "double", "date", "decimal(10,2)"])
def test_items_of_any_type(spark, kind):
    item = F.lit("2020-01-02" if kind == "date" else "7").cast(kind)
    text = "a passage of eleven words that stands in the benchmark whole"
    bench = spark.createDataFrame([(text,)], "text string").withColumn("item_id", item)
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "else"), (3, None)], "doc_id long, text string")
    got = tiling.matches(docs, bench)
    assert dict(got.dtypes)["item_id"] == dict(bench.dtypes)["item_id"]
    assert got.select("doc_id").collect() == [(1,)]
    assert got.first().item_id == bench.first().item_id
    assert sorted(r.doc_id for r in tiling.clean(docs, bench).collect()) == [2, 3]


# --- the pipeline against brute force -----------------------------------------

SF = "/root/testdata/sf0.001"


def plain_prediction(model, text, letters):
    """One n-gram after the other."""
    grams = dict(zip(*(x.tolist() for x in langid.bag(text, letters))))
    if not grams:
        return "und", 0.0, True
    total = sum(grams.values())
    z = [sum(n * float(model.table[g, k]) for g, n in grams.items()) / total + float(model.bias[k])
         for k in range(len(model.labels))]
    p = [math.exp((x - max(z)) * model.temperature) for x in z]
    p = [x / sum(p) for x in p]
    best = p.index(max(p))
    known = sum(n * float(model.shares[g, best]) for g, n in grams.items()) / total
    return model.labels[best], p[best], p[best] < model.threshold or known < model.usual


def without_repeats(rows):
    """Lines that stand at a later occurrence of a window of three lines go."""
    first, out = {}, {}
    order = sorted(rows, key=lambda r: r["doc_id"])
    split = {r["doc_id"]: r["text"].split("\n") for r in order}
    for r in order:
        own = split[r["doc_id"]]
        for i in range(max(1, len(own) - 2)):
            first.setdefault(tuple(own[i:i + 3]), (r["doc_id"], i))
    for r in order:
        own, gone = split[r["doc_id"]], set()
        for i in range(max(1, len(own) - 2)):
            w = tuple(own[i:i + 3])
            if first[w] != (r["doc_id"], i) and any(x.strip(" ") for x in w):
                gone |= set(range(i, i + len(w)))
        text = "\n".join(x for i, x in enumerate(own) if i not in gone)
        if not gone or text.strip(" "):
            out[r["doc_id"]] = (text, len(text) if gone else r["n_chars"])
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, SF).cache()
    model, letters = langid.fit(docs), langid.letter_table()
    said = {r.doc_id: plain_prediction(model, r.text, letters) for r in docs.collect()}
    assert {r.doc_id for r in one.collect()} == {d for d, (_, _, rejected) in said.items() if not rejected}
    got = docs.select("doc_id", langid.predict(docs, model).alias("p")).collect()
    assert {r.doc_id: (r.p.lang_pred, pytest.approx(r.p.score), r.p.rejected) for r in got} == said
    assert all(said[r.doc_id] == ("und", 0.0, True) for r in docs.collect() if not re.search(r"[^\W\d_]", r.text or ""))
    two = stages["line_dedup"](spark, one, SF).cache()
    want = without_repeats([r for r in one.collect() if r.text is not None])
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == want
    three = stages["near_duplicates"](spark, two, SF).cache()
    prints = {r.doc_id: simhash.fingerprint_of(r.text) for r in two.collect()}
    root, low = linked(set(prints.values())), {}
    for d in sorted(prints):
        low.setdefault(root[prints[d]], d)
    assert {r.doc_id for r in three.collect()} == set(low.values())
    four = stages["decontaminate"](spark, three, SF).cache()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = tiling.Index(items, tiling.SEED, tiling.COVER)
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect() if not index.matches(r.text)}
    five = stages["byte_bpe"](spark, four, SF).collect()
    enc, texts = tiktoken_encoding(), {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in five} == {
        d: enc.encode_ordinary(t) for d, t in texts.items()}


def test_lattice_without_logs_equals_the_one_with_logs():
    """Expected uses too; words whose probability would underflow take the logs."""
    from collections import defaultdict

    from rotamera.llm import lattice
    scores = {p: -0.3 * n - 1.0 for n, p in enumerate([b"a", b"b", b"ab", b"aba", b" ", b" a", b"ba", lattice.END])}
    prefixes = lattice.trie(scores)
    weights = lattice.plain(prefixes)
    for word in (b"a", b"abab", b"babaab", b"c", b"ab" * 40, b"ab" * 2000):
        want = lattice.log_probability(word, prefixes, -9.0, -0.1)
        assert math.isclose(lattice.log_probability(word, prefixes, -9.0, -0.1, weights), want, rel_tol=1e-13)
        if word != b"c":
            plain, logs = defaultdict(float), defaultdict(float)
            lattice.expected(word, prefixes, plain, weights)
            lattice.expected(word, prefixes, logs)
            assert {p: round(v, 8) for p, v in plain.items() if v} == {p: round(v, 8) for p, v in logs.items() if v}
    assert lattice.plain_forward(b" " + b"ab" * 2000, weights)[0][-1] < lattice.LEAST


def test_texts_of_a_batch_are_made_a_few_at_a_time():
    import pyarrow as pa

    from rotamera.llm.common import texts_of

    class Watched:
        def __init__(self, a):
            self.a, self.most = a, 0

        def __len__(self):
            return len(self.a)

        def slice(self, lo, n):
            part = self.a.slice(lo, n)
            self.most = max(self.most, len(part))
            return part
    held = Watched(pa.array([None if i % 7 == 0 else str(i) for i in range(1000)]))
    assert list(texts_of(held)) == held.a.to_pylist() and held.most == 256


def test_ids_and_what_they_decode_to_come_from_one_worker(spark):
    texts = [None, "", "a b", "ä" * 300, "x" * 5000] + [f"word{i} and {i * i}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    code = bpe.coder(spark, queries.RANKS, queries.PATTERN)
    both = df.select("i", code("text").alias("c")).select("i", "c.*")
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    codec = bpe.Codec(bpe.load_ranks(queries.RANKS), queries.PATTERN)
    got = {r.i: (bytes(r.ids), bytes(r.back)) for r in both.collect()}
    assert got == {i: (codec.encode(t), (t or "").encode()) for i, t in enumerate(texts)}
