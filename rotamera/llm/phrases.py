"""Phrase collocations by level-wise counting through double-array tries.

Texts become numbers once: a shard is the words of one language out of a bounded amount of text, with
its own word list. Levels follow Apriori: only words that are frequent in the whole language can stand
in a frequent pair, only frequent pairs in a frequent triple. Each shard puts its candidates
(phrases seen in it whose parts are all frequent) into a double-array trie over base-64 digits of
word numbers, advances the states of all positions at once digit by digit, and counts the accepting
states with ``bincount``; Spark adds up the shards.

The tries are not broadcast whole. Candidates grow with the corpus, so nothing bounds
them; a shard's trie holds only what occurs in the shard. Counts of shards are dealt out by hash ranges of
the phrase, packed, one row per shard and range; a range is summed in one task, which numbers the frequent
phrases and tells each shard those it has. So a phrase that stands in all shards is one number a shard,
and nothing of the corpus passes through the driver.

Score of a phrase of count a, cut into parts of counts l and r: floor(1000000 a a / (l r)), the
lowest over all cuts, in exact decimals of 38 digits (counts up to 10^16). A phrase goes if
a longer candidate around it has at least half its count.

Defined results: a null text is empty, a null language is ``und``. A-Z count as a-z. Phrases do not
cross pieces, counts include overlaps. Repeated rows count as often as they occur. Ties in score follow
the count, then the bytes of the phrase. An empty table gives no rows. Texts are read whole; only a single
text larger than ``SHARD`` makes a shard larger.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rotamera.llm.common import runs, written
from rotamera.operators.grouping import lookup
from rotamera.session import cut_lineage

LEAST = 10               # occurrences that make a phrase frequent
TOP = 2000
HALF = 50                # percent of a count that a longer phrase must have to replace it
SHARD = 8 << 20          # bytes of text of a shard
RANGE = 2_000_000        # words of text for which there is a range of pairs
SALTS = 32               # first rounds of the ranking
SPLIT = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes.maketrans(bytes(range(65, 91)) + SPLIT + b"\t",
                        bytes(range(97, 123)) + b"\n" * len(SPLIT) + b" ")
TOKEN = re.compile(rb"[^ \n]+|\n")
BITS = 6
WIDTH = 1 << BITS


class DoubleArray:
    """Trie of distinct phrases, given as sorted rows of word numbers. The children of state s
    are the slots base[s] + digit whose check is s. Slot 0 is the dead state, 1 the root."""

    def __init__(self, phrases: np.ndarray):
        n, k = phrases.shape
        top = int(phrases.max()) if n else 0
        self.shifts = range(max(0, (top.bit_length() - 1) // BITS) * BITS, -1, -BITS)
        self.base = np.zeros(2 * WIDTH, np.int32)
        self.check = np.full(2 * WIDTH, -1, np.int32)
        self.used = 2 * WIDTH
        state = np.ones(n, np.int32)
        new = np.zeros(n, bool)
        new[:1] = True
        for column in range(k):
            for shift in self.shifts:
                digit = (phrases[:, column] >> shift) & (WIDTH - 1)
                new[1:] |= (digit[1:] != digit[:-1])
                first = np.flatnonzero(new)
                slots = self._place(state[first], digit[first])
                state = slots[np.cumsum(new) - 1] if n else state
        self.leaf = state

    def _room(self, size: int):
        more = self.used + size + WIDTH - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def _place(self, parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Slots for children (parent, digit), sorted by parent."""
        starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, int)
        many = np.diff(np.r_[starts, len(parent)])
        owner = np.repeat(np.arange(len(starts)), many)
        base = np.zeros(len(starts), np.int32)
        self._room(WIDTH * int((many >= 16).sum()) + 3 * int(many.sum()) + 2 * WIDTH)
        full = many >= 16                     # nearly dense: a block each
        base[full] = self.used + WIDTH * np.arange(full.sum())
        self.used += WIDTH * int(full.sum())
        low, span = self.used, 3 * int(many[~full].sum()) + WIDTH
        claim = np.full(span + WIDTH, -1, np.int32)
        taken = np.zeros(span + WIDTH, bool)
        rng = np.random.default_rng(len(parent))
        for lo, hi in ((8, 16), (4, 8), (2, 4)):
            todo = np.flatnonzero((many >= lo) & (many < hi))
            while len(todo):                  # all try a place, those in nobody's way stay
                tried = rng.integers(0, span, len(todo)).astype(np.int32)
                size = many[todo]
                at = np.repeat(starts[todo] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                mine = np.repeat(np.arange(len(todo), dtype=np.int32), size)
                slot = np.repeat(tried, size) + digit[at]
                claim[slot] = mine
                bad = np.bincount(mine[taken[slot] | (claim[slot] != mine)], minlength=len(todo)) > 0
                taken[slot[~bad[mine]]] = True
                base[todo[~bad]] = low + tried[~bad]
                todo = todo[bad]
        single = np.flatnonzero(many == 1)    # fill what is free
        free = np.flatnonzero(~taken)[:len(single)]
        base[single] = low + free - digit[starts[single]]
        self.used = low + span + WIDTH if len(starts) else self.used
        slots = base[owner] + digit
        self.base[parent[starts]] = base
        self.check[slots] = parent
        return slots.astype(np.int32)

    def walk(self, words: list[np.ndarray]) -> np.ndarray:
        """The state after each column of word numbers, for all positions at once."""
        state = np.ones(len(words[0]), np.int32)
        for column in words:
            state = np.where(column < WIDTH << self.shifts[0], state, 0)
            for shift in self.shifts:
                to = self.base[state] + ((column >> shift) & (WIDTH - 1))
                state = np.where(self.check[to] == state, to, 0)
        return state

    def count(self, words: list[np.ndarray]) -> np.ndarray:
        """How often each phrase is accepted."""
        return np.bincount(self.walk(words), minlength=len(self.check))[self.leaf]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers, byte by byte, compressed."""
    out = []
    for c in columns:
        width = c.dtype.itemsize
        planes = pa.compress(np.ascontiguousarray(c.view(np.uint8).reshape(-1, width).T), "zstd", asbytes=True)
        out.append(b"".join(x.to_bytes(8, "little") for x in (len(c), width, len(planes))) + planes)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, size = (int.from_bytes(data[at + i:at + i + 8], "little") for i in (0, 8, 16))
        at += 24 + size
        planes = np.frombuffer(pa.decompress(data[at - size:at], n * width, "zstd", asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).view(f"<i{width}").ravel())
    return out


def _ranges(hashes: np.ndarray, ranges: int):
    """(range, positions) of each range that has any."""
    at = (hashes % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    edge = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else []
    for lo, hi in zip(edge, [*edge[1:], len(at)]):
        yield int(at[order[lo]]), order[lo:hi]


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """One row; columns that are not given are null, arrays become lists."""
    def one(f):
        v = columns.get(f.name)
        if v is not None and pa.types.is_list(f.type):
            v = v if isinstance(v, pa.Array) else pa.array(v, f.type.value_type)
            return pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.array([v], f.type)
    return pa.RecordBatch.from_arrays([one(f) for f in schema], schema=schema)


SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("range", pa.int32()), ("codes", pa.binary()),
                    ("total", pa.int64()), ("code", pa.list_(pa.int32())), ("text", pa.list_(pa.string())),
                    ("n", pa.list_(pa.int64()))])
WORDS = pa.schema([("shard", pa.int64()), ("lang", pa.list_(pa.string())), ("text", pa.list_(pa.string())),
                   ("n", pa.list_(pa.int64())), ("word", pa.list_(pa.int64())), ("data", pa.binary())])
SEEN = pa.schema([("range", pa.int32()), ("shard", pa.int64()), ("data", pa.binary())])
COUNTED = pa.schema([("shard", pa.int64()), ("one", pa.list_(pa.int64())), ("two", pa.list_(pa.int64())),
                     ("n", pa.list_(pa.int64())), ("number", pa.list_(pa.int64())), ("data", pa.binary())])


def _shards(batches, ranges: int):
    """For each language and ``SHARD`` bytes of text one row with the word codes of all positions (0:
    a cut between pieces), and rows with the words that codes 1.. stand for, by hash range."""
    held: dict = {}
    size, number = 0, TaskContext.get().partitionId() << 32

    def flush():
        nonlocal number
        for lang, (code, codes) in sorted(held.items()):
            codes = np.frombuffer(codes, np.int32)
            counts = np.bincount(codes, minlength=len(code))
            yield _batch(SHARDS, shard=number, lang=lang, range=-1, codes=packed(codes), total=int(counts[1:].sum()))
            words = list(code)[1:]
            hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
            words = pa.array(words, pa.binary()).cast(pa.string())
            for r, at in _ranges(hashes, ranges):
                yield _batch(SHARDS, shard=number, lang=lang, range=r, code=(at + 1).astype(np.int32),
                             text=words.take(pa.array(at)), n=counts[at + 1])
            number += 1
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode()
            code, codes = held.setdefault(lang, ({b"\n": 0}, array("i")))
            tokens = TOKEN.findall(raw.translate(CLEAN))
            for w in dict.fromkeys(tokens):
                code.setdefault(w, len(code))
            codes.extend(map(code.__getitem__, tokens))
            codes.append(0)
            size += len(raw) + 1
            if size >= SHARD:
                yield from flush()
                size = 0
    yield from flush()


def _flat(r: pa.Table, column: str) -> pa.Array:
    return r.column(column).combine_chunks().flatten()


def _lengths(r: pa.Table, column: str) -> np.ndarray:
    return np.array([len(x) for x in r.column(column)], np.int64)


def _sum_words(batches, least: int):
    """Ranges of words -> the frequent ones, numbered, and for each shard the codes it has for them."""
    for r in runs(batches, ["range"]):
        number = r.column("range")[0].as_py() << 32
        size = _lengths(r, "code")
        row = np.repeat(np.arange(len(size)), size)
        lang, text = r.column("lang").combine_chunks().take(pa.array(row)), _flat(r, "text")
        key = pc.binary_join_element_wise(lang, text, " ").dictionary_encode()
        group = key.indices.to_numpy()
        total = np.zeros(len(key.dictionary), np.int64)
        np.add.at(total, group, _flat(r, "n").to_numpy())
        first = np.zeros(len(total), np.int64)
        first[group[::-1]] = np.arange(len(group))[::-1]
        known = np.flatnonzero(total >= least)
        name = np.full(len(total), -1, np.int64)
        name[known] = number + np.arange(len(known))
        at = pa.array(first[known])
        yield _batch(WORDS, shard=-1, lang=lang.take(at), text=text.take(at), n=total[known], word=name[known])
        word, code = name[group], _flat(r, "code").to_numpy()
        edge = np.r_[0, np.cumsum(size)]
        for i, shard in enumerate(r.column("shard").to_pylist()):
            w, c = word[edge[i]:edge[i + 1]], code[edge[i]:edge[i + 1]]
            if (w >= 0).any():
                yield _batch(WORDS, shard=shard, data=packed(c[w >= 0], w[w >= 0]))


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield pa.Table.from_batches([b.slice(i, 1)])


def _lists(r: pa.Table, column: str) -> list[np.ndarray]:
    """The packed columns of one row's list, end to end."""
    return [np.concatenate(x) for x in zip(*map(unpacked, r.column(column)[0].as_py()))]


def _frequent(r: pa.Table):
    """A shard's frequent words, renumbered from 0 by their global numbers: at each position its number
    or -1, and the global numbers."""
    code, word = _lists(r, "frequent")
    order = np.argsort(word)
    codes, = unpacked(r.column("codes")[0].as_py())
    number = np.full(max(int(codes.max(initial=0)), int(code.max(initial=0))) + 1, -1, np.int64)
    number[code[order]] = np.arange(len(code))
    return number[codes], word[order]


def _pairs(batches, ranges: int):
    """Candidate pairs of each shard with their counts, by hash range."""
    for r in _rows(batches):
        s, word = _frequent(r)
        a, b = s[:-1], s[1:]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        seen = np.stack(np.divmod(np.unique(a * len(word) + b), max(1, len(word))), 1)
        n = DoubleArray(seen).count([a, b])
        yield from _dealt(word[seen[:, 0]], word[seen[:, 1]], n, ranges, r.column("shard")[0].as_py())


def _dealt(one: np.ndarray, two: np.ndarray, n: np.ndarray, ranges: int, shard: int):
    """Counts of (one, two), ascending, by hash range."""
    hashes = one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + two.astype(np.uint64)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    for k, at in _ranges(hashes, ranges):
        yield _batch(SEEN, range=k, shard=shard, data=packed(np.diff(one[at], prepend=0), two[at], n[at].astype(np.int32)))


def _sum_ranges(batches, least: int):
    """Ranges of counts of (one, two) -> the frequent ones, numbered, and for each shard those it has."""
    for r in runs(batches, ["range"]):
        base = r.column("range")[0].as_py() << 32
        parts = [unpacked(x) for x in r.column("data").to_pylist()]
        one, two, n = (np.concatenate(x) for x in zip(*((np.cumsum(step), two, n) for step, two, n in parts)))
        edge = np.r_[0, np.cumsum([len(p[0]) for p in parts])]
        order = np.lexsort((two, one))
        new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]
        first = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.int64), first)
        known = np.flatnonzero(total >= least)
        name = np.full(len(total), -1, np.int64)
        name[known] = base + np.arange(len(known))
        number = np.empty(len(one), np.int64)
        number[order] = name[np.cumsum(new) - 1]
        at = order[first[known]]
        yield _batch(COUNTED, shard=-1, one=one[at], two=two[at], n=total[known], number=name[known])
        for i, shard in enumerate(r.column("shard").to_pylist()):
            own = np.flatnonzero(number[edge[i]:edge[i + 1]] >= 0) + edge[i]
            if len(own) and shard >= 0:
                yield _batch(COUNTED, shard=shard, data=packed(one[own], two[own], number[own]))


def _triples(batches, ranges: int):
    for r in _rows(batches):
        s, word = _frequent(r)
        one, two, pair = _lists(r, "pairs")
        a, b = np.searchsorted(word, one), np.searchsorted(word, two)
        order = np.lexsort((b, a))
        a, b, pair = a[order], b[order], pair[order]
        trie = DoubleArray(np.stack([a, b], 1).astype(np.int64))
        at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
        which = np.full(len(trie.check), -1, np.int64)
        which[trie.leaf] = np.arange(len(pair))
        starts = np.full(len(s) + 1, -1, np.int64)      # the frequent pair that starts here
        starts[at] = which[trie.walk([s[at], s[at + 1]])]
        at = np.flatnonzero((starts[:-1] >= 0) & (starts[1:] >= 0))
        key = np.unique(starts[at] * len(pair) + starts[at + 1])
        if not len(key):
            continue
        one, two = np.divmod(key, len(pair))
        seen = np.stack([a[one], b[one], b[two]], 1).astype(np.int64)
        place = np.lexsort(seen.T[::-1])
        n = np.empty(len(seen), np.int64)
        n[place] = DoubleArray(seen[place]).count([s[at], s[at + 1], s[at + 2]])
        one, two = pair[one], pair[two]
        order = np.lexsort((two, one))
        yield from _dealt(one[order], two[order], n[order], ranges, -1)


def _score(a: str, left: str, right: str) -> Column:
    whole = [f"cast({c} as decimal(19,0))" for c in (a, left, right)]
    return F.expr(f"cast(({whole[0]} * {whole[0]} * 1000000) div ({whole[1]} * {whole[2]}) as long)")


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ",".join(f"{f.name} " + (f"array<{kinds[f.type.value_type]}>" if pa.types.is_list(f.type) else kinds[f.type])
                    for f in schema)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST
            ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals, words, pairs, triples): word occurrences per language, and the frequent phrases of
    each length with their counts; pairs name words, triples name their two pairs."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = written(plain.mapInArrow(lambda it: _shards(it, tasks), _ddl(SHARDS)), "shards")
    texts = shards.where("range < 0")
    totals = cut_lineage(texts.groupBy("lang").agg(F.sum("total").alias("total")))

    def ranged(df: DataFrame, n: int) -> DataFrame:
        return df.repartition(n, "range").sortWithinPartitions("range", "shard")
    told = written(ranged(shards.where("range >= 0").select("range", "shard", "lang", "code", "text", "n"), tasks)
                   .mapInArrow(lambda it: _sum_words(it, least), _ddl(WORDS)), "words")
    words = told.where("shard < 0").select(F.inline(F.arrays_zip("word", "lang", "text", "n")))
    frequent = told.where("shard >= 0").groupBy("shard").agg(F.collect_list("data").alias("frequent"))
    encoded = written(texts.select("shard", "codes").join(frequent, "shard"), "encoded")
    most = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    ranges = max(tasks, math.ceil(most / RANGE))

    def summed(df: DataFrame, name: str) -> DataFrame:
        return written(ranged(df, ranges).mapInArrow(lambda it: _sum_ranges(it, least), _ddl(COUNTED)), name)
    told = summed(encoded.mapInArrow(lambda it: _pairs(it, ranges), _ddl(SEEN)), "pairs")
    pairs = told.where("shard < 0").select(F.inline(F.arrays_zip("number", "one", "two", "n"))).toDF(
        "pair", "word1", "word2", "n")
    known = told.where("shard >= 0").groupBy("shard").agg(F.collect_list("data").alias("pairs"))
    told = summed(encoded.join(known, "shard").mapInArrow(lambda it: _triples(it, ranges), _ddl(SEEN)), "triples")
    triples = told.where("shard < 0").select(F.inline(F.arrays_zip("one", "two", "n"))).toDF("pair1", "pair2", "n")
    return totals, words, pairs, triples


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
          half: int = HALF) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    totals, words, pairs, triples = counted(docs, text, lang, least)

    def word(number: int) -> DataFrame:
        return words.select(F.col("word").alias(f"word{number}"), *(["lang"] if number == 1 else []),
                            F.col("text").alias(f"text{number}"), F.col("n").alias(f"n{number}"))
    named = written(pairs.join(word(1), "word1").join(word(2), "word2").drop("word1", "word2"), "pairs-named")
    left = named.select(F.col("pair").alias("pair1"), "lang", F.concat_ws(" ", "text1", "text2").alias("text"),
                        "n1", F.col("n").alias("n12"))
    right = named.select(F.col("pair").alias("pair2"), F.col("text2").alias("text3"), F.col("n2").alias("n3"),
                         F.col("n").alias("n23"))
    cuts = F.least(F.struct(_score("n", "n1", "n23").alias("score"), F.lit(1).alias("k"), F.col("n1").alias("l"),
                            F.col("n23").alias("r")),
                   F.struct(_score("n", "n12", "n3").alias("score"), F.lit(2).alias("k"), F.col("n12").alias("l"),
                            F.col("n3").alias("r")))
    three = (triples.join(left, "pair1").join(right, "pair2").withColumn("cut", cuts)
             .select("lang", F.concat_ws(" ", "text", "text3").alias("phrase"), F.col("n").alias("a"),
                     "cut.l", "cut.r", "cut.score"))
    around = (triples.select("n", F.explode(F.array_distinct(F.array("pair1", "pair2"))).alias("pair"))
              .groupBy("pair").agg(F.max("n").alias("longer")))
    two = (named.join(around, "pair", "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < half * F.col("n")))
        .select("lang", F.concat_ws(" ", "text1", "text2").alias("phrase"), F.col("n").alias("a"),
                F.col("n1").alias("l"), F.col("n2").alias("r"), _score("n", "n1", "n2").alias("score")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language may have any number of phrases: the first of each salt meet in the last round
    first = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = two.unionByName(three).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    last = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return lookup(last.where(F.col("rank") <= top), totals.withColumnRenamed("total", "n"), ["lang"]).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
