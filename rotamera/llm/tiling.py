"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``SEED`` words are a candidate pair. Its
tiles are found greedily: the longest run of words common to both that is still unmarked in
both is looked for by Karp-Rabin hashes of all windows, marked, and so on down to ``SEED``
words. A pair whose tiles cover at least ``COVER`` of the item's words is a match, whatever
order its passages stand in.

Seeds alone bound the cover from above (a tile is made of seeds), so pairs that cannot reach
the threshold are dropped before tiling, with no effect on the result.

The benchmark is taken in blocks of at most about ``BLOCK_WORDS`` words; each block's items go to all
tasks and the documents are scanned once per block, so nothing sent grows without bound.

Words are runs of letters and digits in lower case. An item of fewer than ``SEED`` words must
occur whole. Items without words match nothing, nor do null or empty texts. Equal items each
match; equal documents get equal results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotamera.llm.common import texts_of

SEED = 5
COVER = 0.8
BLOCK_WORDS = 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def splitter():
    import regex
    return regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` numbers, modulo 2**64, by doubling."""
    with np.errstate(over="ignore"):
        out, have = None, 0                   # hashes of windows of ``have`` numbers
        step, length, power = ids.astype(np.uint64) + np.uint64(1), 1, BASE
        left = size
        while left:
            if left & 1:
                if out is None:
                    out, have = step, length
                else:                         # hash(x + y) = hash(x) * BASE^len(y) + hash(y)
                    n = len(out) - length
                    out = out[:n] * power + step[have:have + n]
                    have += length
            left >>= 1
            if left:
                step = step[:len(step) - length] * power + step[length:]
                power, length = power * power, 2 * length
        return out


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(marked)])
    return c[size:] == c[:-size]


def _meeting(doc, item, doc_marked, item_marked, size):
    """Unmarked windows of ``size`` that occur in both: (starts in item, {hash: starts in doc})."""
    if size > len(doc) or size > len(item):
        return [], {}, None
    hd, hi = _windows(doc, size), _windows(item, size)
    fd = np.flatnonzero(_free(doc_marked, size))
    fi = np.flatnonzero(_free(item_marked, size))
    fd = fd[np.isin(hd[fd], hi[fi])]
    places = defaultdict(list)
    for p in fd.tolist():
        places[int(hd[p])].append(p)
    return [p for p in fi.tolist() if int(hi[p]) in places], places, hi


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of greedy tiles, longest first; ties go to the
    earlier start in the item, then in the document. Numbers below zero match nothing."""
    doc_marked, item_marked = doc < 0, item < 0
    out, top = [], min(len(doc), len(item))

    def common(size):
        starts, places, hashes = _meeting(doc, item, doc_marked, item_marked, size)
        return any(np.array_equal(item[i:i + size], doc[d:d + size])
                   for i in starts for d in places[int(hashes[i])])
    while top >= least:
        lo, hi = least - 1, top               # a common run of a length has all shorter ones
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        if lo < least:
            break
        starts, places, hashes = _meeting(doc, item, doc_marked, item_marked, lo)
        for i in starts:
            if item_marked[i:i + lo].any():
                continue
            for d in places[int(hashes[i])]:
                if not doc_marked[d:d + lo].any() and np.array_equal(item[i:i + lo], doc[d:d + lo]):
                    doc_marked[d:d + lo] = item_marked[i:i + lo] = True
                    out.append((d, i, lo))
                    break
        top = lo - 1
    return out


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[str | None], seed: int, cover: float):
        self.seed, self.cover, self.find = seed, cover, splitter()
        self.number: dict[str, int] = {}
        self.items = []
        codes, owners, places = [], [], []
        self.short = defaultdict(list)        # items below the seed length, by length
        for n, t in enumerate(items):
            w = self.find((t or "").lower())
            ids = np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int64)
            self.items.append(ids)
            if len(ids) >= seed:
                h = _windows(ids, seed)
                codes.append(h)
                owners.append(np.full(len(h), n))
                places.append(np.arange(len(h)))
            elif len(ids):
                self.short[len(ids)].append((int(_windows(ids, len(ids))[0]), n))
        cat = (lambda x: np.concatenate(x)) if codes else (lambda x: np.zeros(0, np.uint64))
        codes, owners, places = cat(codes), cat(owners).astype(int), cat(places).astype(int)
        order = np.argsort(codes, kind="stable")
        self.codes, self.owners, self.places = codes[order], owners[order], places[order]
        self.distinct = np.unique(self.codes)

    def matches(self, text: str | None) -> list[tuple[int, int, int, list]]:
        """(item, words covered, words of the item, tiles) of the items that match."""
        get = self.number.get
        ids = np.array([get(x, -1) for x in self.find((text or "").lower())], np.int64)
        out = []
        for size, wanted in self.short.items():
            if len(ids) >= size:
                at = np.flatnonzero(_free(ids < 0, size))
                have = set(_windows(ids, size)[at].tolist())
                for h, n in wanted:
                    if h in have and (t := tiles(ids, self.items[n], size)):
                        out.append((n, size, size, t))
        if len(ids) >= self.seed:
            at = np.flatnonzero(_free(ids < 0, self.seed))
            if len(at):
                h = _windows(ids, self.seed)[at]
                spot = np.minimum(np.searchsorted(self.distinct, h), len(self.distinct) - 1)
                h = np.unique(h[self.distinct[spot] == h]) if len(self.distinct) else h[:0]
                lo, hi = np.searchsorted(self.codes, h), np.searchsorted(self.codes, h, "right")
                hits = defaultdict(list)
                for a, b in zip(lo.tolist(), hi.tolist()):
                    for k in range(a, b):
                        hits[int(self.owners[k])].append(int(self.places[k]))
                for n, places in sorted(hits.items()):
                    item = self.items[n]
                    seen = np.zeros(len(item), bool)
                    for p in places:
                        seen[p:p + self.seed] = True
                    if seen.sum() < self.cover * len(item):
                        continue
                    t = tiles(ids, item, self.seed)
                    covered = sum(x[2] for x in t)
                    if covered >= self.cover * len(item):
                        out.append((n, covered, len(item), t))
        return out


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list]:
    """The benchmark's rows in bounded lists of (item as text, text)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))) / 4 + 1
    total = rows.agg(F.sum(size).alias("s")).first()["s"] or 0
    n = int(total // block_words) + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        got = [(r["item"], r["text"]) for r in part.collect()]
        got.sort(key=lambda r: (r[0] is not None, r[0], r[1] or ""))
        yield got


def finder(docs: DataFrame, items: list, seed: int, cover: float):
    """A Column function: text -> array of matches with a list of (item as text, text)."""
    shared = docs.sparkSession.sparkContext.broadcast({"items": items})

    @F.arrow_udf("array<struct<item:string,covered:int,words:int,"
                 "tiles:array<struct<doc_at:int,item_at:int,length:int>>>>")
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value
        names = [i for i, _ in held["items"]]
        if "index" not in held:      # kept beside the broadcast list for a worker's next task
            held["index"] = Index([t for _, t in held["items"]], seed, cover)
        index = held["index"]
        arrow = pa.list_(pa.struct([
            ("item", pa.string()), ("covered", pa.int32()), ("words", pa.int32()),
            ("tiles", pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()),
                                          ("length", pa.int32())])))]))
        for a in texts:
            yield pa.array([[{"item": names[n], "covered": c, "words": w,
                              "tiles": [dict(zip(("doc_at", "item_at", "length"), x)) for x in t]}
                             for n, c, w, t in index.matches(x)] for x in texts_of(a)], arrow)
    return find


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            item: str = "item_id", item_text: str = "text", seed: int = SEED,
            cover: float = COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, item, covered, words, tiles): every document and item whose tiles reach the
    threshold, one row for each."""
    kind = dict(benchmark.dtypes)[item]
    out = None
    for items in blocks(benchmark, item, item_text, block_words):
        find = finder(docs, items, seed, cover)
        part = (docs.select(F.col(key).alias(key), find(F.col(text)).alias("_m"))
                .select(key, F.explode("_m").alias("_m"))
                .select(key, F.col("_m.item").cast(kind).alias(item), "_m.covered", "_m.words", "_m.tiles"))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text", seed: int = SEED, cover: float = COVER,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that match no item, columns as they were."""
    for items in blocks(benchmark, item, item_text, block_words):
        find = finder(docs, items, seed, cover)
        docs = docs.where(F.size(find(F.col(text))) == 0)
    return docs
