"""Byte-level BPE as a monoid: halves are encoded on their own and joined where they meet.

Two levels, both joined by re-encoding a growing window around the seam:

* text -> matches of the splitting pattern. A match is settled if its scan ended before the
  end of the half; on the right any common match start settles all that follows, since the
  pattern looks only ahead.
* match -> tokens. A sequence of tokens is the encoding of its bytes if and only if every two
  neighbours are the encoding of theirs, so a seam is settled once the pairs at both ends of
  the window are.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Equal rows get
equal results. Other columns are never touched, since both directions are Column functions.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

LEAF_BYTES = 64          # shorter matches are merged directly
HEAP_BYTES = 256         # longer ones through a heap
LEAF_CHARS = 1 << 14     # shorter texts are scanned at once
CACHE = 120_000          # distinct matches of each of two generations a worker remembers
NO_RANK = 1 << 32        # above every rank


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks, self.scan = ranks, regex.compile(pattern).findall
        self.vocab = {r: t for t, r in ranks.items()}
        self.packs = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    # matches -> tokens -----------------------------------------------------------------
    def merge(self, data: bytes) -> list[bytes]:
        """Merge the neighbours of lowest rank, leftmost first, until none is in the
        vocabulary."""
        if len(data) > HEAP_BYTES:
            return self.merge_long(data)
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.ranks.get
        pairs = [rank(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != NO_RANK:
            at = pairs.index(best)
            both = parts[at] + parts[at + 1]
            parts[at:at + 2] = [both]
            del pairs[at]                     # only the pairs beside the merge change
            if at:
                pairs[at - 1] = rank(parts[at - 1] + both, NO_RANK)
            if at < len(pairs):
                pairs[at] = rank(both + parts[at + 1], NO_RANK)
        return parts

    def merge_long(self, data: bytes) -> list[bytes]:
        """The same over a linked list with a heap of (rank, place), in n log n: a run of one
        character settles only at its ends, so its windows are as long as it is."""
        n, rank = len(data), self.ranks.get
        parts: list = [data[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(data[i:i + 2]) for i in range(n - 1)] + [None]     # rank of a part and the next
        heap = [(r, i) for i, r in enumerate(now) if r is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if now[i] != r:                   # one of the two has been merged otherwise
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = now[j] = None
            after[i] = k = after[j]
            now[i] = None
            if k < n:
                before[k] = i
                now[i] = rank(parts[i] + parts[k])
                if now[i] is not None:
                    heappush(heap, (now[i], i))
            h = before[i]
            if h >= 0:
                now[h] = rank(parts[h] + parts[i])
                if now[h] is not None:
                    heappush(heap, (now[h], h))
        return [x for x in parts if x is not None]

    def settled(self, a: bytes, b: bytes) -> bool:
        """Whether a, b is the encoding of their bytes."""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            self.pairs[key] = self.merge(a + b) == [a, b]
        return self.pairs[key]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(left[i:] + right[:j]))
            if ((i == 0 or self.settled(left[i - 1], window[0]))
                    and (j == len(right) or self.settled(window[-1], right[j]))):
                return left[:i] + window + right[j:]
            k *= 2

    def tokens(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF_BYTES:
            whole = data in self.ranks
            return [data] if whole and data else self.merge(data)
        # runs of one character pair up by powers of two, so cut there their seams settle at once
        half = len(data) // 2 if len(data) <= HEAP_BYTES else 1 << (len(data) - 1).bit_length() - 1
        return self.join(self.tokens(data[:half]), self.tokens(data[half:]))

    # text -> matches -------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.scan(text)
        half = len(text) // 2
        return self.seam(self.split(text[:half]), self.split(text[half:]))

    def seam(self, left: list[str], right: list[str]) -> list[str]:
        """Scan anew from the last match that may have looked past the end of the left half,
        up to a match start that both scans share."""
        tail = ""
        while left and len(tail) < 2:
            tail = left.pop() + tail
        k = 4
        while True:
            k = min(k, len(right))
            ends, at = {}, len(tail)
            for n, m in enumerate(right[:k]):
                ends[at] = n
                at += len(m)
            window = self.scan(tail + "".join(right[:k]))
            if k == len(right):
                return left + window
            at = 0
            for n, m in enumerate(window):
                # this match begins where one of the right half does, far from the end
                if at in ends and ends[at] < k - 2:
                    return left + window[:n] + right[ends[at]:]
                at += len(m)
            k *= 4

    # whole texts -----------------------------------------------------------------------
    def packed(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = b"".join(map(self.packs.__getitem__, self.tokens(match.encode())))
        if len(match) < 64:
            if len(self.known) >= CACHE:
                self.known, self.older = {}, self.known
            self.known[match] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        found = self.split(text)
        out = list(map(self.known.get, found))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            out[at] = self.packed(found[at])
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of packed ids, halves concatenated up the tree."""
        if not ids:
            return b""
        import numpy as np
        numbers = np.frombuffer(ids, "<u4").tolist()
        vocab = self.vocab

        def part(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return b"".join([vocab[i] for i in numbers[lo:hi]])
            mid = (lo + hi) // 2
            return part(lo, mid) + part(mid, hi)
        return part(0, len(numbers))


def _shared(spark: SparkSession, path: str):
    """A vocabulary file's ranks for all executors; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast({"ranks": load_ranks(path)})


def _codec(held: dict, pattern: str) -> Codec:
    """The codec of a Python worker: kept beside the broadcast ranks, so that the worker's next
    task finds the matches it remembers. Nothing depends on whether it does."""
    if "codec" not in held:
        held["codec"] = Codec(held["ranks"], pattern)
    return held["codec"]


def _few(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of an Arrow column a few rows at a time, for results that leave as they are made."""
    for lo in range(0, len(column), rows):
        yield column.slice(lo, rows).to_pylist()


def encoder(spark: SparkSession, path: str, pattern: str):
    """A Column function: text -> ids, packed as little-endian unsigned 32-bit integers."""
    ranks = _shared(spark, path)

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks.value, pattern)
        for a in texts:
            for some in _few(a):
                yield pa.array([codec.encode(t) for t in some], pa.binary())
    return encode


def decoder(spark: SparkSession, path: str, pattern: str):
    """A Column function: packed ids -> bytes of the text."""
    ranks = _shared(spark, path)

    @F.arrow_udf("binary")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks.value, pattern)
        for a in ids:
            for some in _few(a):
                yield pa.array([codec.decode(x) for x in some], pa.binary())
    return decode


def coder(spark: SparkSession, path: str, pattern: str):
    """A Column function: text -> (ids, back), what ``encoder`` gives and what ``decoder`` makes of
    that. One worker a task does both with one vocabulary, where the two would take a worker each."""
    ranks = _shared(spark, path)

    @F.arrow_udf("struct<ids:binary,back:binary>")
    def code(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks.value, pattern)
        for a in texts:
            for some in _few(a):
                ids = [codec.encode(t) for t in some]
                yield pa.StructArray.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())],
                    ["ids", "back"])
    return code


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
