"""Subword lattice likelihood: the probability of a text summed over all segmentations.

The pieces are those of an existing vocabulary. A word, with the space before it, is a lattice
of all ways to spell it in pieces, and, if training texts hold it, of one arc more for the word
as a whole; a forward recursion in log space adds all paths up. Pieces do not cross words, so a
text's probability is the product of its words' and the final end's, and each distinct word of
the corpus is worked out once.

The whole-word arc has the word's corpus count less ``DISCOUNT``; what the discounts free is the
weight of the spelled paths, so the probabilities of all strings sum to one. Piece scores start
from the vocabulary's order (Zipf's law over ranks) and are then set to the pieces' expected
counts over all segmentations of the distinct training words (forward-backward), plus one.

One pass over the texts cuts them into chunks. A chunk has a dictionary of its words, which are
the rows that meet corpus counts in a join, and its texts as bags of dictionary positions. So
the join has one row per word and chunk, not per token, no table of the corpus is ever held in
one place, and texts are read once.

Defined results: a null or empty text has one token, the end. A null id is the empty text when
rows are parted into training and held-out. With no training row every count is zero and
scores come from the vocabulary's order alone; ``base_score`` is null then, since N + V = 0.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rotamera.llm.bpe import load_ranks
from rotamera.llm.common import words, written

CHUNK_BYTES = 16 << 20
DISCOUNT = 0.75
SPACES = b" \t\n\r\x0b\x0c"
LEAST = 1e-250           # of a word's probability that is worked out without logs
END = b"\n"              # no word holds white space, so this stands for the end


def vocabulary(path: str) -> dict[bytes, float]:
    """Usable pieces (white space only as a leading blank) with natural-log scores by rank."""
    ranks = load_ranks(path)
    pieces = {p: r for p, r in ranks.items() if not any(c in SPACES for c in p[1:])
              and (p[:1] == b" " or p[:1] not in b"\t\n\r\x0b\x0c")}
    weight = {p: 1.0 / (r + 3) for p, r in pieces.items()}
    weight[END] = 1.0 / 3
    total = sum(weight.values())
    return {p: math.log(w / total) for p, w in weight.items()}


def trie(scores: dict[bytes, float]) -> dict[bytes, float | None]:
    """Every prefix of a piece; the value is the piece's score or None for a mere prefix."""
    out: dict[bytes, float | None] = {}
    for p in scores:
        for i in range(1, len(p)):
            out.setdefault(p[:i], None)
    out.update(scores)
    return out


_MISS = object()


def arcs(word: bytes, prefixes: dict) -> list[list[tuple[int, float, bytes]]]:
    """For each position the pieces (end, score, piece) that start there."""
    n, get, miss = len(word), prefixes.get, _MISS
    out = []
    for i in range(n):
        here = []
        for j in range(i + 1, n + 1):
            p = word[i:j]
            s = get(p, miss)
            if s is miss:
                break
            if s is not None:
                here.append((j, s, p))
        out.append(here)
    return out


def _logsum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    m = max(terms)
    return m + math.log(sum([math.exp(t - m) for t in terms]))


def forward(lattice) -> list[float]:
    """Log probability of reaching each position, over all segmentations up to it."""
    n = len(lattice)
    into: list[list[float]] = [[] for _ in range(n + 1)]
    into[0].append(0.0)
    alpha = []
    for i, terms in enumerate(into):
        if not terms:
            alpha.append(-math.inf)
            continue
        a = _logsum(terms)
        alpha.append(a)
        if i < n:
            for j, s, _ in lattice[i]:
                into[j].append(a + s)
        into[i] = ()
    return alpha


def plain(prefixes: dict[bytes, float | None]) -> dict[bytes, float]:
    """The trie with probabilities instead of logs, 0 for mere prefixes."""
    return {p: 0.0 if s is None else math.exp(s) for p, s in prefixes.items()}


def plain_forward(text: bytes, weights: dict[bytes, float]) -> tuple[list[float], list[list]]:
    """Probability of reaching each position, and the arcs from each. Without logs a word costs a
    fraction; a total below ``LEAST`` may have lost paths to underflow and is for :func:`forward`."""
    n, get = len(text), weights.get
    alpha, lattice = [1.0] + [0.0] * n, []
    for i in range(n):
        here, a = [], alpha[i]
        if a:
            for j in range(i + 1, n + 1):
                p = text[i:j]
                w = get(p)
                if w is None:
                    break
                if w:
                    alpha[j] += a * w
                    here.append((j, w, p))
        lattice.append(here)
    return alpha, lattice


def log_probability(word: bytes, prefixes: dict, whole: float = -math.inf,
                    spelled: float = 0.0, weights: dict | None = None) -> float:
    """Natural log of a word's probability: paths over pieces, which weigh ``spelled``, and
    the arc over the word as a whole, which weighs ``whole``. ``weights`` is the trie without logs."""
    if word == END:
        own = prefixes[END]
    else:
        total = plain_forward(b" " + word, weights)[0][-1] if weights else 0.0
        own = math.log(total) if total >= LEAST else forward(arcs(b" " + word, prefixes))[-1]
    return _logsum([own + spelled, whole]) if whole > -math.inf else own + spelled


def expected(word: bytes, prefixes: dict, into: dict[bytes, float], weights: dict | None = None) -> None:
    """Add the expected uses of each piece in spelling a word once. ``weights`` is the trie without logs."""
    if weights:
        alpha, lattice = plain_forward(b" " + word, weights)
        if alpha[-1] >= LEAST:
            beta = [0.0] * len(lattice) + [1.0 / alpha[-1]]
            for i in range(len(lattice) - 1, -1, -1):
                a, b = alpha[i], 0.0
                for j, w, p in lattice[i]:
                    x = w * beta[j]
                    b += x
                    into[p] += a * x
                beta[i] = b
            return
    lattice = arcs(b" " + word, prefixes)
    alpha = forward(lattice)
    z, n, exp = alpha[-1], len(lattice), math.exp
    beta = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        here, a = lattice[i], alpha[i]
        if a == -math.inf or not here:
            beta[i] = -math.inf
            continue
        # what a path through each arc weighs in all; together they weigh alpha + beta
        share = [exp(a + s + beta[j] - z) for j, s, _ in here]
        for (_, _, p), x in zip(here, share):
            into[p] += x
        total = sum(share)
        beta[i] = math.log(total) + z - a if total else -math.inf


def _pack(at: np.ndarray, compress) -> bytes:
    """A bag of positions: sorted, differences, byte planes, compressed."""
    at.sort()
    d = np.diff(at, prepend=at.dtype.type(0)).astype("<u4", copy=False)
    return compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T))


def _unpack(data: bytes, decompress) -> np.ndarray:
    planes = np.frombuffer(decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


CHUNKS = "chunk long, word binary, at long, n_train long, id {id}, held boolean, bag binary"


def chunked(docs: DataFrame, key: str, text: str, held: Column, chunk_bytes: int) -> DataFrame:
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                       F.coalesce(held, F.lit(False)).alias("held"))
    id_type = dict(rows.dtypes)["id"]
    arrow_id = pa.string() if id_type == "string" else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import secrets

        import zstandard
        compress = zstandard.ZstdCompressor(level=1).compress
        schema = None
        seen: dict[bytes, int] = defaultdict(count().__next__)
        train: list[np.ndarray] = []
        ids, helds, bags, size = [], [], [], 0

        def flush():
            nonlocal seen, train, ids, helds, bags, size
            chunk = secrets.randbits(62)
            counts = np.bincount(np.concatenate(train) if train else np.zeros(0, np.int32),
                                 minlength=len(seen))
            names, n = list(seen), len(seen)
            for lo in range(0, n, 50_000):
                hi = min(n, lo + 50_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(hi - lo, chunk)), pa.array(names[lo:hi], pa.binary()),
                    pa.array(np.arange(lo, hi)), pa.array(counts[lo:hi]),
                    pa.nulls(hi - lo, schema), pa.nulls(hi - lo, pa.bool_()),
                    pa.nulls(hi - lo, pa.binary())], NAMES)
            m = len(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, chunk)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()), pa.array(ids, schema), pa.array(helds, pa.bool_()),
                pa.array(bags, pa.binary())], NAMES)
            seen = defaultdict(count().__next__)
            train, ids, helds, bags, size = [], [], [], [], 0

        NAMES = ["chunk", "word", "at", "n_train", "id", "held", "bag"]
        for b in batches:
            schema = arrow_id or b.column("id").type
            for i, t, h in zip(b.column("id").to_pylist(), b.column("text").to_pylist(),
                               b.column("held").to_pylist()):
                w = words(t)
                w.append(END)
                at = np.fromiter(map(seen.__getitem__, w), np.int32, len(w))
                if not h:
                    train.append(at.copy())
                ids.append(i)
                helds.append(h)
                bags.append(_pack(at, compress))
                size += len(t or "") + 64
                if size >= chunk_bytes:
                    yield from flush()
        if ids:
            yield from flush()
    return written(rows.mapInArrow(work, CHUNKS.format(id=id_type)), "lattice-chunks")


def reweight(spark: SparkSession, counts: DataFrame,
             scores: dict[bytes, float]) -> dict[bytes, float]:
    """One round of expectation and maximisation over all distinct training words of
    (word, c). What comes back to the driver has one row per vocabulary piece at most."""
    shared = spark.sparkContext.broadcast(scores)

    def expect(batches):
        prefixes, into = trie(shared.value), defaultdict(float)
        weights = plain(prefixes)
        for b in batches:
            for w in b.column("word").to_pylist():
                expected(w, prefixes, into, weights)
        if into:
            yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.binary()),
                                              pa.array(list(into.values()), pa.float64())],
                                             ["piece", "e"])
    got = (counts.where((F.col("c") > 0) & (F.col("word") != F.lit(bytearray(END))))
           .select("word").mapInArrow(expect, "piece binary, e double")
           .groupBy("piece").agg(F.sum("e").alias("e")).toArrow())
    e = dict(zip(got.column("piece").to_pylist(), got.column("e").to_pylist()))
    e[END] = 1.0
    total = sum(e.values()) + len(scores)
    return {p: math.log((e.get(p, 0.0) + 1.0) / total) for p in scores}


def score(docs: DataFrame, held: Column, vocab_path: str, key: str = "doc_id",
          text: str = "text", rounds: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens,
    base_score (add-one unigrams over words) and score (the lattice), both log10. Rows where
    ``held`` is true teach nothing."""
    spark = docs.sparkSession
    chunks = chunked(docs, key, text, held, chunk_bytes)
    entries = chunks.where(F.col("word").isNotNull()).select("chunk", "word", "at", "n_train")
    counts = written(entries.groupBy("word").agg(F.sum("n_train").alias("c")), "lattice-counts")
    totals = counts.agg(F.sum("c").alias("n"),
                        F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = (int(totals[x] or 0) for x in ("n", "v"))
    scores = vocabulary(vocab_path)
    for _ in range(rounds if n else 0):
        scores = reweight(spark, counts, scores)
    shared = spark.sparkContext.broadcast(scores)

    def judge(batches):
        prefixes = trie(shared.value)
        weights = plain(prefixes)
        spelled = math.log(DISCOUNT * v / n) if n else 0.0
        for b in batches:
            lp = [log_probability(w, prefixes, math.log((c - DISCOUNT) / n) if c else -math.inf,
                                  spelled, weights)
                  for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"),
                                              pa.array(lp, pa.float64())], ["word", "c", "lp"])
    judged = counts.select("word", "c").mapInArrow(judge, "word binary, c long, lp double")
    told = entries.join(judged, "word").select(
        "chunk", F.lit(0).alias("kind"), "at", "c", "lp",
        F.lit(None).cast(dict(chunks.dtypes)["id"]).alias("id"),
        F.lit(None).cast("boolean").alias("held"), F.lit(None).cast("binary").alias("bag"))
    bags = chunks.where(F.col("bag").isNotNull()).select(
        "chunk", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("lp"), "id", "held", "bag")
    scale = math.log10(n + v + 1) if n else None
    id_type = dict(chunks.dtypes)["id"]

    def add(batches):
        import zstandard
        decompress = zstandard.ZstdDecompressor().decompress
        chunk, known, base, own, fill = None, None, None, None, []
        for b in batches:
            kinds = b.column("kind").to_numpy()
            names = b.column("chunk").to_numpy()
            rows = ([], [], [], [], [], [])
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1]))
                         + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if kinds[lo] == 0:
                    if names[lo] != chunk:
                        chunk, fill = names[lo], []
                    part = b.slice(lo, hi - lo)
                    fill.append([part.column(x).to_numpy() for x in ("c", "lp")])
                    known = None
                    continue
                if known is None:          # rows are sorted by position, so these are in order
                    c, lp = (np.concatenate([f[i] for f in fill]) for i in (0, 1))
                    known, base, own, fill = c > 0, np.log10(c + 1.0), lp / math.log(10), []
                part = b.slice(lo, hi - lo)
                for i, h, bag in zip(part.column("id").to_pylist(),
                                     part.column("held").to_pylist(),
                                     part.column("bag").to_pylist()):
                    at = _unpack(bag, decompress)
                    for x, y in zip(rows, (i, h, len(at), int(known[at].sum()),
                                           None if scale is None else
                                           float(base[at].sum() - len(at) * scale),
                                           float(own[at].sum()))):
                        x.append(y)
            if rows[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], b.column("id").type), pa.array(rows[1], pa.bool_()),
                     pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()),
                     pa.array(rows[4], pa.float64()), pa.array(rows[5], pa.float64())],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (told.unionByName(bags).repartition(parts, "chunk")
            .sortWithinPartitions("chunk", "kind", "at")
            .mapInArrow(add, f"id {id_type}, held_out boolean, n_tokens long, n_known long, "
                             "base_score double, score double")
            .select(F.col("id").alias(key), "held_out", "n_tokens", "n_known",
                    F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
