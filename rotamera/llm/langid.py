"""Language identification: averaged hashed subword embeddings and a linear softmax, trained
by stochastic gradient descent, with calibrated confidence and rejection.

A text's vector is the mean of the embeddings of the hashed n-grams of all its words. Since
the classifier above it is linear, embedding and classifier fold into one table of class
scores per bucket once training is over, so a prediction is one sum over a text's buckets.

A softmax is sure of letters it has never met, so a text is rejected by two scores: its
confidence, and its mean log share of n-grams in the training texts of the language it is given.
Both cuts are quantiles over right validation rows, which together lose 1 - ``KEEP`` of them.

Defined results: a null text or one without a letter gets ``und``, score 0, rejected. Ties go
to the language first in order. Equal texts get equal results. With no labelled row there is
no language to predict and every row is ``und``. Only the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rotamera.llm.common import texts_of

BUCKETS = 1 << 15
DIMS = 16
GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 800       # rows a language gives to training, at most about
LANGUAGES = 400          # languages learned, the most frequent ones
STRETCH = 1 << 18        # code points hashed at once
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - 15)
KEEP = 0.999             # share of right validation rows that rejection must keep
UND = "und"


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    import unicodedata
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def bag(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their counts. Words are runs of letters in lower
    case with their ends marked; all n-grams of a stretch are hashed at once."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    codes = np.where(letters[codes], codes, np.uint32(0))
    edge = np.ones(len(codes), bool)
    edge[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = np.concatenate([np.zeros(1, np.uint64), codes[edge], np.zeros(1, np.uint64)])
    counts = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(codes), STRETCH):
        # a stretch has the n-grams that start in it
        part = codes[lo:lo + STRETCH + max(GRAMS) - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, min(max(GRAMS), len(part)) + 1):
            m = min(STRETCH, len(part) - n + 1)
            h = h[:m] * FACTOR + part[n - 1:n - 1 + m] + np.uint64(n)
            if n == 1:
                inside = part[:m] != 0
            elif n == 2:
                inside = inside[:m] | (part[1:1 + m] != 0)
            else:                             # ends of words stand at an n-gram's ends only
                inside = inside[:m] & (part[n - 2:n - 2 + m] != 0)
            if n in GRAMS:
                mixed = h ^ (h >> np.uint64(29))
                counts += np.bincount(((mixed[inside] * FACTOR) >> SHIFT).astype(np.int64),
                                      minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def sample_rows(docs: DataFrame, text: str, label: str, key: str,
                per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """About ``per_language`` labelled rows of each of the most frequent languages, chosen by
    a hash of key and text: the same rows however the input is laid out."""
    usable = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = (usable.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.desc("_n"), "_l").limit(languages).collect())
    if not sizes:
        return usable.select(F.col(text).alias("text"), F.col(label).alias("label"),
                             F.lit(0).cast("long").alias("h")).limit(0)
    part = F.create_map(*[F.lit(x) for s in sizes
                          for x in (s["_l"], min(1.0, per_language / s["_n"]))])
    h = F.xxhash64(F.col(key).cast("string"), text)
    return (usable.select(F.col(text).alias("text"), F.col(label).alias("label"), h.alias("h"))
            .where(F.pmod("h", F.lit(1_000_003)) < part[F.col("label")] * 1_000_003))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray        # BUCKETS x labels: embedding and classifier folded
    bias: np.ndarray
    temperature: float
    threshold: float         # calibrated confidence below which a text is rejected
    shares: np.ndarray       # BUCKETS x labels: log share of a bucket in a language's n-grams
    usual: float             # calibrated mean log share below which a text is rejected


def train(bags: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 4.0,
          batch: int = 32, seed: int = 7) -> Model:
    """``bags``: (label, buckets, counts) in a fixed order. A fifth calibrates."""
    labels = sorted({b[0] for b in bags})
    if not labels:
        none = np.zeros((BUCKETS, 0), np.float32)
        return Model([], none, np.zeros(0), 1.0, 0.0, none, 0.0)
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIMS)) / DIMS).astype(np.float32)
    out = np.zeros((DIMS, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    fit = [b for i, b in enumerate(bags) if i % 5 and len(b[1])]
    held = [b for i, b in enumerate(bags) if i % 5 == 0 and len(b[1])] or fit

    def vectors(group):
        idx = np.concatenate([b[1] for b in group])
        w = np.concatenate([b[2] / b[2].sum() for b in group]).astype(np.float32)
        starts = np.cumsum([0] + [len(b[1]) for b in group[:-1]])
        return idx, w, starts, np.add.reduceat(emb[idx] * w[:, None], starts)

    steps, done = max(1, epochs * ((len(fit) + batch - 1) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for lo in range(0, len(order), batch):
            group = [fit[i] for i in order[lo:lo + batch]]
            idx, w, starts, x = vectors(group)
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(group)), [number[b[0]] for b in group]] -= 1
            p /= len(group)
            step = rate * (1 - done / steps)
            back = p @ out.T
            out -= step * (x.T @ p)
            bias -= step * p.sum(0)
            lens = np.diff(np.append(starts, len(idx)))
            # embeddings see a sparse share of each text, so they take larger steps
            np.add.at(emb, idx, -50 * step * w[:, None] * np.repeat(back, lens, 0))
            done += 1
    z = np.concatenate([vectors(held[i:i + 256])[3] @ out + bias
                        for i in range(0, len(held), 256)])
    want = np.array([number[b[0]] for b in held])

    def sure(t):
        p = np.exp((z - z.max(1, keepdims=True)) * t)
        return p / p.sum(1, keepdims=True)
    scales = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(sure(t)[np.arange(len(want)), want], 1e-12)).mean()
            for t in scales]
    right = z.argmax(1) == want
    # a clean sweep of the validation rows is no proof of certainty: the mean confidence stays
    # below the share of right ones with one error more
    fits = [sure(t).max(1).mean() <= (right.sum() + 1) / (len(want) + 2) for t in scales]
    t = float(scales[int(np.argmin(np.where(fits, loss, np.inf)))])
    p = sure(t)
    # n-grams of the rows that are fitted only, so that validation rows are as new as any other
    seen = np.full((BUCKETS, len(labels)), 0.5, np.float32)
    for b in fit:
        seen[b[1], number[b[0]]] += b[2]
    shares = np.log(seen / seen.sum(0, dtype=np.float64)).astype(np.float32)
    best = z.argmax(1)
    known = np.array([b[2] @ shares[b[1], k] / b[2].sum() for b, k in zip(held, best)])

    def cut(x):              # rounding must not reject the rows that the cut is taken from
        return float(np.quantile(x[right], (1 - KEEP) / 2)) - 1e-6 if right.any() else -np.inf
    return Model(labels, (emb @ out).astype(np.float32), bias, t, cut(p.max(1)), shares, cut(known))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Train on a bounded sample: ``per_language`` rows of at most ``languages`` languages.
    Texts become bags of buckets in tasks; only bags reach the driver."""
    rows = sample_rows(docs, text, label, key, per_language, languages)

    shared = docs.sparkSession.sparkContext.broadcast(letter_table())

    def bags(batches):
        for b in batches:
            got = [bag(t, shared.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("label"), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                 pa.array([g[1] for g in got], pa.list_(pa.int32()))], ["h", "label", "at", "n"])
    got = rows.mapInArrow(bags, "h long, label string, at array<int>, n array<int>").toArrow()
    cols = [got.column(c).combine_chunks() for c in ("h", "label", "at", "n")]
    rows = [(cols[0][i].as_py(), cols[1][i].as_py(), cols[2][i].values.to_numpy(),
             cols[3][i].values.to_numpy()) for i in range(got.num_rows)]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    return train([r[1:] for r in rows])


SCHEMA = "lang_pred string, score double, rejected boolean"


def predictor(df: DataFrame, model: Model):
    """A Column function: text -> struct(lang_pred, score, rejected)."""
    shared = df.sparkSession.sparkContext.broadcast(
        (model.labels, model.table.astype(np.float64), model.bias, model.temperature,
         model.threshold, model.shares, model.usual, letter_table()))

    @F.arrow_udf(SCHEMA)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labels, table, bias, temperature, threshold, shares, usual, letters = shared.value

        def one(text):
            at, n = bag(text, letters)
            if not len(at) or not labels:
                return UND, 0.0, True
            z = (n @ table[at] / n.sum() + bias) * temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            known = n @ shares[at, best] / n.sum()
            return labels[best], float(p[best]), bool(p[best] < threshold or known < usual)
        for a in texts:
            rows = [one(t) for t in texts_of(a)]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.float64()),
                 pa.array([r[2] for r in rows], pa.bool_())], ["lang_pred", "score", "rejected"])
    return predict


def predict(docs: DataFrame, model: Model, text: Column | str = "text") -> Column:
    return predictor(docs, model)(text)
