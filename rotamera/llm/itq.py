"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected on their principal axes and rotated so that their signs are
balanced binary codes (alternating signs and orthogonal Procrustes). Codes of up to 64 bits are
cut into substrings of 8. Two codes are candidates if in some substring they differ in one bit at
most and over all bits in no more than ``NEAR`` of them; original vectors decide, in
double precision.

A code stands in a cell for each substring, and looks into the cells with one more bit set, so
two codes that differ in one bit meet once. Of several tables in which a pair meets, the first
one counts it. A cell of more than ``CELL`` rows is cut into tiles. Cells are passed twice: codes
alone tell which rows have a candidate, and only those are joined to their vectors. Pairs are
counted and spanned by star edges where they meet, never listed. Equal vectors of a label are one class
with a multiplicity.

Centring takes away what all vectors share, and with it what keeps the codes of near ones alike
where that is much of them. So the fitted codes are tried on the sample: on its true pairs, and on pairs moved to
the cosine itself. Where they meet less than ``RECALL`` of either in any label, vectors of that length
get signs on ``BITS`` random directions instead, not centred: two vectors then differ in
a bit with a chance of their angle over pi, 12 % at cosine 0.93, whatever the data. That is whole, and slower
where most vectors are about as near as that.

The model is fitted on at most about ``FIT_ROWS`` classes, chosen by a hash; all rows are
indexed. Defined results: rows whose label is null, or whose vector is null, empty, zero or holds null
or non-finite components, link with nothing. Vectors of different lengths are not compared.
A null key takes part; its component is the smallest known key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotamera.llm.common import components, runs, star, written
from rotamera.llm.simhash import tiled
from rotamera.session import cut_lineage

COSINE = 0.93
BITS = 64
FIT_ROWS = 20_000
ROUNDS = 50
NEAR = 0.28               # of a code's bits may differ in a candidate pair
CELL = 2048
RECALL = 0.95             # of sampled pairs must be candidates, or codes are not centred
TRY_ROWS = 4000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps squares finite."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_rotation(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for unit vectors: principal axes times the learned rotation."""
    mean = vectors.mean(0)
    x = vectors - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :min(bits, x.shape[1])]
    v = x @ axes
    k = v.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def codes_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    on = (vectors - mean) @ projection >= 0
    out = np.zeros((len(vectors), 64), bool)
    out[:, :on.shape[1]] = on
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def _matrix(a: pa.Array) -> np.ndarray:
    """An array of lists of one length, as doubles."""
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1)


def random_directions(dims: int, bits: int = BITS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(zero mean, projection) on directions that do not depend on the data."""
    return np.zeros(dims), np.random.default_rng(seed).standard_normal((dims, bits))


def met(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs of codes are candidates."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    ok = np.zeros(x.shape, bool)
    for e in range(-(-bits // 8)):
        ok |= np.bitwise_count((x >> np.uint64(8 * e)) & np.uint64(255)) <= 1
    return ok & (np.bitwise_count(x) <= max(1, round(NEAR * bits)))


def recalls(v: np.ndarray, labels: np.ndarray, model: tuple, bits: int, cosine: float,
            seed: int = 5) -> float:
    """The lowest recall of candidates over labels, of true pairs and of pairs at the cosine. Unit
    vectors ``v``. Labels with few pairs are taken together."""
    rng = np.random.default_rng(seed)
    if len(v) > TRY_ROWS:
        at = rng.permutation(len(v))[:TRY_ROWS]
        v, labels = v[at], labels[at]
    code = codes_of(v, *model[:2])
    angle = np.arccos(min(1.0, max(-1.0, cosine)))
    tried = []                                # (met, pairs) by label, for either kind
    for k in np.unique(labels):
        at = np.flatnonzero(labels == k)
        u, c, found, true = v[at], code[at], 0, 0
        for lo in range(0, len(at) - 1, 256):
            i, j = np.nonzero(u[lo:lo + 256] @ u.T >= cosine)
            i += lo
            i, j = i[j > i], j[j > i]
            true += len(i)
            found += int(met(c[i], c[j], bits).sum())
        tried.append((0, found, true))
        # a partner turned towards the row until their cosine is the least that links
        other = u[rng.permutation(len(at))]
        side = other - u * np.einsum("ij,ij->i", u, other)[:, None]
        size = np.linalg.norm(side, axis=1)
        ok = size > np.sin(angle)             # others are nearer than that or opposite
        if ok.any():
            moved = np.cos(angle) * u[ok] + np.sin(angle) * side[ok] / size[ok][:, None]
            hit = met(c[ok], codes_of(moved, *model[:2]), bits)
            tried.append((1, int(hit.sum()), len(hit)))
    low = 1.0
    for kind in (0, 1):
        here = [(f, n) for k, f, n in tried if k == kind and n]
        few = [x for x in here if x[1] < 30]
        here = [x for x in here if x[1] >= 30]
        if few:
            here.append((sum(f for f, _ in few), sum(n for _, n in few)))
        low = min([low, *(f / n for f, n in here)])
    return low


def candidate_pairs(code, own, slot, t, lo, hi, bits):
    """Index pairs i < j of a tile's rows that count here: (i, j) arrays, in blocks."""
    near = max(1, round(NEAR * bits))
    n = len(code)
    c = code.view(np.uint64)
    for a in range(0, n, 256):
        x = c[a:a + 256, None] ^ c[None, a:]
        ok = np.bitwise_count(x) <= near
        ok &= own[a:a + 256, None] | own[None, a:]
        i, j = np.nonzero(ok)
        keep = j > i
        i, j = i[keep], j[keep]
        x = x[i, j]
        i, j = i + a, j + a
        good = np.ones(len(i), bool)
        for e in range(t):                    # an earlier table has counted it
            good &= np.bitwise_count((x >> np.uint64(8 * e)) & np.uint64(255)) > 1
        if lo != hi:
            good &= slot[i] != slot[j]
        elif len(i):
            good &= slot[i] == slot[j]
        # a probe meets others' own cells only one bit away; equal own cells meet at none
        yield i[good], j[good]


AT = ["label", "dims", "t", "cell", "lo", "hi"]


def hitter(bits_of: dict[int, int]):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in runs(batches, AT):
            if r.num_rows < 2:
                continue
            own = r.column("own").to_numpy()
            if not own.any():
                continue
            code = np.ascontiguousarray(r.column("code").to_numpy())
            slot = r.column("slot").to_numpy()
            t, lo, hi, dims = (r.column(c)[0].as_py() for c in ("t", "lo", "hi", "dims"))
            hit = np.zeros(len(code), bool)
            for i, j in candidate_pairs(code, own, slot, t, lo, hi, bits_of.get(dims, min(BITS, dims))):
                hit[i] = hit[j] = True
            if hit.any():
                out.append(r.filter(pa.array(hit)))
            if sum(x.num_rows for x in out) > 20_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out = []
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
    return hits


def reranker(cosine: float, bits_of: dict[int, int]):
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, AT):
            code = np.ascontiguousarray(r.column("code").to_numpy())
            own, slot = r.column("own").to_numpy(), r.column("slot").to_numpy()
            cls, many = r.column("cls").to_numpy(), r.column("many").to_numpy()
            t, lo, hi, dims = (r.column(c)[0].as_py() for c in ("t", "lo", "hi", "dims"))
            v = unit(_matrix(r.column("vector").combine_chunks()))
            count = np.zeros(len(code), np.int64)
            ends = ([], [])
            for i, j in candidate_pairs(code, own, slot, t, lo, hi,
                                        bits_of.get(dims, min(BITS, dims))):
                for k in range(0, len(i), 1 << 15):
                    a, b = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
                    ok = np.einsum("ij,ij->i", v[a], v[b]) >= cosine
                    a, b = a[ok], b[ok]
                    np.add.at(count, a, many[b])
                    np.add.at(count, b, many[a])
                    ends[0].append(a)
                    ends[1].append(b)
            a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)
            if not len(a):
                continue
            # span what is linked here by stars, from the sorted list of both directions
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            order = np.argsort(src, kind="stable")
            src, dst = src[order], dst[order]
            first = np.searchsorted(src, np.arange(len(code) + 1))

            def near(k, rest):
                linked = np.zeros(len(code), bool)
                linked[dst[first[k]:first[k + 1]]] = True
                return linked[rest]
            stars = np.array(star(len(code), near), np.int64).reshape(-1, 2)
            has = np.flatnonzero(count)
            m = len(has)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([cls[has], cls[stars[:, 0]]])),
                pa.array([None] * m + cls[stars[:, 1]].tolist(), pa.int64()),
                pa.array(np.concatenate([count[has], np.zeros(len(stars), np.int64)]))],
                ["a", "b", "n"])
    return rerank


def fit(classes: DataFrame, bits: int = BITS, rows: int = FIT_ROWS, cosine: float = COSINE
        ) -> dict[int, tuple]:
    """(mean, projection, bits) by vector length, from about ``rows`` classes over all lengths."""
    n = classes.count()
    part = min(1.0, rows / max(1, n))
    some = classes.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_003)) < part * 1_000_003)
    got = some.select("vector", F.col("label").cast("string").alias("label")).toArrow()
    by: dict[int, list] = {}
    for v, k in sorted(zip(got.column("vector").to_pylist(), got.column("label").to_pylist())):
        by.setdefault(len(v), []).append((v, k))
    out = {}
    for k, pairs in by.items():
        u = unit(np.array([v for v, _ in pairs], np.float64))
        model = (*fit_rotation(u, bits), min(bits, k))
        if recalls(u, np.array([x for _, x in pairs]), model, model[2], cosine) < RECALL:
            model = (*random_directions(k, bits), bits)
        out[k] = model
    return out


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``rows``."""
    spark = rows.sparkSession
    d = rows.select(F.col(key).alias("_key"), F.col(label).alias("label"),
                    F.col(vector).alias("vector"))
    fine = (F.col("label").isNotNull() & (F.coalesce(F.size("vector"), F.lit(0)) > 0)
            & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)
                       & (F.abs(x) < F.lit(float("inf"))))
            & F.exists("vector", lambda x: x != 0))
    classes = written(d.where(fine).groupBy("label", "vector").agg(
        F.count(F.lit(1)).alias("many"), F.min("_key").alias("first"))
        .withColumn("cls", F.monotonically_increasing_id()), "itq-classes")
    fitted = fit(classes, cosine=cosine)
    bits_of = {k: m[2] for k, m in fitted.items()}
    model = spark.sparkContext.broadcast(fitted)

    @F.arrow_udf("long")
    def encode(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in vectors:
            lens = np.diff(a.offsets.to_numpy())
            out = np.zeros(len(a), np.int64)
            for k in np.unique(lens).tolist():
                at = np.flatnonzero(lens == k)
                if k in model.value:          # a length that the sample lacks has one cell
                    out[at] = codes_of(unit(_matrix(a.take(pa.array(at)))), *model.value[k][:2])
            yield pa.array(out)
    coded = classes.select("cls", "label", F.size("vector").alias("dims"),
                           encode("vector").alias("code"))
    bits = F.least(F.col("dims"), F.lit(BITS))
    for k, n in bits_of.items():
        if n != min(BITS, k):
            bits = F.when(F.col("dims") == k, n).otherwise(bits)
    tables = F.ceil(bits / 8).cast("int")
    sub = coded.withColumn("t", F.explode(F.sequence(F.lit(0), tables - 1))).withColumn(
        "own_cell", F.expr("cast(shiftrightunsigned(code, 8 * t) & 255L as int)"))
    cells = sub.withColumn("cell", F.explode(F.expr(
        "concat(array(own_cell), transform(filter(sequence(0, 7), s -> (shiftright(own_cell, s)"
        " & 1) = 0), s -> own_cell | shiftleft(1, s)))")))
    cells = cells.select("label", "dims", "t", "cell", "cls", "code",
                         (F.col("cell") == F.col("own_cell")).alias("own"))
    cells = tiled(cells, ["label", "dims", "t", "cell"], F.xxhash64("cls"), CELL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(cells.dtypes)
    names = [*AT, "cls", "code", "own", "slot"]
    hits = (cells.select(*names).repartition(parts, *AT).sortWithinPartitions(*AT)
            .mapInArrow(hitter(bits_of), ", ".join(f"`{c}` {kinds[c]}" for c in names)))
    linked = (hits.join(classes.select("cls", "many", "vector"), "cls")
           .select(*names, "many", "vector").repartition(parts, *AT).sortWithinPartitions(*AT)
           .mapInArrow(reranker(cosine, bits_of), "a long, b long, n long"))
    linked = cut_lineage(linked)
    counts = linked.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = components(linked.where("b is not null").select("a", "b"))
    told = (classes.join(counts, "cls", "left")
            .join(roots, F.col("cls") == F.col("node"), "left")
            .select("label", "vector", "first", F.coalesce("root", "cls").alias("root"),
                    (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    told = written(told, "itq-links")
    low = told.groupBy("root").agg(F.min("first").alias("low"))
    told = told.join(low, "root").select("label", "vector", "n_links", "low")
    return (d.join(told, ["label", "vector"], "left")
            .select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.when(F.col("n_links").isNull(), F.col("_key")).otherwise(F.col("low"))
                    .alias("component_id"))
            .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))
