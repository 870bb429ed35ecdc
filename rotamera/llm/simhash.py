"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits form 32 segments of two; its embedding is the number of set bits in
each segment. Manhattan distance of embeddings never exceeds the Hamming distance of the
fingerprints, so fingerprints that differ in at most 3 bits lie within Manhattan distance 3,
and in the lower or the upper half of the segments within 1. The grid has unit cells over each
half: a fingerprint stands in the cell of its counts and also looks into the cells one count
above, so every such pair meets. Inside a cell the full Manhattan distance filters and the
exact Hamming distance decides.

Only distinct fingerprints are compared: rows that share one are a class at once, however
many they are. A cell gives star edges spanning what is linked in it, never all its pairs, and
a cell of more than ``CELL`` rows is cut into tiles that meet pairwise in different tasks.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Fewer
words than a shingle form one shingle. Repeated shingles count as often as they occur. A row
whose id is null takes part; a component of null ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from rotamera.llm.common import components, private, runs, star, texts_of, words
from rotamera.operators.grouping import lookup
from rotamera.session import cut_lineage

SHINGLE = 3
BITS = 3                  # differing bits that still link
CELL = 4096               # rows of a cell that one task compares


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, bit 0 first."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[lo:lo + (1 << 14)].astype("<u8").view(np.uint8),
                             bitorder="little").reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return total


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash
    w = words(text)
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = map(join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else (join(w),)
    h = np.fromiter((digest(g, 42) for g in grams), np.uint64, n)
    on = bit_counts(h) * 2 > n
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """64-bit SimHash of word shingles, as a signed long."""
    for a in texts:
        v = np.array([fingerprint_of(t) for t in texts_of(a)], np.uint64)
        yield pa.array(v.view(np.int64))


def cells(prints: DataFrame) -> DataFrame:
    """(half, cell, fp): the own cell of ``fp`` in each half of the segments, and the cells
    one count above in one segment. Halves are taken before adding, so no sum overflows."""
    half = "cast(shiftrightunsigned(fp, {s}) & 4294967295L as long)"
    out = None
    for n, s in enumerate((0, 32)):
        bits = half.format(s=s)
        own = prints.select("fp", F.expr(
            f"({bits} & 1431655765L) + (shiftrightunsigned({bits}, 1) & 1431655765L)")
            .alias("own"))
        steps = F.expr("concat(array(own), transform(filter(sequence(0, 30, 2), "
                       "s -> (shiftright(own, s) & 3L) < 2L), s -> own + shiftleft(1L, s)))")
        part = own.select(F.lit(n).alias("half"), F.explode(steps).alias("cell"), "fp")
        out = part if out is None else out.unionByName(part)
    return out


def _segments(fp: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1)
    return (bits[:, 0::2] + bits[:, 1::2]).astype(np.int8)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for t in runs(batches, ["half", "cell", "lo", "hi"]):
        if t.num_rows < 2:
            continue
        fp = np.unique(t.column("fp").to_numpy())
        seg = _segments(fp)

        def near(i, rest):
            hit = np.abs(seg[rest] - seg[i]).sum(1, dtype=np.int16) <= BITS
            at = np.flatnonzero(hit)
            hit[at] = np.bitwise_count((fp[rest[at]] ^ fp[i]).view(np.uint64)) <= BITS
            return hit
        out += [(int(fp[a]), int(fp[b])) for a, b in star(len(fp), near)]
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def tiled(rows: DataFrame, keys: list[str], salt, limit: int) -> DataFrame:
    """Add (lo, hi, slot): a group of up to ``limit`` rows is the tile (0, 0); a larger one is
    dealt into slots, and each two slots meet in a tile of their own."""
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                        .where(F.col("_n") > limit))
    one = rows.select("*", *[F.lit(0).alias(c) for c in ("lo", "hi", "slot")])
    if not sizes.count():
        return one
    big = (lookup(rows, sizes, keys, "left", ready=True)
           .withColumn("_t", F.coalesce(F.ceil(F.col("_n") / limit).cast("int"), F.lit(1)))
           .withColumn("slot", F.pmod(salt, F.col("_t")).cast("int"))
           .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))))
    return big.select(*rows.columns, F.least("slot", "_o").alias("lo"),
                      F.greatest("slot", "_o").alias("hi"), "slot")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that span all links between the distinct values of column ``fp``."""
    rows = tiled(cells(prints), ["half", "cell"], F.xxhash64("fp"), CELL)
    at = ["half", "cell", "lo", "hi"]
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, *at).sortWithinPartitions(*at)
            .select(*at, "fp").mapInArrow(_links, "a long, b long"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, fp, component_id, class_fp), one row per row of ``docs``: the smallest
    key reachable by links, and the fingerprint that stands for the component."""
    rows = cut_lineage(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("text_hash"),
                                   fingerprint(F.col(text)).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("_key").alias("first"))
    roots = components(links(prints.select("fp")))
    prints = cut_lineage(prints.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lows = prints.groupBy("root").agg(F.min("first").alias("low"))
    table = prints.join(lows, "root").select("fp", "root", "low")
    return (rows.join(table, "fp")
            .select(F.col("_key").alias(key), "text_hash", "fp",
                    F.col("low").alias("component_id"), F.col("root").alias("class_fp")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id), one row per row of ``docs``."""
    return classes(docs, key, text).select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one of each component: that with the smallest key, of
    equal keys the smallest text hash, of rows repeated as a whole any."""
    own, k, h = private(docs, "_text_hash", "_keep_key", "_keep_hash")
    best = (classes(docs, key, text).groupBy("class_fp")
            .agg(F.min(F.struct(F.col(key).alias("k"), F.col("text_hash").alias("h"))).alias("b"))
            .select(F.col("b.k").alias(k), F.col("b.h").alias(h)))
    return (docs.withColumn(own, F.xxhash64(text))
            .join(best, F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(h)), "left_semi")
            .dropDuplicates([key, own]).drop(own))
