"""What several operators of this subpackage share: tables, word splitting, written
intermediates and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rotamera.session import cut_lineage, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder. Unlike a checkpoint it is
    compressed and read by column; like one, a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has (Spark's
    names do not tell cases apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(key: Column | str, n: int) -> Column:
    """crc32 of a key's text, modulo ``n``. A null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case. ``bytes`` splits and
    lowers by exactly these ASCII rules."""
    return text.encode().lower().split() if text else []


def texts_of(column, rows: int = 256):
    """The strings of an Arrow column, made a few rows at a time: a batch holds 10,000 texts."""
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for every node that has an
    edge, the root being the smallest node. Null ends and loops are ignored.

    Large-star and small-star steps in turns: every node points at its smallest neighbour and
    hands that neighbour to the others, until the edges are stars. The number of rounds is
    logarithmic; each is joins and mergeable minima over the edges, and a hub's edges can be
    split over tasks since only its minimum is joined to them."""
    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = cut_lineage(e.distinct())
        s = e.agg(F.count(F.lit(1)).alias("n"),
                  F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return e, (s["n"], s["x"])

    e, mark = settled(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while mark[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (both.where("b > a").join(low, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        met = large.join(low, F.col("a") == F.col("u"))
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before = mark
        e, mark = settled(small)
        if mark == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select("b", "b").distinct())


def star(n: int, near) -> list[tuple[int, int]]:
    """Edges of stars that span the components of items 0..n-1. ``near(i, rest)`` tells which
    of the items ``rest`` are linked to i. What is reached leaves the rest, so a dense group
    costs a few comparisons per item, not one per pair."""
    import numpy as np
    out, rest = [], np.arange(n)
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            found, rest = rest[hit].tolist(), rest[~hit]
            out += [(root, f) for f in found]
            queue += found
    return out


def runs(batches, keys):
    """Arrow batches sorted by ``keys`` -> one table per run of equal keys. A run may cross
    batches; only its own rows are held."""
    import numpy as np
    import pyarrow as pa
    held, at = [], None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [t.column(k).combine_chunks() for k in keys]
        cols = [c.to_numpy(zero_copy_only=False) for c in cols]
        cut = np.zeros(b.num_rows, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != at:
                yield pa.concat_tables(held)
                held = []
            at = key
            held.append(t.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)
