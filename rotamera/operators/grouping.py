"""Group statistics, ranks and splits that stay balanced when one group is huge.

A plain ``Window.partitionBy(ensemble)`` puts a whole ensemble into one task. These helpers
never do: statistics are aggregated map-side first and handed back to the rows, ranks come
from a range-partitioned sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F, Window as W

from rotamera.session import cut_lineage

BROADCAST_ROWS = 100_000      # a table of more rows is never broadcast
BROADCAST_BYTES = 64 << 20    # nor one of more bytes


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join treating NULL keys as equal, so no row is lost to a NULL ensemble."""
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_key{i}")
    cond = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    out = left.join(renamed, on, how)
    return out.drop(*[f"_key{i}" for i in range(len(keys))])


def sized(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` materialised, and aggregates of it taken by the same job."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: int,
           row_bytes: int = 100, size_col: str | None = None, total: int | None = None
           ) -> DataFrame:
    """Left-join a one-row-per-key ``table`` of ``rows`` rows, none wider than ``row_bytes``.

    It is broadcast if it fits. Beyond that, where ``size_col`` tells each group's share of
    the ``total`` rows, the groups too large for one task, of which there can only be as many
    as still fit, go by broadcast and the rest shuffle; without sizes all shuffle and AQE
    splits the skewed partitions."""
    room = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    if rows <= room:
        return _join_on(df, F.broadcast(table), keys, "left")
    if size_col is None or not total:
        return _join_on(df, table, keys, "left")
    share = total / max(1.0, room / 2)
    hot = table.where(F.col(size_col) > share)
    cold = table.where(F.col(size_col) <= share)
    hot_rows = _join_on(df, F.broadcast(hot), keys, "inner")
    rest = _join_on(df, F.broadcast(hot.select(*keys)), keys, "left_anti")
    return hot_rows.unionByName(_join_on(rest, cold, keys, "left"))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner",
           row_bytes: int = 100, ready: bool = False) -> DataFrame:
    """Join with a table that has few distinct keys, such as one curve per spectrum type, so
    that a shuffle by key would put most of ``df`` into a few tasks. The table is computed
    and counted first and broadcast if it fits. (``ready``: it is materialised already.)"""
    if ready:
        rows = table.count()
    else:
        table, size = sized(table, n=F.count(F.lit(1)))
        rows = size["n"]
    fits = rows <= min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    return df.join(F.broadcast(table) if fits else table, list(keys), how)


def attach_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add per-group aggregates as columns. The statistics are computed once (partial
    aggregation, one small shuffle) and kept in the checkpoint folder."""
    keys = list(keys)
    return attach_table(df, df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in stats.items()], F.count(F.lit(1)).alias("_group_rows")), keys)


def attach_table(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hand a one-row-per-group aggregate of ``df`` back to its rows. ``table`` has the number of
    the group's rows as ``_group_rows``; its size is counted by the job that makes it."""
    table, size = sized(table, n=F.count(F.lit(1)), t=F.sum("_group_rows"))
    width = 100 + 16 * len(table.columns)
    return attach(df, table, keys, size["n"], width, "_group_rows", size["t"]).drop("_group_rows")


def split_by_size(df: DataFrame, keys: Sequence[str], limit: int, measure: Column | None = None
                  ) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups with at most ``limit`` rows, rows of the larger ones or None). ``measure``
    is an aggregate to take instead of the number of rows."""
    keys = list(keys)
    large, size = sized(df.groupBy(*keys).agg((F.count(F.lit(1)) if measure is None else measure).alias("_size"))
                        .where(F.col("_size") > limit).select(*keys), n=F.count(F.lit(1)))
    n = size["n"]
    if n == 0:
        return df, None
    names = F.broadcast(large) if n <= BROADCAST_ROWS else large
    return _join_on(df, names, keys, "left_anti"), _join_on(df, names, keys, "left_semi")


def spread(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Hash-partition by ``keys`` into exactly the session's number of shuffle partitions.
    Work that is heavy per byte needs this: left alone, AQE would merge partitions until each
    is large in bytes and run them in a few tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def dealt_runs(df: DataFrame, keys: Sequence[str], limit: int, salt: Column) -> DataFrame:
    """Partitions in which the rows of a group stand together, for mergeable sums: a group
    of up to ``limit`` rows is in one partition, a larger one is dealt out over all by
    ``salt``."""
    small, large = split_by_size(df, keys, limit)
    out = spread(small, list(keys)).sortWithinPartitions(*keys)
    if large is None:
        return out
    return out.unionByName(spread(large, [*keys, salt]).sortWithinPartitions(*keys))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank"
           ) -> DataFrame:
    """1-based position of each row within its group. One global sort spreads a large group
    over many range partitions; the rank is the position inside the partition plus the
    group's rows in earlier ones. ``order`` must end in a column unique within the group."""
    keys = list(keys)
    seq = F.monotonically_increasing_id()
    done = cut_lineage(df.orderBy(*[F.col(k) for k in keys], *order)
                       .withColumn("_seq", seq)
                       .withColumn("_part", F.shiftright(F.col("_seq"), 33)))
    parts = done.groupBy(*keys, "_part").agg(F.min("_seq").alias("_first"),
                                             F.count(F.lit(1)).alias("_n"))
    # one row per (group, range partition): at most groups + partitions rows
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets, size = sized(parts.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                         - F.col("_first")).alias("_shift")), n=F.count(F.lit(1)))
    out = attach(done, offsets, [*keys, "_part"], size["n"])
    return (out.withColumn(name, F.col("_seq") + F.col("_shift") + F.lit(1))
            .drop("_seq", "_part", "_shift"))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    columns: Sequence[str]) -> DataFrame:
    """The first row of each group by ``order``, as a mergeable aggregate."""
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
