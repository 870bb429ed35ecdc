"""Multi-frame XYZ files.

Files are read by line, so a file of any size is split over many tasks like any text file;
frames that straddle a split are put together in one shuffle keyed by frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from rotamera.functions.energy import effective_energy
from rotamera.operators import KEYS
from rotamera.operators.grouping import attach
from rotamera.session import cut_lineage
from rotamera.sources.numbers import REAL

# a minus sign counts wherever it stands; other numbers must not continue a word
COMMENT_ENERGY = rf"((?:(?=-)|(?<![\w.+-])){REAL})"


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Add the 0-based ``_line`` within the file and the atom count ``_n`` of its first frame.

    Row ids rise in reading order within a split; the splits of a file are chained by their
    line counts, a table of one row per split."""
    split = ["_file", "_block"]
    parts = lines.groupBy(*split).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_count"),
        F.min_by("value", "_id").alias("_head"))
    w = W.partitionBy("_file").orderBy("_block")
    before = F.coalesce(F.sum("_count").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    head = F.first("_head").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    parts = cut_lineage(parts.select(*split, (before - F.col("_first")).alias("_shift"),
                                     F.trim(head).try_cast("int").alias("_n")))
    out = attach(lines, parts, split, parts.count(), 500)
    return out.withColumn("_line", F.col("_id") + F.col("_shift")).drop("_id", "_shift", "_block")


def read_xyz(spark: SparkSession, path: str, with_energy: bool = False) -> DataFrame:
    """(partition columns, file, conf_id, comment, atoms, geom[, e]) of a file, a folder or a
    glob whose name ends in ``.xyz``. The first frame's atom count holds for the whole file;
    an incomplete last frame is dropped; conformers are numbered from 1 in each file."""
    if not path.rstrip("/").endswith(".xyz"):
        raise ValueError(f"an ensemble must be an XYZ (multi)geometry file, got {path}")
    raw = spark.read.text(path)
    extra = [c for c in raw.columns if c != "value"]
    lines = raw.select(*extra, "value", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))
    size = F.col("_n") + 2
    lines = _numbered_lines(lines).where(F.col("_n") > 0).withColumns({
        "_frame": F.floor(F.col("_line") / size), "_pos": F.col("_line") % size})
    frames = (lines.groupBy(*extra, "_file", "_frame", "_n")
              .agg(F.array_sort(F.collect_list(F.struct("_pos", "value"))).alias("_rows"))
              .where(F.size("_rows") == size))
    words = F.transform(F.slice("_rows", F.lit(3), F.col("_n")),
                        lambda a: F.split(F.trim(F.regexp_replace(a["value"], r"\s+", " ")), " "))
    frames = frames.select(
        *extra, F.col("_file").alias("file"), (F.col("_frame") + 1).alias("conf_id"),
        F.trim(F.col("_rows")[1]["value"]).alias("comment"), words.alias("_w"))
    frames = frames.select(
        *extra, "file", "conf_id", "comment",
        F.transform("_w", lambda v: v[0]).alias("atoms"),
        F.transform("_w", lambda v: F.transform(F.slice(v, 2, 3), lambda x: x.try_cast("double")))
        .alias("geom"))
    if with_energy:
        text = F.trim(F.regexp_extract("comment", COMMENT_ENERGY, 1))
        frames = frames.withColumn("e", text.try_cast("double"))
    return frames


def frame_text(energy=None):
    """One conformer as XYZ text: atom count, ``CONFORMER id energy``, atom lines."""
    e = effective_energy("e", "g") if energy is None else energy
    atoms = F.transform(F.arrays_zip("atoms", "geom"), lambda a: F.format_string(
        "%s  %14.6f  %14.6f  %14.6f", a["atoms"], a["geom"][0], a["geom"][1], a["geom"][2]))
    head = F.format_string("%d\nCONFORMER %d %10f", F.size("atoms"), F.col("conf_id"), e)
    return F.concat_ws("\n", head, F.array_join(atoms, "\n"))


def write_xyz(df: DataFrame, path: str, keys: Sequence[str] = KEYS, sort: bool = True,
              energy=None) -> None:
    """Active conformers, one folder per ensemble, whole frames per file. ``sort`` orders by
    energy with a range-partitioned sort, so a large ensemble becomes several files that
    continue one another."""
    e = effective_energy("e", "g") if energy is None else energy
    out = df.where("active").select(*keys, F.col("conf_id").alias("_c"), e.alias("_e"),
                                    frame_text(e).alias("value"))
    order = [F.col(k) for k in keys] + [F.col("_e").asc_nulls_last(), F.col("_c")]
    if sort:
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.drop("_c", "_e").write.mode("overwrite").partitionBy(*keys).text(path)
