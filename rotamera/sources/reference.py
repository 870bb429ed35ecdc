"""Measured curves and computed spectra on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotamera.operators.spectra import load_spectra


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """(partition columns, graph_type, x, y) of two-column text files named like
    ``ir_ref.dat``, or folders of parts so named; text after # is a comment."""
    raw = spark.read.text(path)
    extra = [c for c in raw.columns if c != "value"]
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(?i)(ir|vcd|uv|ecd)_ref[^/]*(?:/part-[^/]*)?$", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "))
    words = F.split(text, " ")
    rows = raw.select(*extra, F.upper(name).alias("graph_type"),
                      F.get(words, 0).try_cast("double").alias("x"),
                      F.get(words, 1).try_cast("double").alias("y"))
    return rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def write_spectrum(df: DataFrame, path: str, text: bool = False) -> None:
    """Spectra partitioned by type and step, as Parquet or as ``x y`` text lines in grid
    order."""
    parts = ["graph_type", "protocol"]
    if not text:
        df.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return
    rest = [c for c in df.columns if c not in (*parts, "i", "x", "y")]
    order = [*parts, *rest, "i"]
    line = F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(*parts, *rest, line.alias("value"))
     .write.mode("overwrite").partitionBy(*parts, *rest).text(path))


def read_spectra(spark: SparkSession, path: str, protocols: Sequence[int] | None = None
                 ) -> DataFrame:
    """Spectra written by :func:`write_spectrum`; listed steps prune partitions."""
    return load_spectra(spark.read.parquet(path), protocols)
