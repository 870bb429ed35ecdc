"""Documents to token ids: language ID, line dedup, near-duplicates, decontamination, byte BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all but the last with
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rotamera.llm import bpe, langid, lines, queries, simhash, tiling
from rotamera.llm.common import private, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and those below the calibrated confidence go."""
    model = langid.fit(docs)
    name, = private(docs, "_language")
    marked = docs.withColumn(name, langid.predict(docs, model))
    return marked.where(~F.col(name)["rejected"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go, and documents of which nothing is left."""
    gone, = private(docs, "_gone")
    out = lines.dedup(docs, removed=gone)
    left = out.where((F.col(gone) == 0) | (F.trim("text") != ""))
    size = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order, go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids with what they decode to."""
    code = bpe.coder(spark, queries.RANKS, queries.PATTERN)
    both = docs.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"),
                       code("text").alias("_c"))
    return both.select("doc_id", "lang", "source", "text_sha256",
                       bpe.n_tokens(F.col("_c.ids")).alias("n_tokens"), F.col("_c.ids").alias("ids"),
                       F.sha2("_c.back", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup),
          ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("byte_bpe", byte_bpe)]

# Fingerprints, byte-pair merges and string tiling are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
