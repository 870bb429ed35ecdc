"""New calculation outputs to records, as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rotamera.sources.logs import parse_logs

KEY = ["ensemble_id", "conf_id", "protocol"]
LAYOUT = r"([^/]+)/([0-9]+)_p([0-9]+)[^/]*$"
# --- fixed value: folder/conformer_pSTEP.ext names the record -----------------


def named(df: DataFrame) -> DataFrame:
    """Record keys from the file's folder and name."""
    part = {k: F.regexp_extract("file", LAYOUT, i) for i, k in enumerate(KEY, start=1)}
    return df.withColumns({"ensemble_id": part["ensemble_id"],
                           "conf_id": part["conf_id"].try_cast("long"),
                           "protocol": part["protocol"].try_cast("int")})


def append_new(batch: DataFrame, out: str) -> None:
    """Append the batch's records whose key the table does not hold yet, one per key: the
    newest file wins. The table is read only in the steps that occur in the batch."""
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in KEY]
    fresh = batch.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), F.col("modified")).alias("_r")).select(*KEY, "_r.*")
    parsed = fresh = fresh.persist()      # the texts are parsed once for both uses
    try:
        done = spark.read.parquet(out).select(*KEY)
    except AnalysisException:
        done = None
    if done is not None:
        steps = [r[0] for r in fresh.select("protocol").distinct().collect()]
        fresh = fresh.join(done.where(F.col("protocol").isin(steps)), KEY, "left_anti")
    fresh.drop("modified").write.mode("append").partitionBy("protocol").parquet(out)
    parsed.unpersist()


def stream_records(spark: SparkSession, in_dir: str, out: str, checkpoint: str,
                   dialect: str = "orca",
                   name_files: Callable[[DataFrame], DataFrame] = named,
                   available_now: bool = True, packed: T.StructType | None = None
                   ) -> StreamingQuery:
    """Parse output files as they land in ``in_dir`` and keep one record per (ensemble,
    conformer, step) under ``out``. Started again on the same checkpoint it resumes after
    the last finished batch; a batch that is replayed adds nothing, since its keys are
    already there. One output is one file, unless ``packed`` gives the schema of Parquet files
    that hold many, each a row with its key and ``text``: what to use beyond some thousands."""
    read = spark.readStream.option("recursiveFileLookup", "true")
    modified = F.col("_metadata.file_modification_time").alias("modified")
    if packed is not None:
        files = read.schema(packed).parquet(in_dir).select(*packed.names, modified)
    else:
        schema = T.StructType([T.StructField("value", T.StringType())])
        files = name_files(read.schema(schema).text(in_dir, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), modified, F.col("value").alias("text")))
    parsed = parse_logs(files, dialect).where(F.col("conf_id").isNotNull())
    writer = (parsed.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, _: append_new(batch, out)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
