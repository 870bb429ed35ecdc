"""Ensemble state: records kept as Parquet by step, and JSON state documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from rotamera.functions.energy import known
from rotamera.schemas import STATE_CONFORMER


def save_state(df: DataFrame, path: str) -> None:
    """Write records by step. Only the steps present in ``df`` are replaced, each when its
    files are complete."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("protocol").parquet(path))


def load_state(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no state at {path}") from exc
        raise


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(ensemble_id, conf_id, c) of JSON documents with one object per conformer. The ensemble is
    named by the partition column if there is one, else by the file."""
    raw = spark.read.text(path, wholetext=True)
    name = (F.col("ensemble_id").cast("string") if "ensemble_id" in raw.columns else
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?$", 1))
    doc = F.from_json("value", T.MapType(T.StringType(), STATE_CONFORMER),
                      {"allowNonNumericNumbers": "true"})
    return raw.select(name.alias("ensemble_id"), F.explode(doc).alias("_k", "c")).select(
        "ensemble_id", F.coalesce("c.number", F.col("_k").try_cast("long")).alias("conf_id"), "c")


def read_state_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(ensemble_id, conf_id, protocol, graph_type, line_no, x, y): the line lists that such documents
    keep by step and type. Lists of unequal lengths end with the shorter one."""
    rows = (_documents(spark, path)
            .select("ensemble_id", "conf_id", F.explode("c.graphs_data.data").alias("protocol", "_g"))
            .select("ensemble_id", "conf_id", F.col("protocol").cast("int").alias("protocol"),
                    F.explode("_g").alias("graph_type", "_l")))
    both = F.filter(F.arrays_zip("_l.X", "_l.Y"), lambda v: v["X"].isNotNull() & v["Y"].isNotNull())
    return rows.select("ensemble_id", "conf_id", "protocol", "graph_type",
                       F.posexplode(both).alias("line_no", "_v")).select(
        "ensemble_id", "conf_id", "protocol", "graph_type", "line_no", F.col("_v.X").alias("x"), F.col("_v.Y").alias("y"))


def read_state_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(conformers, records) of JSON state documents; :func:`read_state_peaks` has their lines."""
    confs = _documents(spark, path)
    conformers = confs.select("ensemble_id", "conf_id", "c.atoms",
                              F.col("c.last_geometry").alias("geom"), "c.active", "c.cluster")
    rec = confs.select("ensemble_id", "conf_id",
                       F.explode("c.energies.data").alias("protocol", "r"))
    plain = {"e": "E", "g": "G", "h": "H", "s": "S", "g_e": "G_E", "zpve": "zpve", "b": "B",
             "m": "m", "pop": "Pop", "erel": "Erel", "elapsed_s": "time"}
    records = rec.select(
        "ensemble_id", "conf_id", F.col("protocol").cast("int").alias("protocol"),
        *[known(f"r.{v}").alias(k) for k, v in plain.items()],
        F.col("r.B_vec").alias("b_vec"), F.col("r.m_vec").alias("m_vec"),
        F.col("r.Freq").alias("freq"))
    return conformers, records


def state_json(conformers: DataFrame, records: DataFrame, keys=("ensemble_id",),
               peaks: DataFrame | None = None) -> DataFrame:
    """(keys, conf_id, value): each conformer's JSON object, with its line lists if ``peaks`` are given, for
    exchange with tools that read such documents. Records and lines of one conformer are few;
    conformers stay separate rows."""
    ids = [*keys, "conf_id"]
    rec = F.struct(*[F.col(a).alias(b) for a, b in (
        ("e", "E"), ("g", "G"), ("h", "H"), ("s", "S"), ("g_e", "G_E"), ("zpve", "zpve"),
        ("b", "B"), ("m", "m"), ("pop", "Pop"), ("erel", "Erel"), ("elapsed_s", "time"),
        ("b_vec", "B_vec"), ("m_vec", "m_vec"), ("freq", "Freq"))])
    step = F.col("protocol").cast("string")
    out = conformers.join(records.groupBy(*ids).agg(F.map_from_entries(F.collect_list(
        F.struct(step, rec))).alias("_data")), ids, "left")
    body = [F.col("conf_id").alias("number"), "atoms", F.col("geom").alias("last_geometry"), "active",
            "cluster", F.struct(F.col("_data").alias("data")).alias("energies")]
    if peaks is not None:
        lines = F.array_sort(F.collect_list(F.struct("line_no", "x", "y")))
        types = peaks.groupBy(*ids, "protocol", "graph_type").agg(lines.alias("_l")).groupBy(*ids, "protocol").agg(
            F.map_from_entries(F.collect_list(F.struct("graph_type", F.struct(
                F.col("_l.x").alias("X"), F.col("_l.y").alias("Y"))))).alias("_t"))
        out = out.join(types.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct(step, "_t"))).alias("_g")),
                       ids, "left")
        empty = F.create_map().cast("map<string,map<string,struct<X:array<double>,Y:array<double>>>>")
        body.append(F.struct(F.coalesce("_g", empty).alias("data")).alias("graphs_data"))
    return out.select(*ids, F.to_json(F.struct(*body)).alias("value"))
