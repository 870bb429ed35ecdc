"""Protocol files: the ordered steps of a refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rotamera.constants import METHOD_BASIS
from rotamera.operators.records import thresholds_by_level
from rotamera.schemas import PROTOCOL_STEP

# --- fixed values: the steps used when no protocol file is given --------------
DEFAULT_PROTOCOL = """{
 "0": {"functional": "b97-3c", "basis": "def2-mTZVP"},
 "1": {"functional": "r2scan-3c", "basis": "def2-mTZVPP", "opt": true, "freq": true},
 "2": {"functional": "wb97x-d4rev", "basis": "def2-qzvpp"}}"""


def parse_protocols(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row per step of each JSON document: step number, typed settings with defaults, the
    basis set a method implies, level and thresholds."""
    extra = [c for c in docs.columns if c != text]
    steps = F.from_json(text, T.MapType(T.StringType(), PROTOCOL_STEP))
    rows = docs.select(*extra, F.explode(steps).alias("protocol", "p")).select(
        *extra, F.col("protocol").cast("int").alias("protocol"), "p.*")
    method = F.lower("functional")
    implied = F.create_map(*[F.lit(v) for kv in METHOD_BASIS.items() for v in kv])[method]
    no = F.lit(False)
    rows = rows.withColumns({
        "basis": F.when(method.contains("xtb"), "").otherwise(
            F.coalesce(implied, F.col("basis"), F.lit(""))),
        "calculator": F.lower(F.coalesce("calculator", F.lit("orca"))),
        "mult": F.coalesce("mult", F.lit(1)), "charge": F.coalesce("charge", F.lit(0)),
        "freq_fact": F.coalesce("freq_fact", F.lit(1.0)),
        "add_input": F.translate(F.coalesce("add_input", F.lit("")), "'", '"'),
        "comment": F.coalesce("comment", F.lit("")),
        "solvent": F.when(F.col("solvent.solvent") != "", F.struct(
            "solvent.solvent", F.coalesce("solvent.smd", no).alias("smd"))),
        **{c: F.coalesce(c, no) for c in ("opt", "freq", "graph", "no_prune", "skip_opt_fail",
                                          "block_on_retention_rate")},
        # true asks for a number of clusters found by silhouette, a number above 1 sets it
        "n_clusters": F.when(F.col("cluster").try_cast("int") > 1, F.col("cluster").try_cast("int")),
    })
    rows = rows.withColumn("clustering", (F.lower("cluster") == "true")
                           | F.col("n_clusters").isNotNull())
    rows = rows.withColumn("clustering", F.coalesce("clustering", no))
    bad = F.raise_error(F.concat(F.lit("multiplicity must be greater than 0, given "), "mult"))
    rows = rows.withColumn("mult", F.when(F.col("mult") > 0, F.col("mult")).otherwise(bad))
    for old, new in (("thrG", "thr_g"), ("thrB", "thr_b"), ("thrGMAX", "thr_gmax")):
        rows = rows.withColumnRenamed(old, new)
    return thresholds_by_level(rows)


def read_protocols(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Steps of a protocol file, or the default ones, ordered by step number."""
    if path is None:
        docs = spark.createDataFrame([(DEFAULT_PROTOCOL,)], "value string")
    else:
        docs = spark.read.text(path, wholetext=True)
    return parse_protocols(docs).orderBy("protocol")
