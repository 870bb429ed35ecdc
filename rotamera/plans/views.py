"""The test tables presented as ensembles. Each view is one SQL text, run unchanged by Spark
here and by the oracle, so both sides read the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# one record per conformer; b = 1 plays "rotational constants missing"
EVENTS = """SELECT user_id AS ensemble_id, event_id AS conf_id, event_type <> 'error' AS active,
 -100 + value/100/627.5096080305927 AS e,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE -100 + value/90/627.5096080305927 END AS g,
 CASE WHEN event_id % 7 = 0 THEN CAST(1 AS DOUBLE)
      ELSE day(ts) + CAST(hour(ts) AS DOUBLE)/24 END AS b FROM events"""

# several steps per conformer, with gaps
RECORDS = """SELECT l_orderkey % 100 AS ensemble_id, l_orderkey AS conf_id, l_linenumber AS protocol,
 -100 + min(l_extendedprice)/1e7 AS e,
 CASE WHEN min(l_discount) < 0.03 THEN NULL ELSE 0.1 + min(l_discount)/100 END AS g_e,
 CASE WHEN min(l_tax) < 0.02 THEN NULL ELSE min(l_tax) END AS b, sum(l_quantity) AS elapsed_s,
 min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber"""

# lines of four spectrum types
PEAKS = """SELECT user_id % 10 AS ensemble_id, user_id AS conf_id, event_id % 3 AS protocol,
 event_id AS line_no,
 CASE event_type WHEN 'view' THEN 'IR' WHEN 'click' THEN 'VCD' WHEN 'purchase' THEN 'UV'
   ELSE 'ECD' END AS graph_type,
 CASE WHEN event_type IN ('view','click') THEN 300 + value*10 ELSE 1.25 + value/60 END AS x,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) - 50 AS y
 FROM events WHERE event_type <> 'error'"""

# energies for the conformers of PEAKS
PEAK_RECORDS = """SELECT DISTINCT user_id % 10 AS ensemble_id, user_id AS conf_id,
 event_id % 3 AS protocol, user_id % 11 <> 0 AS active,
 -100 + CAST((user_id * 7 + event_id % 3 * 5) % 13 AS DOUBLE)/10000 AS e,
 CAST(NULL AS DOUBLE) AS g FROM events"""

# measured curves; the electronic ones are in nm
CURVES = """SELECT CASE p_size % 4 WHEN 0 THEN 'IR' WHEN 1 THEN 'VCD' WHEN 2 THEN 'UV' ELSE 'ECD' END
  AS graph_type,
 CASE WHEN p_size % 4 < 2 THEN CAST(400 + 100*p_size AS DOUBLE)
      ELSE 200 + 4*CAST(p_size AS DOUBLE) END AS x,
 avg(p_retailprice) - 950 AS y FROM part GROUP BY p_size"""

VIEWS = {"events": EVENTS, "records": RECORDS, "peaks": PEAKS, "peak_records": PEAK_RECORDS,
         "curves": CURVES}
_SOURCES = {"events": "events", "records": "lineitem", "peaks": "events",
            "peak_records": "events", "curves": "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = _SOURCES[name]
    return spark.sql(VIEWS[name].replace(f"FROM {source}", "FROM {src}"),
                     src=table(spark, sf_dir, source))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermochemistry input: 60 modes of both signs, three rotational constants, an energy."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("ensemble_id"), F.col("vec_id").alias("conf_id"),
        F.transform(F.slice(v, 1, 60), lambda x: x.cast("double") * 1000).alias("freq"),
        F.transform(F.slice(v, 61, 3), lambda x: F.abs(x.cast("double")) + 0.01).alias("b_vec"),
        (F.col("label") + 100).cast("double").alias("mass"),
        (F.col("vec_id") % 3 + 1).alias("mult"),
        (v[63].cast("double") / 100 - 100).alias("e"))


FREQUENCIES = """SELECT CAST(label AS BIGINT) AS ensemble_id, vec_id AS conf_id,
 list_transform(embedding[1:60], lambda x: CAST(x AS DOUBLE)*1000) AS freq,
 list_transform(embedding[61:63], lambda x: abs(CAST(x AS DOUBLE)) + 0.01) AS b_vec,
 CAST(100 + label AS DOUBLE) AS mass, 1 + vec_id % 3 AS mult,
 -100 + CAST(embedding[64] AS DOUBLE)/100 AS e FROM embeddings"""


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 atoms a conformer, every third one a hydrogen."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("ensemble_id"), F.col("vec_id").alias("conf_id"),
        F.transform(F.sequence(F.lit(0), F.lit(20)),
                    lambda i: F.when(i % 3 == 0, "H").otherwise("C")).alias("atoms"),
        F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(
            F.slice(v, i * 3 + 1, F.lit(3)), lambda x: x.cast("double"))).alias("geom"),
        (v[63].cast("double") / 100 - 100).alias("e"))


GEOMETRIES = """SELECT CAST(label AS BIGINT) AS ensemble_id, vec_id AS conf_id,
 list_transform(range(21), lambda i: CASE WHEN i % 3 = 0 THEN 'H' ELSE 'C' END) AS atoms,
 list_transform(range(21), lambda i: list_transform(embedding[3*i+1:3*i+3],
   lambda x: CAST(x AS DOUBLE))) AS geom,
 -100 + CAST(embedding[64] AS DOUBLE)/100 AS e FROM embeddings"""
