"""Registered queries over readers, writers and incremental ingest. Texts are rendered by
Spark from the given tables, read back, and compared with the numbers they were made from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rotamera.constants import GRAPH_DEFAULTS, LEVEL_THRESHOLDS
from rotamera.operators import spectra as S
from rotamera.operators.geometry import with_mass
from rotamera.operators.records import record_status
from rotamera.plans import log_text
from rotamera.plans.refine import records_from_logs
from rotamera.plans.spectra_queries import ORACLES as SPECTRA_ORACLES, N, _lines, _out
from rotamera.plans.thermo_queries import _gibbs_cte
from rotamera.plans.tools import r, rs
from rotamera.plans.views import CURVES, GEOMETRIES, PEAKS, RECORDS, geometries, view
from rotamera.session import ensure_checkpoint_dir
from rotamera.sources import logs, reference, state, xyz
from rotamera.sources.protocols import parse_protocols
from rotamera.streaming.records import stream_records as start_stream

ID = ["ensemble_id", "conf_id"]


def _scratch(spark) -> str:
    """A fresh folder beside the session's checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"


def xyz_roundtrip(spark, sf):
    path = f"{_scratch(spark)}/ensembles.xyz"
    df = geometries(spark, sf).withColumns({"active": F.col("conf_id") % 6 != 0,
                                            "g": F.lit(None).cast("double")})
    xyz.write_xyz(df, path)
    back = xyz.read_xyz(spark, path, with_energy=True)
    number = F.regexp_extract("comment", r"CONFORMER (\d+)", 1).cast("long")
    rows = back.select(F.col("ensemble_id").cast("long"), number.alias("conf_id"), "e",
                       F.posexplode(F.arrays_zip("atoms", "geom")).alias("i", "a"))
    return rows.select(*ID, r("e", 6).alias("e"), F.col("i").cast("long").alias("i"),
                       F.col("a.atoms").alias("atom"),
                       *[r(F.col("a.geom")[k], 6).alias(c) for k, c in enumerate("xyz")])


def xyz_text(spark, sf):
    """The frames as written."""
    df = geometries(spark, sf).withColumn("g", F.lit(None).cast("double"))
    return df.select(*ID, xyz.frame_text().alias("frame"))


def _parsed(spark, sf, *only):
    both = [logs.parse_logs(log_text.corpus(spark, sf, d), d, only=only)
            .withColumn("dialect", F.lit(d)) for d in ("orca", "gaussian")]
    return both[0].unionByName(both[1])


def log_energy(spark, sf):
    return _parsed(spark, sf, "version", "e").select("dialect", *ID, "version", r("e", 8).alias("e"))


def log_files(spark, sf):
    """Outputs written one to a file, in both dialects, and read back as files."""
    got = None
    for d in ("orca", "gaussian"):
        path = f"{_scratch(spark)}/{d}"
        # a task writes the files of whole conformers, as many tasks as there are partitions
        logs.write_logs(log_text.corpus(spark, sf, d), path)
        part = logs.parse_logs(logs.read_written_logs(spark, path, d), d,
                               only=("version", "e", "b_vec", "terminated"))
        part = part.withColumn("dialect", F.lit(d))
        got = part if got is None else got.unionByName(part)
    return got.select("dialect", *[F.col(c).try_cast("long").alias(c) for c in ID], "version", r("e", 8).alias("e"),
                      *[r(F.col("b_vec")[k]).alias(f"b{k}") for k in range(3)], "terminated")


def reference_files(spark, sf):
    """Measured curves written as text, one folder per type, with comments and blank lines, and read back."""
    base = _scratch(spark)
    curves = view(spark, sf, "curves")
    for t in GRAPH_DEFAULTS:
        line = F.concat(F.lit("  "), F.col("x").cast("string"), F.lit("\t"), F.col("y").cast("string"),
                        F.lit("   # measured\n# a comment\n"))
        (curves.where(F.col("graph_type") == t).select(line.alias("value"))
         .write.text(f"{base}/{t.lower()}_ref.dat"))
    return reference.read_reference(spark, f"{base}/*_ref.dat").select("graph_type", r("x", 8).alias("x"), r("y", 8).alias("y"))


def log_geometry(spark, sf):
    rows = _parsed(spark, sf, "geom").select("dialect", *ID, F.posexplode("geom").alias("i", "p"))
    return rows.select("dialect", *ID, F.col("i").cast("long").alias("i"),
                       *[r(F.col("p")[k], 7).alias(c) for k, c in enumerate("xyz")])


def log_b_dipole(spark, sf):
    df = _parsed(spark, sf, "b_vec", "m_vec")
    return df.select("dialect", *ID, *[r(F.col(f"{c}_vec")[k]).alias(f"{c}{k}")
                                       for c in "bm" for k in range(3)])


def log_frequencies(spark, sf):
    rows = _parsed(spark, sf, "freq").select("dialect", *ID, F.posexplode("freq").alias("i", "nu"))
    return rows.select("dialect", *ID, F.col("i").cast("long").alias("i"), r("nu", 5).alias("nu"))


def _line_table(df):
    return df.select("dialect", *ID, "graph_type", F.col("line_no").cast("long").alias("line_no"),
                     r("x", 5).alias("x"), r("y", 5).alias("y"))


def log_vibrational_lines(spark, sf):
    df = _parsed(spark, sf, "ir", "vcd").withColumns({c: F.array().cast(
        "array<struct<x:double,y:double>>") for c in ("uv", "ecd")})
    return _line_table(logs.peaks_of(df, ["dialect", *ID]))


def log_excitations(spark, sf):
    df = _parsed(spark, sf, "uv", "ecd").withColumns({c: F.array().cast(
        "array<struct<x:double,y:double>>") for c in ("ir", "vcd")})
    return _line_table(logs.peaks_of(df, ["dialect", *ID]))


def log_status(spark, sf):
    df = _parsed(spark, sf, "terminated", "converged", "freq").withColumn("n_freq", F.size("freq"))
    df = record_status(df, F.col("conf_id") % 2 == 0, F.lit(True), F.col("conf_id") % 3 == 0)
    return df.select("dialect", *ID, "terminated", "converged", "status", "active", "failed")


def log_records(spark, sf):
    """Outputs to finished records: status, scaled frequencies, thermochemistry, norms."""
    outputs = with_mass(log_text.numbers(spark, sf))
    want = ("e", "b_vec", "m_vec", "freq", "terminated", "converged")
    parsed = None
    for d, text in (("orca", log_text.orca_text()), ("gaussian", log_text.gaussian_text())):
        df = outputs.select(*ID, "protocol", "atoms", "mass", F.lit(d).alias("dialect"),
                            text.alias("text"))
        part = logs.parse_logs(df, d, only=want)
        parsed = part if parsed is None else parsed.unionByName(part)
    rec = records_from_logs(parsed, F.col("conf_id") % 2 == 0, F.lit(True), F.lit(True), F.lit(1), 0.97)
    return rec.select("dialect", *ID, "status", "active", r("e", 8).alias("e"), r("g", 7).alias("g"),
                      r("g_e", 7).alias("g_e"), r("h", 7).alias("h"), r(F.col("s") * 1e6, 5).alias("s"),
                      r("zpve", 7).alias("zpve"), r("b").alias("b"), r("m").alias("m"))


def protocol_table(spark, sf):
    """One JSON document of steps per conformer of the record view."""
    step = F.struct(
        F.when(F.col("flag") == "A", "r2SCAN-3c").when(F.col("flag") == "N", "GFN2-xTB")
        .otherwise("B3LYP").alias("functional"), F.lit("6-31G*").alias("basis"),
        (F.col("flag") == "A").alias("opt"), (F.col("elapsed_s") > 40).alias("freq"),
        F.when(F.col("protocol") == 1, 0.75).alias("thrG"),
        (F.col("protocol") % 3 + 1).alias("mult"))
    docs = view(spark, sf, "records").groupBy(*ID).agg(F.to_json(F.map_from_entries(
        F.collect_list(F.struct(F.col("protocol").cast("string"), step)))).alias("value"))
    return parse_protocols(docs).select(
        *ID, F.col("protocol").cast("long").alias("protocol"), "functional", "basis", "calculator",
        "level", r("thr_g", 8).alias("thr_g"), r("thr_b", 8).alias("thr_b"),
        r("thr_gmax", 8).alias("thr_gmax"), F.col("mult").cast("long").alias("mult"),
        "opt", "freq", "no_prune", "clustering", r("freq_fact").alias("freq_fact"))


def state_roundtrip(spark, sf):
    """Saved by step; one step then replaced, the others untouched."""
    path = f"{_scratch(spark)}/state"
    df = view(spark, sf, "records")
    state.save_state(df, path)
    state.save_state(df.where("protocol = 2").withColumn("elapsed_s", F.col("elapsed_s") + 1), path)
    return state.load_state(spark, path).select(
        *ID, F.col("protocol").cast("long").alias("protocol"), r("e", 10).alias("e"),
        r("g_e", 8).alias("g_e"), r("b", 8).alias("b"), r("elapsed_s", 4).alias("elapsed_s"), "flag")


def state_document_roundtrip(spark, sf):
    """State documents with line lists, written one file per ensemble and read back."""
    path = f"{_scratch(spark)}/documents"
    peaks = view(spark, sf, "peaks")
    confs = peaks.select(*ID).distinct().select(
        *ID, F.array(F.lit("C")).alias("atoms"), F.array(F.array(*[F.lit(0.0)] * 3)).alias("geom"),
        F.lit(True).alias("active"), F.lit(None).cast("int").alias("cluster"))
    missing = {c: F.lit(None).cast("double") for c in ("h", "s", "g_e", "zpve", "b", "m", "pop", "erel", "elapsed_s")}
    missing |= {c: F.lit(None).cast("array<double>") for c in ("b_vec", "m_vec", "freq")}
    records = view(spark, sf, "peak_records").withColumns(missing)
    docs = state.state_json(confs, records, peaks=peaks)
    named = F.concat(F.lit('"'), F.col("conf_id").cast("string"), F.lit('": '), F.col("value"))
    (docs.groupBy("ensemble_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(named), ", "), F.lit("}"))
                                     .alias("value"))
     .write.partitionBy("ensemble_id").text(path))
    back = state.read_state_peaks(spark, path)
    return back.select(F.col("ensemble_id").cast("long").alias("ensemble_id"), "conf_id",
                       F.col("protocol").cast("long").alias("protocol"), "graph_type", r("x", 8).alias("x"),
                       r("y", 8).alias("y"))


def spectrum_sink_roundtrip(spark, sf):
    path = f"{_scratch(spark)}/spectra"
    reference.write_spectrum(S.default_spectrum(_lines(spark, sf), N), path)
    return _out(reference.read_spectra(spark, path, [0, 2]))


def stream_records(spark, sf):
    """Outputs arriving in two drops, many to a file, the second with repeats; the table holds
    each once."""
    base, got = _scratch(spark), None
    for d in ("orca", "gaussian"):
        inbox, out, ckpt = (f"{base}/{d}/{x}" for x in ("in", "records", "ckpt"))
        texts = log_text.corpus(spark, sf, d).select(*ID, "protocol", "text")
        for drop, pick in enumerate((
                F.col("conf_id") % 2 == 0, (F.col("conf_id") % 2 == 1) | (F.col("conf_id") % 10 == 0))):
            texts.where(pick).write.parquet(f"{inbox}/{drop}")
            query = start_stream(spark, inbox, out, ckpt, d, packed=texts.schema)
            query.awaitTermination()
        part = spark.read.parquet(out).select(
            F.lit(d).alias("dialect"), *ID, F.col("protocol").cast("long").alias("protocol"),
            r("e", 8).alias("e"), "terminated", "converged",
            F.size("freq").cast("long").alias("n_freq"))
        got = part if got is None else got.unionByName(part)
    return got


QUERIES = {f.__name__: f for f in (
    xyz_roundtrip, xyz_text, log_files, reference_files, log_energy, log_geometry, log_b_dipole, log_frequencies,
    log_vibrational_lines, log_excitations, log_status, log_records, protocol_table, state_roundtrip,
    state_document_roundtrip,
    spectrum_sink_roundtrip, stream_records)}

# --- oracles ------------------------------------------------------------------

_L = """WITH b AS (SELECT CAST(label AS BIGINT) AS ensemble_id, vec_id AS conf_id,
 list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
 -100 + CAST(embedding[64] AS DOUBLE)/100 AS e FROM embeddings),
 l AS (SELECT * FROM b, (VALUES ('orca'), ('gaussian')) d(dialect))"""
_I = "ensemble_id, conf_id"


def _each(n: int) -> str:
    return f"(SELECT unnest(range({n})) AS i)"


def _placeholders(types: str) -> str:
    return f"""SELECT dialect, {_I}, t AS graph_type, 0 AS line_no, 0e0 AS x, 0e0 AS y
 FROM l, (SELECT unnest({types}) AS t) WHERE dialect = 'orca' AND conf_id % 4 = 0"""


_PROT = ", ".join(f"({i}, '{n}', {a!r}e0, {'%.17f' % b}::DOUBLE, {m!r}e0)"
                  for i, (n, a, b, m) in enumerate(LEVEL_THRESHOLDS))
ORACLES = {
    "xyz_roundtrip": f"""WITH g AS ({GEOMETRIES}) SELECT {_I}, {rs('e', 6)} AS e, i, atoms[i+1] AS atom,
 {', '.join(f"{rs(f'geom[i+1][{k}]', 6)} AS {c}" for k, c in ((1, 'x'), (2, 'y'), (3, 'z')))}
 FROM g, {_each(21)} WHERE conf_id % 6 <> 0""",
    "xyz_text": f"""WITH g AS ({GEOMETRIES}) SELECT {_I}, '21' || chr(10) || 'CONFORMER ' || conf_id || ' '
 || printf('%10.6f', e) || chr(10) || array_to_string(list_transform(range(1, 22),
 lambda i: printf('%s  %14.6f  %14.6f  %14.6f', atoms[i], geom[i][1], geom[i][2], geom[i][3])), chr(10)) AS frame FROM g""",
    "log_files": f"""{_L} SELECT dialect, {_I}, CASE WHEN dialect = 'gaussian' THEN ''
 WHEN conf_id % 4 = 0 THEN '5' ELSE '6' END AS version, {rs('e', 8)} AS e,
 {', '.join(f"{rs(f'abs(v[{25 + k}]) + 0.01e0')} AS b{k}" for k in range(3))}, conf_id % 17 <> 0 AS terminated FROM l""",
    "state_document_roundtrip": f"""SELECT ensemble_id, conf_id, protocol, graph_type, {rs('x', 8)} AS x, {rs('y', 8)} AS y
 FROM ({PEAKS})""",
    "reference_files": f"""SELECT graph_type, {rs('x', 8)} AS x, {rs('y', 8)} AS y FROM ({CURVES})""",
    "log_energy": f"""{_L} SELECT dialect, {_I}, CASE WHEN dialect = 'gaussian' THEN ''
 WHEN conf_id % 4 = 0 THEN '5' ELSE '6' END AS version, {rs('e', 8)} AS e FROM l""",
    "log_geometry": f"""{_L} SELECT dialect, {_I}, i,
 {', '.join(f"{rs(f'v[3*i+{k}]', 7)} AS {c}" for k, c in ((1, 'x'), (2, 'y'), (3, 'z')))} FROM l, {_each(21)}""",
    "log_b_dipole": f"""{_L} SELECT dialect, {_I},
 {', '.join(f"{rs(f'abs(v[{25 + k}]) + 0.01e0')} AS b{k}" for k in range(3))},
 {', '.join(f"{rs(f'v[{28 + k}]')} AS m{k}" for k in range(3))} FROM l""",
    "log_frequencies": f"{_L} SELECT dialect, {_I}, i, {rs('v[i+1]*1000', 5)} AS nu FROM l, {_each(24)}",
    "log_vibrational_lines": f"""{_L}, n AS (
 SELECT dialect, {_I}, 'IR' AS graph_type, i AS line_no, v[i+1]*1000 AS x, abs(v[25+i]) AS y FROM l, {_each(24)}
 UNION ALL SELECT dialect, {_I}, 'VCD', i, v[i+1]*1000, v[41+i] FROM l, {_each(24)}
  WHERE dialect = 'gaussian' OR conf_id % 4 <> 0 UNION ALL {_placeholders("['VCD']")})
 SELECT dialect, {_I}, graph_type, line_no, {rs('x', 5)} AS x, {rs('y', 5)} AS y FROM n""",
    "log_excitations": f"""{_L}, n AS (
 SELECT dialect, {_I}, 'UV' AS graph_type, i AS line_no, abs(v[31+i])*5 + 2 AS x, abs(v[37+i]) AS y FROM l, {_each(6)}
 UNION ALL SELECT dialect, {_I}, 'ECD', i, abs(v[31+i])*5 + 2, v[43+i]*10 FROM l, {_each(6)})
 SELECT dialect, {_I}, graph_type, line_no, {rs('x', 5)} AS x, {rs('y', 5)} AS y FROM n""",
    "log_status": f"""{_L}, s AS (SELECT *, conf_id % 17 <> 0 AS terminated, conf_id % 5 <> 0 AS converged,
 CASE WHEN conf_id % 17 = 0 THEN 'crashed' WHEN conf_id % 2 = 0 AND conf_id % 5 = 0 THEN 'not_converged'
 ELSE 'ok' END AS status FROM l) SELECT dialect, {_I}, terminated, converged, status,
 status = 'ok' AS active, status = 'not_converged' AND conf_id % 3 <> 0 AS failed FROM s""",
    "log_records": f"""{_L}, n AS (SELECT *, list_filter(list_transform(v[1:24], lambda x: x*1000*0.97e0),
  lambda x: x > 0) AS m, list_transform(v[25:27], lambda x: abs(x) + 0.01e0) AS b_vec,
  {7 * 1.008 + 14 * 12.011!r}e0 AS mass, 1 AS mult,
  sqrt(v[28]*v[28] + v[29]*v[29] + v[30]*v[30]) AS mn,
  CASE WHEN conf_id % 17 = 0 THEN 'crashed' WHEN conf_id % 2 = 0 AND conf_id % 5 = 0 THEN 'not_converged'
  ELSE 'ok' END AS status FROM l), {_gibbs_cte('t', 'n')},
 k AS (SELECT *, status = 'ok' AS active FROM t)
 SELECT dialect, {_I}, status, active, CASE WHEN active THEN {rs('e', 8)} END AS e,
 CASE WHEN active THEN {rs('gg', 7)} END AS g, CASE WHEN active THEN {rs('gg - e', 7)} END AS g_e,
 CASE WHEN active THEN {rs('hh', 7)} END AS h, CASE WHEN active THEN {rs('ss*1e6', 5)} END AS s,
 CASE WHEN active THEN {rs('zz', 7)} END AS zpve, CASE WHEN active THEN
 {rs('sqrt(b_vec[1]*b_vec[1] + b_vec[2]*b_vec[2] + b_vec[3]*b_vec[3])')} END AS b,
 CASE WHEN active THEN {rs('mn')} END AS m FROM k""",
    "protocol_table": f"""WITH c AS ({RECORDS}), s AS (SELECT *, CASE flag WHEN 'A' THEN 1 ELSE 0 END
 + CASE WHEN elapsed_s > 40 THEN 2 ELSE 0 END AS lv FROM c), d(lv, level, tg, tb, tm) AS (VALUES {_PROT})
 SELECT {_I}, CAST(protocol AS BIGINT) AS protocol,
 CASE flag WHEN 'A' THEN 'r2SCAN-3c' WHEN 'N' THEN 'GFN2-xTB' ELSE 'B3LYP' END AS functional,
 CASE flag WHEN 'A' THEN 'def2-mTZVPP' WHEN 'N' THEN '' ELSE '6-31G*' END AS basis, 'orca' AS calculator,
 level, {rs('CASE WHEN protocol = 1 THEN 0.75e0 ELSE tg END', 8)} AS thr_g, {rs('tb', 8)} AS thr_b,
 {rs('tm', 8)} AS thr_gmax, CAST(protocol % 3 + 1 AS BIGINT) AS mult, flag = 'A' AS opt,
 elapsed_s > 40 AS freq, false AS no_prune, false AS clustering, 1e0 AS freq_fact FROM s JOIN d USING (lv)""",
    "state_roundtrip": f"""WITH c AS ({RECORDS}) SELECT {_I}, CAST(protocol AS BIGINT) AS protocol,
 {rs('e', 10)} AS e, {rs('g_e', 8)} AS g_e, {rs('b', 8)} AS b,
 {rs('elapsed_s + CASE WHEN protocol = 2 THEN 1 ELSE 0 END', 4)} AS elapsed_s, flag FROM c""",
    "spectrum_sink_roundtrip": SPECTRA_ORACLES["default_spectrum"] + " WHERE protocol IN (0, 2)",
    "stream_records": f"""{_L} SELECT dialect, {_I}, 1 AS protocol, {rs('e', 8)} AS e, conf_id % 17 <> 0 AS terminated,
 conf_id % 5 <> 0 AS converged, 24 AS n_freq FROM l""",
}
