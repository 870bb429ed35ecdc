"""Registered queries over energies and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rotamera.constants import LEVEL_THRESHOLDS
from rotamera.functions.energy import effective_energy
from rotamera.operators import energy as E, records as R
from rotamera.operators.prune import duplicate_links, survivor_pairs
from rotamera.plans.refine import Step, refine, refine_step
from rotamera.plans.tools import K, above, above_sql, r, rs, weight_sql
from rotamera.plans.views import EVENTS, RECORDS, view
from rotamera.sources.protocols import parse_protocols

PROT = ["ensemble_id", "protocol"]
WINDOW = 0.5
THR_E, THR_B = 0.05, 2.0


def _levels(df):
    """Flags for the record view: A an optimisation, N frequencies, R a single point."""
    return df.withColumns({"opt": F.col("flag") == "A", "freq": F.col("flag") == "N"})


def energy_window_populations(spark, sf):
    """Per ensemble: the conformers within the window, their populations, the average."""
    return E.window_summary(view(spark, sf, "events"), WINDOW).select(
        "ensemble_id", "n_conf", r("e_av", 8).alias("e_av"), r("top_pop").alias("top_pop"),
        r("max_erel").alias("max_erel"))


def relative_energy(spark, sf):
    df = E.relative_energy(view(spark, sf, "events")).where("active")
    return df.select("ensemble_id", "conf_id", r("erel").alias("erel"))


def energy_window(spark, sf):
    df = E.energy_window(view(spark, sf, "events"), WINDOW)
    return df.select("ensemble_id", "conf_id", "active", r("rel_kcal").alias("rel_kcal"))


def prune_gate(spark, sf):
    skip = F.col("ensemble_id") % 4 == 0
    df = E.energy_window(view(spark, sf, "events"), WINDOW, skip=skip)
    return df.select("ensemble_id", "conf_id", "active")


def effective_energies(spark, sf):
    return view(spark, sf, "events").select(
        "ensemble_id", "conf_id", r(effective_energy("e", "g"), 8).alias("energy"))


def energy_rank(spark, sf):
    return E.energy_rank(view(spark, sf, "events")).select(
        "ensemble_id", "conf_id", F.col("energy_rank").cast("long").alias("energy_rank"))


def retention_by_ensemble(spark, sf):
    df = E.energy_window(view(spark, sf, "events").withColumn("was", F.col("active")), WINDOW / 4)
    return E.retention(df, F.col("was"), F.col("active")).select(
        "ensemble_id", "n_before", "n_after", r("retention").alias("retention"), "alert")


def boltzmann_strict(spark, sf):
    df = view(spark, sf, "events").where("active")
    df = df.withColumn("gm", F.when(F.col("ensemble_id") % 2 == 0, F.col("g")).otherwise(F.col("e")))
    return E.boltzmann(df, "gm").select("ensemble_id", "conf_id", r("erel").alias("erel"),
                                        r("pop").alias("pop"))


def boltzmann_skip_missing(spark, sf):
    df = view(spark, sf, "events").where("active")
    return E.boltzmann(df, "g", 350.0, skip_missing=True).select(
        "ensemble_id", "conf_id", r("erel").alias("erel"), r("pop").alias("pop"))


def weighted_average(spark, sf):
    df = E.boltzmann(view(spark, sf, "records"), "e", keys=PROT)
    return E.weighted_average(df, {"e_av": ("e", "pop")}, PROT).select(
        *PROT, "n_conf", above("e_av").alias("e_av"))


def _raw_records(spark, sf):
    df = view(spark, sf, "records")
    hole = F.col("conf_id") % 10 == 0
    return df.withColumns({
        "e": F.when(hole, F.lit(0.0)).otherwise(F.col("e")),
        "g": F.when(F.col("g_e").isNull(), F.lit(float("nan"))).otherwise(F.col("e") + F.col("g_e")),
        "b": F.coalesce("b", F.lit(0.0)), "m": F.col("elapsed_s") - 10,
        "zpve": F.lit(0.1), "h": F.lit(0.2), "s": F.lit(0.0001)})


def normalised_records(spark, sf):
    df = R.normalise_records(_raw_records(spark, sf))
    return df.select(*PROT, "conf_id", *[r(c, 10 if c in "eg" else 8).alias(c)
                                         for c in ("e", "g", "b", "m", "zpve", "h", "s", "g_e")])


def vector_norms(spark, sf):
    from rotamera.plans.views import frequencies
    from rotamera.functions.energy import vector_norm
    return frequencies(spark, sf).select("ensemble_id", "conf_id",
                                         r(vector_norm("b_vec")).alias("b"))


def latest_record(spark, sf):
    return R.latest_record(view(spark, sf, "records")).select(
        "ensemble_id", "conf_id", F.col("protocol").cast("long").alias("protocol"),
        r("e", 10).alias("e"), r("g_e", 8).alias("g_e"), "flag")


def pending_records(spark, sf):
    rec = view(spark, sf, "records")
    confs = rec.select("ensemble_id", "conf_id").distinct().withColumn(
        "active", F.col("conf_id") % 5 != 0)
    return R.pending(confs, rec, 3).select("ensemble_id", "conf_id")


def step_summary(spark, sf):
    df = view(spark, sf, "records").withColumn("active", F.col("flag") != "R")
    return E.step_summary(df).select(
        "ensemble_id", F.col("protocol").cast("long").alias("protocol"), "n_before", "n_after",
        r("elapsed_total_s", 4).alias("elapsed_total_s"),
        r("elapsed_mean_s", 4).alias("elapsed_mean_s"))


def record_status(spark, sf):
    df = _levels(view(spark, sf, "records")).withColumns({
        "terminated": F.col("conf_id") % 17 != 0, "converged": F.col("conf_id") % 5 != 0,
        "n_freq": F.when(F.col("g_e").isNull(), 0).otherwise(10)})
    return R.record_status(df, F.col("opt"), F.col("freq"), F.col("protocol") > 3).select(
        "ensemble_id", "conf_id", F.col("protocol").cast("long").alias("protocol"), "status",
        "active", "failed")


def thresholds_by_level(spark, sf):
    df = _levels(view(spark, sf, "records")).withColumns({
        "freq": F.col("freq") | (F.col("elapsed_s") > 40),
        "thr_g": F.when(F.col("protocol") == 1, F.lit(0.1)),
        "thr_b": F.lit(None).cast("double"), "thr_gmax": F.col("b") * 10})
    return R.thresholds_by_level(df).select(
        "ensemble_id", "conf_id", F.col("protocol").cast("long").alias("protocol"), "level",
        r("thr_g", 8).alias("thr_g"), r("thr_b", 8).alias("thr_b"),
        r("thr_gmax", 8).alias("thr_gmax"))


def _report_input(spark, sf):
    return view(spark, sf, "records").withColumns({
        "g": F.col("e") + F.col("g_e"), "h": F.col("g_e") + 0.05, "zpve": F.col("b") / 10 + 0.1})


def energy_report(spark, sf):
    rep = E.energy_report(_report_input(spark, sf), skip_missing=True)
    return rep.select("ensemble_id", "conf_id", F.col("protocol").cast("long").alias("protocol"),
                      *[r(f"pop_{b}").alias(f"pop_{b}") for b in E.BASES])


def _averages(spark, sf):
    return E.ensemble_averages(E.energy_report(_report_input(spark, sf), skip_missing=True))


def ensemble_averages(spark, sf):
    return _averages(spark, sf).select(
        "ensemble_id", F.col("protocol").cast("long").alias("protocol"), "n_conf",
        *[above(f"{b}_av").alias(f"{b}_av") for b in E.BASES])


def protocol_arithmetic(spark, sf):
    out = E.protocol_arithmetic(_averages(spark, sf), [(2, "-", 1), (4, "+", 3), (8, "-", 1)])
    return out.select("ensemble_id", "operation", "status",
                      *[r(f"{b}_kcal", 4).alias(f"{b}_kcal") for b in E.BASES])


def carry_thermal_correction(spark, sf):
    df = view(spark, sf, "records").withColumns({
        "own": F.col("g_e").isNotNull(), "zpve": F.col("g_e") * 2, "h": F.col("g_e") * 3,
        "s": F.col("g_e") / 100})
    out = R.carry_thermal_correction(df)
    return out.select("ensemble_id", "conf_id", F.col("protocol").cast("long").alias("protocol"),
                      *[r(c, 10).alias(c) for c in ("g", "g_e", "zpve", "h", "s")])


def lookback_vectors(spark, sf):
    df = view(spark, sf, "records").withColumns({
        "freq": F.when(F.col("g_e").isNull(), F.array().cast("array<double>"))
        .otherwise(F.array(F.col("g_e") * 1000)),
        "b_vec": F.when(F.col("b").isNotNull(), F.array("b", F.col("b") * 2, F.col("b") * 3))})
    return R.lookback_vectors(df).select(
        "ensemble_id", "conf_id", F.col("protocol").cast("long").alias("protocol"),
        r(F.element_at("freq", 1)).alias("freq_1"), r(F.col("b_vec")[0]).alias("b_1"),
        r(F.col("b_vec")[2]).alias("b_3"))


def _dedup_input(spark, sf):
    return view(spark, sf, "events").where("active").withColumn("m", F.col("b") / 3)


def _links(df):
    return duplicate_links(df, THR_E, THR_B, ref_ok=F.col("b") != 1)


def greedy_dedup(spark, sf):
    from rotamera.operators.prune import greedy_dedup as dedup
    df = dedup(view(spark, sf, "events"), THR_E, THR_B, ref_ok=F.col("b") != 1)
    return df.select("ensemble_id", "conf_id", "active", "deactivated_by")


def dedup_lineage(spark, sf):
    return _links(_dedup_input(spark, sf)).select("ensemble_id", "conf_id", "deactivated_by")


def similar_pairs(spark, sf):
    df = _dedup_input(spark, sf)
    pairs = survivor_pairs(df, _links(df), THR_E, THR_B, ref_ok=F.col("b") != 1)
    return pairs.select("ensemble_id", "ref_id", "check_id", r("delta_e").alias("delta_e"),
                        r("delta_b").alias("delta_b"), r("delta_m").alias("delta_m"))


def refined_populations(spark, sf):
    """A whole step: window, duplicate removal, populations of the survivors."""
    df = view(spark, sf, "events")
    records = df.select("ensemble_id", "conf_id", F.lit(0).alias("protocol"), "e", "g", "b")
    done = refine_step(df.select("ensemble_id", "conf_id", "active"), records,
                       Step(0, THR_E, THR_B, WINDOW))
    return done.records.select("ensemble_id", "conf_id", r("erel").alias("erel"),
                               r("pop").alias("pop"))


# one protocol file per ensemble: thresholds of its own, some without pruning, some without step 1
_FILES = """SELECT ensemble_id, to_json(map_from_entries(filter(array(
  struct('0' AS key, named_struct('functional', 'a', 'thrG', 0.02D + ensemble_id % 4 / 100, 'thrB',
   1D + ensemble_id % 3, 'thrGMAX', 0.3D + ensemble_id % 5 / 10, 'no_prune', ensemble_id % 7 = 0) AS value),
  CASE WHEN ensemble_id % 3 <> 0 THEN struct('1' AS key, named_struct('functional', 'b', 'thrG',
   0.1D + ensemble_id % 5 / 50, 'thrB', 2D + ensemble_id % 4, 'thrGMAX', 0.2D + ensemble_id % 2 / 10,
   'no_prune', ensemble_id % 11 = 0) AS value) END), x -> x IS NOT NULL))) AS value
 FROM (SELECT DISTINCT ensemble_id FROM {c})"""
# a second calculation of most conformers
_SECOND = """SELECT ensemble_id, conf_id, e + conf_id * 37 % 101 * 1e-6D AS e,
 CASE WHEN conf_id % 4 <> 0 THEN e + conf_id * 53 % 97 * 1e-6D END AS g,
 CASE WHEN conf_id % 9 = 0 THEN 1D ELSE b + conf_id % 5 * 0.3D END AS b FROM {c} WHERE conf_id % 6 <> 0"""


def refined_by_protocol(spark, sf):
    """Two steps of one protocol per ensemble, all ensembles together."""
    c = view(spark, sf, "events")
    protocols = parse_protocols(spark.sql(_FILES, c=c))
    records = c.select("ensemble_id", "conf_id", F.lit(0).alias("protocol"), "e", "g", "b").unionByName(
        spark.sql(_SECOND, c=c).withColumn("protocol", F.lit(1)))
    done = refine(c.select("ensemble_id", "conf_id", "active"), records, protocols)
    pops = done.records.groupBy("ensemble_id", "conf_id").agg(*[
        F.max(F.when(F.col("protocol") == p, F.col("pop"))).alias(f"pop_{p}") for p in (0, 1)])
    return done.conformers.join(pops, ["ensemble_id", "conf_id"], "left").select(
        "ensemble_id", "conf_id", "active", "deactivated_by", r("pop_0").alias("pop_0"), r("pop_1").alias("pop_1"))


QUERIES = {f.__name__: f for f in (
    energy_window_populations, relative_energy, energy_window, prune_gate, effective_energies,
    energy_rank, retention_by_ensemble, boltzmann_strict, boltzmann_skip_missing,
    weighted_average, normalised_records, vector_norms, latest_record, pending_records,
    step_summary, record_status, thresholds_by_level, energy_report, ensemble_averages,
    protocol_arithmetic, carry_thermal_correction, lookback_vectors, greedy_dedup,
    dedup_lineage, similar_pairs, refined_populations, refined_by_protocol)}

# --- oracles ------------------------------------------------------------------

_C = f"WITH c AS ({EVENTS})"
_R = f"WITH c AS ({RECORDS})"
_EFF = f"""{_C}, w AS (SELECT *, coalesce(g, e) AS eff,
 (coalesce(g, e) - min(CASE WHEN active THEN coalesce(g, e) END) OVER (PARTITION BY ensemble_id))*{K}
 AS rel FROM c)"""


def _boltz(src: str, e: str, keys: str, temperature: str = "298.15e0", strict: bool = True) -> str:
    """Subquery adding erel and pop to ``src``."""
    gate = f"count({e}) OVER (PARTITION BY {keys}) = count(*) OVER (PARTITION BY {keys})"
    rel = f"({e} - min({e}) OVER (PARTITION BY {keys}))*{K}"
    rel = f"CASE WHEN {gate} THEN {rel} END" if strict else rel
    return f"""(SELECT *, wt / sum(wt) OVER (PARTITION BY {keys}) * 100 AS pop FROM
 (SELECT *, {weight_sql('erel', temperature)} AS wt FROM (SELECT *, {rel} AS erel FROM {src})))"""


_REPORT = f"""{_R}, s AS (SELECT *, e AS be, e + b/10 + 0.1e0 AS bz, e + g_e + 0.05e0 AS bh,
 e + g_e AS bg FROM c),
 p1 AS (SELECT * EXCLUDE (wt, erel, pop), pop AS pe FROM {_boltz('s', 'be', 'ensemble_id, protocol', strict=False)}),
 p2 AS (SELECT * EXCLUDE (wt, erel, pop), pop AS pz FROM {_boltz('p1', 'bz', 'ensemble_id, protocol', strict=False)}),
 p3 AS (SELECT * EXCLUDE (wt, erel, pop), pop AS ph FROM {_boltz('p2', 'bh', 'ensemble_id, protocol', strict=False)}),
 p4 AS (SELECT * EXCLUDE (wt, erel, pop), pop AS pg FROM {_boltz('p3', 'bg', 'ensemble_id, protocol', strict=False)}),
 av AS (SELECT ensemble_id, protocol, count(*) AS n_conf, sum(be*pe/100) AS e_av,
  sum(bz*pz/100) AS ezpve_av, sum(bh*ph/100) AS h_av, sum(bg*pg/100) AS g_av
  FROM p4 GROUP BY ensemble_id, protocol)"""

_ARITH = " UNION ALL ".join(
    f"""SELECT k.ensemble_id, '{a} {op} {b}' AS operation,
 CASE WHEN x.ensemble_id IS NULL OR y.ensemble_id IS NULL THEN 'missing' ELSE 'ok' END AS status,
 {', '.join(f"{rs(f'(x.{c}_av {op} y.{c}_av)*{K}', 4)} AS {c}_kcal" for c in E.BASES)}
 FROM (SELECT DISTINCT ensemble_id FROM av) k
 LEFT JOIN (SELECT * FROM av WHERE protocol = {a}) x ON x.ensemble_id = k.ensemble_id
 LEFT JOIN (SELECT * FROM av WHERE protocol = {b}) y ON y.ensemble_id = k.ensemble_id"""
    for a, op, b in ((2, "-", 1), (4, "+", 3), (8, "-", 1)))

# greedy removal, one conformer of every ensemble per recursion step
_GREEDY = f"""WITH RECURSIVE c AS ({EVENTS}),
 o AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id ORDER BY conf_id) AS rn
  FROM c WHERE active),
 step AS (
  SELECT ensemble_id, 0::BIGINT AS rn, CAST(NULL AS BIGINT) AS conf_id,
   CAST(NULL AS BIGINT) AS by_id, CAST([] AS STRUCT(id BIGINT, e DOUBLE, b DOUBLE)[]) AS kept
  FROM (SELECT DISTINCT ensemble_id FROM o)
  UNION ALL
  SELECT q.ensemble_id, q.rn, q.conf_id, q.hit,
   CASE WHEN q.hit IS NULL AND q.b <> 1
    THEN list_append(q.kept, {{'id': q.conf_id, 'e': q.e, 'b': q.b}}) ELSE q.kept END
  FROM (SELECT o.ensemble_id, o.rn, o.conf_id, o.e, o.b, s.kept,
    list_min(list_transform(list_filter(s.kept, lambda z: abs(z.e - o.e)*{K} < {THR_E}
      AND abs(z.b - o.b) < {THR_B}), lambda z: z.id)) AS hit
   FROM step s JOIN o ON o.ensemble_id = s.ensemble_id AND o.rn = s.rn + 1) q),
 links AS (SELECT ensemble_id, conf_id, by_id FROM step WHERE conf_id IS NOT NULL)"""

ORACLES = {
    "energy_window_populations": f"""{_EFF}, k AS (SELECT * FROM w WHERE active AND rel <= {WINDOW}),
 p AS (SELECT * FROM {_boltz('k', 'eff', 'ensemble_id')})
 SELECT ensemble_id, count(*) AS n_conf, {rs('sum(eff*pop/100)', 8)} AS e_av,
 {rs('max(pop)')} AS top_pop, {rs('max(erel)')} AS max_erel FROM p GROUP BY ensemble_id""",
    "relative_energy": f"""{_EFF} SELECT ensemble_id, conf_id, {rs('rel')} AS erel FROM w WHERE active""",
    "energy_window": f"""{_EFF} SELECT ensemble_id, conf_id, active AND rel <= {WINDOW} AS active,
 CASE WHEN active THEN {rs('rel')} END AS rel_kcal FROM w""",
    "prune_gate": f"""{_EFF} SELECT ensemble_id, conf_id,
 active AND (rel <= {WINDOW} OR ensemble_id % 4 = 0) AS active FROM w""",
    "effective_energies": f"{_C} SELECT ensemble_id, conf_id, {rs('coalesce(g, e)', 8)} AS energy FROM c",
    "energy_rank": f"""{_C} SELECT ensemble_id, conf_id, row_number() OVER (PARTITION BY ensemble_id
 ORDER BY active DESC, coalesce(g, e) ASC, conf_id) AS energy_rank FROM c""",
    "retention_by_ensemble": f"""{_EFF}, n AS (SELECT ensemble_id, count(*) FILTER (active) AS n_before,
 count(*) FILTER (active AND rel <= {WINDOW / 4}) AS n_after FROM w GROUP BY ensemble_id)
 SELECT ensemble_id, n_before, n_after,
 {rs('CASE WHEN n_before > 0 THEN n_after / n_before ELSE 1e0 END')} AS retention,
 (CASE WHEN n_before > 0 THEN n_after / n_before ELSE 1e0 END) < 0.2 AS alert FROM n""",
    "boltzmann_strict": f"""{_C}, s AS (SELECT *, CASE WHEN ensemble_id % 2 = 0 THEN g ELSE e END AS gm
 FROM c WHERE active) SELECT ensemble_id, conf_id, {rs('erel')} AS erel, {rs('pop')} AS pop
 FROM {_boltz('s', 'gm', 'ensemble_id')}""",
    "boltzmann_skip_missing": f"""{_C}, s AS (SELECT * FROM c WHERE active)
 SELECT ensemble_id, conf_id, {rs('erel')} AS erel, {rs('pop')} AS pop
 FROM {_boltz('s', 'g', 'ensemble_id', '350e0', strict=False)}""",
    "weighted_average": f"""{_R} SELECT ensemble_id, protocol, count(*) AS n_conf,
 {above_sql('sum(e*pop/100)')} AS e_av FROM {_boltz('c', 'e', 'ensemble_id, protocol')}
 GROUP BY ensemble_id, protocol""",
    "normalised_records": f"""{_R}, n AS (SELECT *, CASE WHEN conf_id % 10 = 0 THEN 0e0 ELSE e END AS e2 FROM c)
 SELECT ensemble_id, protocol, conf_id, {rs('nullif(e2, 0)', 10)} AS e, {rs('e + g_e', 10)} AS g,
 {rs('coalesce(nullif(b, 0), 1e0)', 8)} AS b,
 {rs('coalesce(nullif(elapsed_s - 10, 0), 1e0)', 8)} AS m,
 CASE WHEN g_e IS NOT NULL THEN 0.1e0 END AS zpve, CASE WHEN g_e IS NOT NULL THEN 0.2e0 END AS h,
 CASE WHEN g_e IS NOT NULL THEN 0.0001e0 END AS s,
 CASE WHEN e2 <> 0 THEN {rs('g_e', 8)} END AS g_e FROM n""",
    "vector_norms": f"""SELECT CAST(label AS BIGINT) AS ensemble_id, vec_id AS conf_id,
 {rs('sqrt(list_sum(list_transform(embedding[61:63], lambda x: pow(abs(CAST(x AS DOUBLE)) + 0.01, 2))))')} AS b
 FROM embeddings""",
    "latest_record": f"""{_R} SELECT ensemble_id, conf_id, protocol, {rs('e', 10)} AS e, {rs('g_e', 8)} AS g_e, flag
 FROM c QUALIFY row_number() OVER (PARTITION BY ensemble_id, conf_id ORDER BY protocol DESC) = 1""",
    "pending_records": f"""{_R} SELECT DISTINCT ensemble_id, conf_id FROM c
 WHERE conf_id % 5 <> 0 AND conf_id NOT IN (SELECT conf_id FROM c WHERE protocol = 3)""",
    "step_summary": f"""{_R} SELECT ensemble_id, protocol, count(*) AS n_before,
 count(*) FILTER (flag <> 'R') AS n_after, {rs('sum(elapsed_s)', 4)} AS elapsed_total_s,
 {rs('avg(elapsed_s)', 4)} AS elapsed_mean_s FROM c GROUP BY ensemble_id, protocol""",
    "record_status": f"""{_R}, s AS (SELECT *, CASE WHEN conf_id % 17 = 0 THEN 'crashed'
 WHEN flag = 'A' AND conf_id % 5 = 0 THEN 'not_converged'
 WHEN flag = 'N' AND g_e IS NULL THEN 'no_frequencies' ELSE 'ok' END AS status FROM c)
 SELECT ensemble_id, conf_id, protocol, status, status = 'ok' AS active,
 status = 'no_frequencies' OR (status = 'not_converged' AND NOT protocol > 3) AS failed FROM s""",
    "thresholds_by_level": f"""{_R}, s AS (SELECT *, CASE flag WHEN 'A' THEN 1 ELSE 0 END
 + CASE WHEN flag = 'N' OR elapsed_s > 40 THEN 2 ELSE 0 END AS lv FROM c),
 d(lv, level, tg, tb, tm) AS (VALUES {', '.join(
        f"({i}, '{n}', {a!r}e0, {'%.17f' % b}::DOUBLE, {m!r}e0)"
        for i, (n, a, b, m) in enumerate(LEVEL_THRESHOLDS))})
 SELECT ensemble_id, conf_id, protocol, level,
 {rs('CASE WHEN protocol = 1 THEN 0.1e0 ELSE tg END', 8)} AS thr_g, {rs('tb', 8)} AS thr_b,
 {rs('coalesce(b*10, tm)', 8)} AS thr_gmax FROM s JOIN d USING (lv)""",
    "energy_report": f"""{_REPORT} SELECT ensemble_id, conf_id, protocol, {rs('pe')} AS pop_e,
 {rs('pz')} AS pop_ezpve, {rs('ph')} AS pop_h, {rs('pg')} AS pop_g FROM p4""",
    "ensemble_averages": f"""{_REPORT} SELECT ensemble_id, protocol, n_conf,
 {', '.join(f"{above_sql(f'{b}_av')} AS {b}_av" for b in E.BASES)} FROM av""",
    "protocol_arithmetic": f"{_REPORT} {_ARITH}",
    "carry_thermal_correction": f"""WITH RECURSIVE c AS ({RECORDS}),
 f AS (SELECT ensemble_id, conf_id, protocol, e, g_e FROM c),
 t AS (SELECT *, e + g_e AS g FROM f WHERE g_e IS NOT NULL
  UNION ALL SELECT f.ensemble_id, f.conf_id, f.protocol, f.e, t.g_e, f.e + t.g_e
  FROM t JOIN f ON f.conf_id = t.conf_id AND f.protocol = t.protocol + 1 AND f.g_e IS NULL)
 SELECT f.ensemble_id, f.conf_id, f.protocol, {rs('t.g', 10)} AS g, {rs('t.g_e', 10)} AS g_e,
 {rs('t.g_e*2', 10)} AS zpve, {rs('t.g_e*3', 10)} AS h, {rs('t.g_e/100', 10)} AS s
 FROM f LEFT JOIN t ON t.conf_id = f.conf_id AND t.protocol = f.protocol""",
    "lookback_vectors": f"""{_R} SELECT ensemble_id, conf_id, protocol,
 {rs('last_value(g_e IGNORE NULLS) OVER w * 1000')} AS freq_1,
 {rs('coalesce(last_value(b IGNORE NULLS) OVER w, 1e0)')} AS b_1,
 {rs('coalesce(last_value(b IGNORE NULLS) OVER w * 3, 1e0)')} AS b_3 FROM c
 WINDOW w AS (PARTITION BY conf_id ORDER BY protocol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "greedy_dedup": f"""{_GREEDY} SELECT c.ensemble_id, c.conf_id,
 c.active AND l.by_id IS NULL AS active, l.by_id AS deactivated_by FROM c
 LEFT JOIN links l ON l.ensemble_id = c.ensemble_id AND l.conf_id = c.conf_id""",
    "dedup_lineage": f"""{_GREEDY} SELECT ensemble_id, conf_id, by_id AS deactivated_by FROM links
 WHERE by_id IS NOT NULL""",
    "similar_pairs": f"""{_GREEDY}, k AS (SELECT o.* FROM o JOIN links l ON l.ensemble_id = o.ensemble_id
  AND l.conf_id = o.conf_id WHERE l.by_id IS NULL AND o.b <> 1)
 SELECT o.ensemble_id, k.conf_id AS ref_id, o.conf_id AS check_id,
 {rs(f'abs(o.e - k.e)*{K}')} AS delta_e, {rs('abs(o.b - k.b)')} AS delta_b,
 {rs('abs(o.b/3 - k.b/3)')} AS delta_m
 FROM o JOIN k ON k.ensemble_id = o.ensemble_id AND k.conf_id < o.conf_id
 AND abs(o.e - k.e)*{K} < {THR_E} AND abs(o.b - k.b) < {THR_B}""",
}

ORACLES["refined_populations"] = f"""{_GREEDY.replace('FROM c WHERE active)', f"""FROM
 (SELECT ensemble_id, conf_id, coalesce(g, e) AS e, b, (coalesce(g, e) - min(coalesce(g, e))
  OVER (PARTITION BY ensemble_id))*{K} AS rel FROM c WHERE active) WHERE rel <= {WINDOW})""")},
 s AS (SELECT o.ensemble_id, o.conf_id, o.e FROM o JOIN links l USING (ensemble_id, conf_id)
  WHERE l.by_id IS NULL)
 SELECT ensemble_id, conf_id, {rs('erel')} AS erel, {rs('pop')} AS pop FROM {_boltz('s', 'e', 'ensemble_id')}"""


def _greedy_sql(n: int, source: str) -> str:
    """Recursive removal as ``links{n}`` (ensemble_id, conf_id, by_id) from the rows of ``source``
    (ensemble_id, conf_id, e, b, ref, te, tb), one conformer of every ensemble per step."""
    return f"""o{n} AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id ORDER BY conf_id) AS rn FROM {source}),
 step{n} AS (
  SELECT ensemble_id, 0::BIGINT AS rn, CAST(NULL AS BIGINT) AS conf_id, CAST(NULL AS BIGINT) AS by_id,
   CAST([] AS STRUCT(id BIGINT, e DOUBLE, b DOUBLE)[]) AS kept FROM (SELECT DISTINCT ensemble_id FROM o{n})
  UNION ALL
  SELECT q.ensemble_id, q.rn, q.conf_id, q.hit, CASE WHEN q.hit IS NULL AND q.ref
   THEN list_append(q.kept, {{'id': q.conf_id, 'e': q.e, 'b': q.b}}) ELSE q.kept END
  FROM (SELECT o.ensemble_id, o.rn, o.conf_id, o.e, o.b, o.ref, s.kept,
    list_min(list_transform(list_filter(s.kept, lambda z: abs(z.e - o.e)*{K} < o.te AND abs(z.b - o.b) < o.tb),
     lambda z: z.id)) AS hit
   FROM step{n} s JOIN o{n} o ON o.ensemble_id = s.ensemble_id AND o.rn = s.rn + 1) q),
 links{n} AS (SELECT ensemble_id, conf_id, by_id FROM step{n} WHERE by_id IS NOT NULL)"""


def _window_sql(n: int, source: str, energy: str, ref: str, te: str, tb: str, tmax: str, skip: str) -> str:
    return f"""w{n} AS (SELECT *, {energy} AS eff, ({energy} - min(CASE WHEN active THEN {energy} END)
  OVER (PARTITION BY ensemble_id))*{K} AS rel, {te} AS te, {tb} AS tb, {skip} AS skip FROM {source}),
 in{n} AS (SELECT *, active AND (skip OR rel <= {tmax}) AS inside FROM w{n}),
 cand{n} AS (SELECT ensemble_id, conf_id, eff AS e, b, {ref} AS ref, te, tb FROM in{n} WHERE inside AND NOT skip),
 {_greedy_sql(n, f'cand{n}')},
 after{n} AS (SELECT i.* EXCLUDE (active), i.inside AND l.by_id IS NULL AS active, l.by_id AS by_{n}
  FROM in{n} i LEFT JOIN links{n} l USING (ensemble_id, conf_id))"""


ORACLES["refined_by_protocol"] = f"""WITH RECURSIVE c AS ({EVENTS}),
 {_window_sql(0, 'c', 'coalesce(g, e)', 'b <> 1', '0.02e0 + ensemble_id % 4 / 100e0', '1e0 + ensemble_id % 3',
              '0.3e0 + ensemble_id % 5 / 10e0', 'ensemble_id % 7 = 0')},
 second AS ({_SECOND.replace('{c}', 'c').replace('1e-6D', '1e-6').replace('1D', '1e0').replace('0.3D', '0.3e0')}),
 met AS (SELECT a.ensemble_id, a.conf_id, a.active, a.by_0, coalesce(s.g, s.e, a.eff) AS eff1,
  coalesce(s.b, a.b) AS b, s.b AS b_now, s.conf_id IS NOT NULL AS has FROM after0 a
  LEFT JOIN second s USING (ensemble_id, conf_id)),
 {_window_sql(1, "met", 'eff1', 'coalesce(b_now <> 1, true)', '0.1e0 + ensemble_id % 5 / 50e0', '2e0 + ensemble_id % 4',
              '0.2e0 + ensemble_id % 2 / 10e0', 'ensemble_id % 11 = 0 OR ensemble_id % 3 = 0')},
 p0 AS (SELECT ensemble_id, conf_id, pop FROM {_boltz('(SELECT ensemble_id, conf_id, eff AS x FROM after0 WHERE active)', 'x', 'ensemble_id')}),
 p1 AS (SELECT ensemble_id, conf_id, pop FROM {_boltz('(SELECT ensemble_id, conf_id, eff AS x FROM after1 WHERE active AND has AND ensemble_id % 3 <> 0)', 'x', 'ensemble_id')})
 SELECT a.ensemble_id, a.conf_id, a.active, coalesce(a.by_1, a.by_0) AS deactivated_by,
 {rs('p0.pop')} AS pop_0, {rs('p1.pop')} AS pop_1 FROM after1 a
 LEFT JOIN p0 USING (ensemble_id, conf_id) LEFT JOIN p1 USING (ensemble_id, conf_id)"""
