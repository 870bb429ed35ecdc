"""Registered queries over line lists, spectra and measured curves. The line lists and the grids of
10,000 points are whole, and every point is compared. ``fit_shift_fwhm`` has 100 points and a shorter search,
as its SQL does; ``fit_shift_fwhm_full`` is the fit with the operator's own grid and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rotamera.constants import FWHM_TO_SIGMA, GRAPH_DEFAULTS, NM_EV
from rotamera.operators import energy as E, spectra as S
from rotamera.operators.grouping import attach_stats, lookup
from rotamera.plans.tools import K, r, rs, weight_sql
from rotamera.plans.views import CURVES, PEAK_RECORDS, PEAKS, view
from rotamera.sources.protocols import parse_protocols

N = S.GRID
PART = N // 50, N * 9 // 10        # of the grid, where a range is asked for
SPEC = S.SPECTRUM


def _records(spark, sf):
    rec = view(spark, sf, "peak_records").where("active")
    return E.boltzmann(rec, "e", keys=["ensemble_id", "protocol"])


def _lines(spark, sf, **kw):
    return S.weighted_peaks(view(spark, sf, "peaks"), _records(spark, sf), **kw)


def _out(df, digits=6):
    return df.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                     F.col("i").cast("long").alias("i"), r("x", 8).alias("x"),
                     r("y", digits).alias("y"))


def weighted_peaks(spark, sf):
    return _lines(spark, sf, invert=True).select(
        "ensemble_id", "conf_id", "protocol", "graph_type", "line_no", r("x").alias("x"),
        r("w").alias("w"))


def population_from_other_step(spark, sf):
    return _lines(spark, sf, population_from=0).select(
        "ensemble_id", "conf_id", "protocol", "graph_type", "line_no", r("w").alias("w"))


_STEPS_READ = """{"0": {"functional": "a"}, "1": {"functional": "b", "read_population": "0"},
 "2": {"functional": "c", "read_population": "1"}}"""


def population_by_protocol(spark, sf):
    """Lines of each step under the populations that its protocol entry names."""
    docs = view(spark, sf, "peaks").select("ensemble_id").distinct().withColumn("value", F.lit(_STEPS_READ))
    steps = parse_protocols(docs)
    return _lines(spark, sf, population_from=steps).select(
        "ensemble_id", "conf_id", "protocol", "graph_type", "line_no", r("w").alias("w"))


def has_peaks(spark, sf):
    return S.has_peaks(view(spark, sf, "peaks"), view(spark, sf, "peak_records")).select(
        "ensemble_id", "conf_id", "protocol", "graph_type")


def pooled_peaks(spark, sf):
    """The pooled line list of each spectrum, summed up."""
    return (_lines(spark, sf).groupBy(*SPEC).agg(
        F.count(F.lit(1)).alias("n_lines"), r(F.sum("w"), 5).alias("total"),
        r(F.sum(F.col("w") * F.col("x")), 3).alias("moment")))


def ir_lorentz(spark, sf):
    lines = _lines(spark, sf).where(F.col("graph_type").isin("IR", "VCD"))
    return _out(S.convolve(lines, N), 5)


def uv_gauss(spark, sf):
    lines = _lines(spark, sf).where(F.col("graph_type").isin("UV", "ECD"))
    return _out(S.convolve(lines, N), 5)


def default_spectrum(spark, sf):
    return _out(S.default_spectrum(_lines(spark, sf), N))


def max_abs_normalise(spark, sf):
    spec = S.convolve(_lines(spark, sf), N).withColumns({"lo": F.lit(PART[0]), "hi": F.lit(PART[1])})
    return _out(S.max_abs_normalise(spec, SPEC, "lo", "hi"), 5)


def spectrum_grid(spark, sf):
    """The grids of the types that have lines."""
    kinds = view(spark, sf, "peaks").select("graph_type").distinct()
    return S._grid_of(kinds, N).select("graph_type", F.col("i").cast("long").alias("i"),
                                       r("gx", 8).alias("x"))


def nm_to_ev(spark, sf):
    return S.reference_units(view(spark, sf, "curves")).select(
        "graph_type", r("x", 8).alias("x"), r("y").alias("y"))


def measured_curve(spark, sf):
    """A measured curve scaled to a largest |y| of 1, before any change of units."""
    df = attach_stats(view(spark, sf, "curves"), ["graph_type"], top=F.max(F.abs("y")))
    return df.select("graph_type", "x", r(F.col("y") / F.col("top")).alias("y"))


def _reference(spark, sf, n=N, interest=None):
    return S.reference_on_grid(view(spark, sf, "curves"), n, interest=interest)


def reference_on_grid(spark, sf):
    return _reference(spark, sf).select(
        "graph_type", F.col("i").cast("long").alias("i"), r("x", 8).alias("x"), r("y").alias("y"))


def spectrum_bounds(spark, sf):
    return (_reference(spark, sf).where("i = 0")
            .select("graph_type", F.col("lo").cast("long").alias("lo"),
                    F.col("hi").cast("long").alias("hi")))


def weight_function(spark, sf):
    interest = {"vibro": True, "electro": (5.0, 4.5)}
    return _reference(spark, sf, interest=interest).select(
        "graph_type", F.col("i").cast("long").alias("i"), r("weight").alias("weight"))


def weight_function_flat(spark, sf):
    return _reference(spark, sf).select(
        "graph_type", F.col("i").cast("long").alias("i"), r("weight").alias("weight"))


def _bounded_spectrum(spark, sf, ref):
    spec = S.convolve(_lines(spark, sf), N)
    spec = lookup(spec, ref.where("i = 0").select("graph_type", "lo", "hi"), ["graph_type"])
    return S.max_abs_normalise(spec, SPEC, "lo", "hi").drop("lo", "hi")


def similarity(spark, sf):
    ref = _reference(spark, sf, interest=True)
    out = S.similarity(_bounded_spectrum(spark, sf, ref), ref)
    return out.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                      r("similarity", 5).alias("similarity"),
                      r("similarity_unweighted", 5).alias("similarity_unweighted"))


FIT_N, FIT_POINTS, FIT_PASSES = 100, 5, 2


def fit_shift_fwhm(spark, sf):
    ref = _reference(spark, sf, FIT_N)
    out = S.fit_shift_fwhm(_lines(spark, sf), ref, FIT_N, points=FIT_POINTS, passes=FIT_PASSES)
    return out.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                      r("shift", 5).alias("shift"), r("fwhm", 5).alias("fwhm"),
                      r("diversity", 6).alias("diversity"))


def fit_shift_fwhm_full(spark, sf):
    """The fit with the defaults of the operator: 10,000 points, 7 x 7 pairs, 6 passes."""
    out = S.fit_shift_fwhm(_lines(spark, sf), _reference(spark, sf, S.GRID))
    return out.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                      r("shift", 5).alias("shift"), r("fwhm", 5).alias("fwhm"),
                      r("diversity", 6).alias("diversity"))


def _scored(spectrum, ref):
    out = S.similarity(spectrum, ref)
    return out.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                      r("similarity", 5).alias("similarity"),
                      r("similarity_unweighted", 5).alias("similarity_unweighted"))


def fitted_spectra(spark, sf):
    """Shift and width of every spectrum fitted to its measured curve, and how alike the two then are."""
    ref = _reference(spark, sf, interest=True)
    params, spectrum = S.fitted_spectrum(_lines(spark, sf), ref)
    score = S.similarity(spectrum, ref).select(*SPEC, "similarity", "similarity_unweighted")
    out = params.join(score, SPEC, "left")
    return out.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                      r("shift", 5).alias("shift"), r("fwhm", 5).alias("fwhm"), r("diversity", 6).alias("diversity"),
                      "converged", r("similarity", 5).alias("similarity"),
                      r("similarity_unweighted", 5).alias("similarity_unweighted"))


# given numbers, outside the defaults: nothing is left to search
GIVEN = {"shift": {"vibro": 0.97, "electro": 0.12}, "fwhm": {"vibro": 14.0, "electro": 0.31}}


def spectra_with_curves(spark, sf):
    """Spectra of all steps under a given shift and width, against the measured curves."""
    ref = _reference(spark, sf, interest=True)
    return _scored(S.spectra(view(spark, sf, "peaks"), _records(spark, sf), ref, **GIVEN), ref)


def respectra_with_curves(spark, sf):
    """Two steps anew at another temperature, against the measured curves."""
    ref = _reference(spark, sf, interest=True)
    rec = view(spark, sf, "peak_records")
    return _scored(S.respectra(view(spark, sf, "peaks"), rec, [0, 2], temperature=350.0, reference=ref, **GIVEN), ref)


def respectra(spark, sf):
    rec = view(spark, sf, "peak_records")
    return _out(S.respectra(view(spark, sf, "peaks"), rec, [0, 2], temperature=350.0, n=N))


def spectrum_convergence(spark, sf):
    out = S.spectrum_convergence(S.default_spectrum(_lines(spark, sf), N))
    return out.select("ensemble_id", "graph_type", F.col("protocol").cast("long").alias("protocol"),
                      F.col("previous").cast("long").alias("previous"),
                      r("diversity").alias("diversity"))


def overlay(spark, sf):
    ref = _reference(spark, sf)
    spec = S.load_spectra(S.default_spectrum(_lines(spark, sf), N), [1, 2])
    out = S.overlay(spec, ref)
    return out.select("ensemble_id", F.col("protocol").cast("long").alias("protocol"), "graph_type",
                      "series", F.col("i").cast("long").alias("i"), r("x", 8).alias("x"),
                      r("y").alias("y"), r("x_nm", 5).alias("x_nm"))


QUERIES = {f.__name__: f for f in (
    weighted_peaks, population_from_other_step, population_by_protocol, has_peaks, pooled_peaks, ir_lorentz, uv_gauss,
    default_spectrum, max_abs_normalise, spectrum_grid, nm_to_ev, measured_curve,
    reference_on_grid, spectrum_bounds, weight_function, weight_function_flat, similarity,
    fit_shift_fwhm, fit_shift_fwhm_full, fitted_spectra, spectra_with_curves, respectra,
    respectra_with_curves, spectrum_convergence, overlay)}

# --- oracles ------------------------------------------------------------------


def _defaults() -> str:
    rows = []
    for t, d in GRAPH_DEFAULTS.items():
        scale = 2 if t in ("VCD", "ECD") else 1
        nums = [d["x_start"], d["x_end"], d["shift"], d["fwhm"], *d["shift_range"],
                *d["fwhm_range"], *d["interest"]]
        rows.append(f"('{t}', {t in ('IR', 'VCD')}, {scale}e0, "
                    + ", ".join(f"{v!r}e0" for v in nums) + ")")
    return ("d(graph_type, vib, top, x0, x1, sh, fw, s0, s1, f0, f1, i0, i1) AS (VALUES "
            + ", ".join(rows) + ")")


def _base(temperature: str = "298.15e0") -> str:
    win = "WINDOW k AS (PARTITION BY ensemble_id, protocol)"
    return f"""WITH p AS ({PEAKS}), rc AS (SELECT * FROM ({PEAK_RECORDS}) WHERE active), {_defaults()},
 wt AS (SELECT *, {weight_sql(f'(e - min(e) OVER k)*{K}', temperature)} AS bw FROM rc {win}),
 b AS (SELECT *, bw / sum(bw) OVER k * 100 AS pop FROM wt {win}),
 l AS (SELECT p.*, p.y*b.pop AS w FROM p JOIN b USING (ensemble_id, conf_id, protocol))"""


def _grid(n: int = N) -> str:
    return (f"gr AS (SELECT d.*, i, x0 + i*((x1-x0)/{n - 1}e0) AS gx FROM d, "
            f"(SELECT unnest(range({n})) AS i))")


def _shape(x: str, sh: str, fw: str) -> str:
    sigma = f"({fw}*{FWHM_TO_SIGMA!r}e0)"
    return (f"CASE WHEN vib THEN {fw}*{fw}/({fw}*{fw} + 4*pow(gx - {x}*{sh}, 2)) "
            f"ELSE exp(-0.5e0*pow((gx - {x} - {sh})/{sigma}, 2))/({sigma}*sqrt(2*pi())) END")


_CONV = f"""{_grid()}, cv AS (SELECT ensemble_id, protocol, graph_type, i, gx AS x,
 sum(w*{_shape('l.x', 'sh', 'fw')}) AS y FROM l JOIN gr USING (graph_type) WHERE w <> 0
 GROUP BY ALL)"""
_NORM = """nm AS (SELECT * REPLACE (y / max(abs(y)) OVER (PARTITION BY ensemble_id, protocol, graph_type)
 AS y) FROM cv)"""


def _ref(n: int = N, units_only: bool = False) -> str:
    units = f"""cu AS (SELECT graph_type, CASE WHEN NOT vib AND min(x) OVER k > 20 THEN {NM_EV!r}e0/x
 ELSE x END AS x, y / max(abs(y)) OVER k AS y FROM ({CURVES}) JOIN d USING (graph_type)
 WINDOW k AS (PARTITION BY graph_type))"""
    if units_only:
        return units
    return f"""{units}, sg AS (SELECT *, lead(x) OVER k AS nx, lead(y) OVER k AS ny FROM cu
 WINDOW k AS (PARTITION BY graph_type ORDER BY x)),
 mm AS (SELECT graph_type, min(x) AS mn, max(x) AS mx FROM cu GROUP BY 1),
 iy AS (SELECT gr.*, mn, mx, CASE WHEN gx = mx THEN (SELECT y FROM cu WHERE cu.graph_type = gr.graph_type
   AND cu.x = mx) WHEN gx < mn OR gx > mx THEN 0 ELSE sg.y + (sg.ny-sg.y)/(sg.nx-sg.x)*(gx-sg.x) END AS y
  FROM gr JOIN mm USING (graph_type) LEFT JOIN sg ON sg.graph_type = gr.graph_type
  AND gx >= sg.x AND gx < sg.nx),
 rg AS (SELECT *, coalesce(min(CASE WHEN gx >= mn THEN i END) OVER k, 0) AS lo,
  coalesce(min(CASE WHEN gx > mx THEN i END) OVER k, 0) AS hi FROM iy WINDOW k AS (PARTITION BY graph_type))"""


def _weights(a: str, b: str) -> str:
    def bell(c, lim):
        return f"exp(-0.5e0*pow((gx - {c})/(0.1e0*abs({lim} - {c})), 2))"
    return f"""w0 AS (SELECT *, max(CASE WHEN i = lo THEN gx END) OVER k AS l1,
  max(CASE WHEN i = hi THEN gx END) OVER k AS l2, {a} AS ia, {b} AS ib FROM rg
  WINDOW k AS (PARTITION BY graph_type)),
 w1 AS (SELECT *, {bell('ia', 'l1')} AS g1, {bell('ib', 'l2')} AS g2 FROM w0),
 rw AS (SELECT *, CASE WHEN gx < l1 OR gx > l2 THEN 0e0 ELSE greatest(0.15e0,
  CASE WHEN gx >= ia AND gx <= ib THEN 1e0 WHEN l1 < gx AND gx < ia THEN g1 / max(g1) OVER k
  WHEN ib < gx AND gx < l2 THEN g2 / max(g2) OVER k ELSE 0e0 END) END AS weight
  FROM w1 WINDOW k AS (PARTITION BY graph_type))"""


_FLAT = """fw AS (SELECT r.*, CASE WHEN gx >= (SELECT gx FROM rg q WHERE q.graph_type = r.graph_type AND q.i = r.lo)
 AND gx <= (SELECT gx FROM rg q WHERE q.graph_type = r.graph_type AND q.i = r.hi) THEN 1e0 ELSE 0e0 END
 AS weight FROM rg r)"""

_SPEC_OUT = f"ensemble_id, protocol, graph_type, i, {rs('x', 8)} AS x"


def _fit_pass(name: str, cand: str) -> str:
    """Score every candidate of one pass; the best so far in ``<name>_best``."""
    return f"""{name}_y AS (SELECT ensemble_id, protocol, graph_type, cs, cf, i, top,
  sum(w*{_shape('l.x', 'cs', 'cf')}) AS y FROM l JOIN {cand} c USING (ensemble_id, protocol, graph_type)
  JOIN gr USING (graph_type) WHERE w <> 0 GROUP BY ALL),
 {name}_m AS (SELECT ensemble_id, protocol, graph_type, cs, cf, max(abs(y)) AS mx FROM {name}_y q
  JOIN (SELECT graph_type, i, lo, hi FROM fw) z USING (graph_type, i) WHERE i >= lo AND i < hi GROUP BY ALL),
 {name}_d AS (SELECT ensemble_id, protocol, graph_type, cs, cf,
  sqrt(sum(weight*pow(q.y/mx - z.y, 2))/{FIT_N}e0)/any_value(q.top) AS dv FROM {name}_y q
  JOIN {name}_m USING (ensemble_id, protocol, graph_type, cs, cf)
  JOIN (SELECT graph_type, i, y, weight FROM fw) z USING (graph_type, i) GROUP BY ALL)"""


def _first(cols: str) -> str:
    return f"row_number() OVER (PARTITION BY ensemble_id, protocol, graph_type ORDER BY {cols}) = 1"


_STEPS = f"(SELECT unnest(range({FIT_POINTS})) AS u)"
_FIT = f"""{_base()}, {_grid(FIT_N)}, {_ref(FIT_N)}, {_FLAT},
 gk AS (SELECT DISTINCT ensemble_id, protocol, graph_type FROM l WHERE w <> 0),
 c1 AS (SELECT ensemble_id, protocol, graph_type, s0 + a.u*((s1-s0)/{FIT_POINTS - 1}e0) AS cs,
  f0 + b.u*((f1-f0)/{FIT_POINTS - 1}e0) AS cf FROM gk JOIN d USING (graph_type), {_STEPS} a, {_STEPS} b),
 {_fit_pass('a', 'c1')},
 b1 AS (SELECT * FROM a_d QUALIFY {_first('dv, cs, cf')}),
 z1 AS (SELECT b1.*, greatest(cs - (s1-s0)/{FIT_POINTS - 1}e0, s0) AS n0, least(cs + (s1-s0)/{FIT_POINTS - 1}e0, s1) AS n1,
  greatest(cf - (f1-f0)/{FIT_POINTS - 1}e0, f0) AS m0, least(cf + (f1-f0)/{FIT_POINTS - 1}e0, f1) AS m1
  FROM b1 JOIN d USING (graph_type)),
 c2 AS (SELECT ensemble_id, protocol, graph_type, n0 + a.u*((n1-n0)/{FIT_POINTS - 1}e0) AS cs,
  m0 + b.u*((m1-m0)/{FIT_POINTS - 1}e0) AS cf FROM z1, {_STEPS} a, {_STEPS} b),
 {_fit_pass('b', 'c2')},
 al AS (SELECT * FROM b1 UNION ALL SELECT * FROM b_d)
 SELECT ensemble_id, protocol, graph_type, {rs('cs', 5)} AS shift, {rs('cf', 5)} AS fwhm,
 {rs('dv', 6)} AS diversity FROM al QUALIFY {_first('round(dv, 12), cs, cf')}"""

_SIMILAR = f"""sp AS (SELECT cv.*, rw.y AS ry, weight, lo, hi, top FROM cv JOIN rw USING (graph_type, i)
  WHERE i >= lo AND i < hi),
 sn AS (SELECT *, y / max(abs(y)) OVER (PARTITION BY ensemble_id, protocol, graph_type) AS yn FROM sp),
 dv AS (SELECT ensemble_id, protocol, graph_type, any_value(top) AS top,
  sqrt(sum(weight*pow(yn - ry, 2))/count(*))/any_value(top) AS a,
  sqrt(sum(pow(yn - ry, 2))/count(*))/any_value(top) AS b FROM sn GROUP BY ALL)
 SELECT ensemble_id, protocol, graph_type, {rs('(top - a)/top*100', 5)} AS similarity,
 {rs('(top - b)/top*100', 5)} AS similarity_unweighted FROM dv"""
_GIVEN_CONV = _CONV.replace(_shape('l.x', 'sh', 'fw'), _shape('l.x', *(
    f"(CASE WHEN vib THEN {GIVEN[k]['vibro']!r}e0 ELSE {GIVEN[k]['electro']!r}e0 END)" for k in ("shift", "fwhm"))))

ORACLES = {
    "spectra_with_curves": f"{_base()}, {_GIVEN_CONV}, {_ref()}, {_weights('i0', 'i1')}, {_SIMILAR}",
    "respectra_with_curves": f"""{_base('350e0')}, {_GIVEN_CONV}, {_ref()}, {_weights('i0', 'i1')}, {_SIMILAR}
 WHERE protocol IN (0, 2)""",
    "weighted_peaks": f"""{_base()} SELECT ensemble_id, conf_id, protocol, graph_type, line_no, {rs('x')} AS x,
 {rs("w * CASE WHEN graph_type IN ('VCD', 'ECD') THEN -1 ELSE 1 END")} AS w FROM l""",
    "population_from_other_step": f"""{_base()} SELECT ensemble_id, conf_id, p.protocol, graph_type, line_no,
 {rs('p.y*b.pop')} AS w FROM p JOIN (SELECT ensemble_id, conf_id, pop FROM b WHERE protocol = 0) b
 USING (ensemble_id, conf_id)""",
    "population_by_protocol": f"""{_base()} SELECT ensemble_id, conf_id, p.protocol, graph_type, line_no,
 {rs('p.y*b.pop')} AS w FROM p JOIN (SELECT ensemble_id, conf_id, protocol, pop FROM b) b
 USING (ensemble_id, conf_id) WHERE b.protocol = CASE p.protocol WHEN 0 THEN 0 ELSE p.protocol - 1 END""",
    "has_peaks": f"""{_base()} SELECT DISTINCT ensemble_id, conf_id, protocol, graph_type FROM l""",
    "pooled_peaks": f"""{_base()} SELECT ensemble_id, protocol, graph_type, count(*) AS n_lines,
 {rs('sum(w)', 5)} AS total, {rs('sum(w*x)', 3)} AS moment FROM l GROUP BY ALL""",
    "ir_lorentz": f"""{_base()}, {_CONV} SELECT {_SPEC_OUT}, {rs('y', 5)} AS y FROM cv
 WHERE graph_type IN ('IR', 'VCD')""",
    "uv_gauss": f"""{_base()}, {_CONV} SELECT {_SPEC_OUT}, {rs('y', 5)} AS y FROM cv
 WHERE graph_type IN ('UV', 'ECD')""",
    "default_spectrum": f"{_base()}, {_CONV}, {_NORM} SELECT {_SPEC_OUT}, {rs('y')} AS y FROM nm",
    "max_abs_normalise": f"""{_base()}, {_CONV} SELECT {_SPEC_OUT},
 {rs(f'y / max(CASE WHEN i >= {PART[0]} AND i < {PART[1]} THEN abs(y) END) OVER (PARTITION BY ensemble_id, protocol, graph_type)', 5)}
 AS y FROM cv""",
    "spectrum_grid": f"""WITH {_defaults()}, {_grid()} SELECT graph_type, i, {rs('gx', 8)} AS x FROM gr""",
    "nm_to_ev": f"""WITH {_defaults()}, {_ref(units_only=True)} SELECT graph_type, {rs('x', 8)} AS x,
 {rs('y')} AS y FROM cu""",
    "measured_curve": f"""SELECT graph_type, x,
 {rs('y / max(abs(y)) OVER (PARTITION BY graph_type)')} AS y FROM ({CURVES})""",
    "reference_on_grid": f"""WITH {_defaults()}, {_grid()}, {_ref()} SELECT graph_type, i,
 {rs('gx', 8)} AS x, {rs('y')} AS y FROM rg""",
    "spectrum_bounds": f"""WITH {_defaults()}, {_grid()}, {_ref()}
 SELECT DISTINCT graph_type, lo, hi FROM rg""",
    "weight_function": f"""WITH {_defaults()}, {_grid()}, {_ref()},
 {_weights('CASE WHEN vib THEN i0 ELSE 4.5e0 END', 'CASE WHEN vib THEN i1 ELSE 5e0 END')}
 SELECT graph_type, i, {rs('weight')} AS weight FROM rw""",
    "weight_function_flat": f"""WITH {_defaults()}, {_grid()}, {_ref()}, {_FLAT}
 SELECT graph_type, i, {rs('weight')} AS weight FROM fw""",
    "similarity": f"{_base()}, {_CONV}, {_ref()}, {_weights('i0', 'i1')}, {_SIMILAR}",
    "fit_shift_fwhm": _FIT,
    "respectra": f"""{_base('350e0')}, {_CONV}, {_NORM} SELECT {_SPEC_OUT}, {rs('y')} AS y FROM nm
 WHERE protocol IN (0, 2)""",
    "spectrum_convergence": f"""{_base()}, {_CONV}, {_NORM} SELECT a.ensemble_id, a.graph_type, a.protocol,
 b.protocol AS previous, {rs('sqrt(sum(pow(a.y - b.y, 2))/count(*))/any_value(d.top)')} AS diversity
 FROM nm a JOIN nm b ON a.ensemble_id = b.ensemble_id AND a.graph_type = b.graph_type
 AND a.protocol = b.protocol + 1 AND a.i = b.i JOIN d ON d.graph_type = a.graph_type GROUP BY ALL""",
    "overlay": f"""{_base()}, {_CONV}, {_NORM}, {_ref()},
 bd AS (SELECT graph_type, i, lo, hi FROM rg),
 mxs AS (SELECT nm.*, max(CASE WHEN i >= lo AND i < hi THEN abs(y) END)
  OVER (PARTITION BY ensemble_id, protocol, graph_type) AS mt FROM nm JOIN bd USING (graph_type, i)
  WHERE protocol IN (1, 2)),
 un AS (SELECT ensemble_id, protocol, graph_type, 'Protocol ' || protocol AS series, i, x,
  CASE WHEN mt > 1 THEN y/mt ELSE y END AS y FROM mxs
  UNION ALL SELECT NULL, NULL, graph_type, 'Experimental', i, gx, y FROM rg WHERE i >= lo AND i < hi)
 SELECT ensemble_id, protocol, graph_type, series, i, {rs('x', 8)} AS x, {rs('y')} AS y,
 CASE WHEN graph_type IN ('UV', 'ECD') THEN {rs(f'{NM_EV!r}e0/x', 5)} END AS x_nm FROM un""",
}
