"""Registered queries over thermochemistry."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rotamera.constants import (AVOGADRO, BOLTZMANN, JOULE_TO_HARTREE, LIGHT_SPEED_CM, PLANCK)
from rotamera.functions import thermo as H
from rotamera.functions.energy import imaginary_modes as imaginary, real_modes, scaled_frequencies
from rotamera.operators.energy import BASES, ensemble_averages
from rotamera.operators.thermo import retemper
from rotamera.plans.tools import K, r, rs, weight_sql
from rotamera.plans.views import FREQUENCIES, frequencies

SCALE = 0.97
TEMPERATURES = (250.0, 298.15, 350.0)


def imaginary_modes(spark, sf):
    f = imaginary("freq")
    text = F.array_join(F.transform(f, lambda x: F.format_string("%.2f", x)), " ")
    return frequencies(spark, sf).select("ensemble_id", "conf_id",
                                         F.size(f).cast("long").alias("n_imaginary"),
                                         text.alias("imaginary"))


def scaled_real_modes(spark, sf):
    """The modes that enter thermochemistry: scaled, then only the positive ones."""
    df = frequencies(spark, sf).withColumn("m", real_modes(scaled_frequencies("freq", SCALE)))
    return df.select("ensemble_id", "conf_id", F.posexplode("m").alias("mode", "nu")).select(
        "ensemble_id", "conf_id", F.col("mode").cast("long").alias("mode"), r("nu").alias("nu"))


def thermo_vibrational(spark, sf):
    """Zero-point, thermal energies and entropies one by one."""
    df = frequencies(spark, sf).withColumn("m", real_modes("freq"))
    mh = 1000.0     # millihartree, and microhartree per kelvin below
    return df.select(
        "ensemble_id", "conf_id", r(H.zero_point(F.col("m")) * mh).alias("zpve"),
        r(H.translational_energy() * mh).alias("u_trans"),
        r(H.rotational_energy() * mh).alias("u_rot"),
        r(H.vibrational_energy(F.col("m")) * mh).alias("u_vib"),
        r(H.translational_entropy(F.col("mass")) * 1e6).alias("s_trans"),
        r(H.rotational_entropy(F.col("b_vec")) * 1e6).alias("s_rot"),
        r(H.vibrational_entropy(F.col("m"), H.mean_inertia(F.col("b_vec"))) * 1e6).alias("s_vib"),
        r(H.electronic_entropy(F.col("mult")) * 1e6).alias("s_el"))


def thermo_modes(spark, sf):
    """Damping, energy and the two entropies of each mode."""
    df = frequencies(spark, sf).select(
        "ensemble_id", "conf_id", H.mean_inertia(F.col("b_vec")).alias("inertia"),
        F.posexplode(real_modes("freq")).alias("mode", "nu"))
    nu = F.col("nu")
    return df.select(
        "ensemble_id", "conf_id", F.col("mode").cast("long").alias("mode"),
        r(H.damp(nu)).alias("damp"), r(H.mode_energy(nu) * 1e21).alias("energy"),
        r(H.mode_entropy_oscillator(nu) * 1e23).alias("s_oscillator"),
        r(H.mode_entropy_rotor(nu, F.col("inertia")) * 1e23).alias("s_rotor"))


def gibbs(spark, sf):
    df = H.with_gibbs(frequencies(spark, sf))
    return df.select("ensemble_id", "conf_id", r("g", 8).alias("g"), r("zpve", 8).alias("zpve"),
                     r("h", 8).alias("h"), r(F.col("s") * 1e6).alias("s"))


def gibbs_linear(spark, sf):
    c = H.Conditions(400.0, 200.0, 50.0, 3, True)
    df = H.with_gibbs(frequencies(spark, sf), c=c)
    return df.select("ensemble_id", "conf_id", r("g", 8).alias("g"), r("h", 8).alias("h"),
                     r(F.col("s") * 1e6).alias("s"))


def _scan(spark, sf):
    df = frequencies(spark, sf).withColumns({
        "protocol": F.lit(0), "active": F.col("conf_id") % 9 != 0,
        "pop": F.when(F.col("conf_id") % 13 != 0, 1.0)})
    return retemper(df, TEMPERATURES)


def temperature_scan(spark, sf):
    out = _scan(spark, sf)
    return out.select("ensemble_id", "conf_id", "temperature",
                      *[r(f"pop_{b}", 5).alias(f"pop_{b}") for b in BASES])


def temperature_averages(spark, sf):
    out = ensemble_averages(_scan(spark, sf), ["ensemble_id", "temperature"])
    return out.select("ensemble_id", "temperature", "n_conf",
                      *[r(f"{b}_av", 7).alias(f"{b}_av") for b in BASES])


QUERIES = {f.__name__: f for f in (
    imaginary_modes, scaled_real_modes, thermo_vibrational, thermo_modes, gibbs, gibbs_linear,
    temperature_scan, temperature_averages)}

# --- oracles ------------------------------------------------------------------

_HC, _KB, _J = f"{PLANCK * LIGHT_SPEED_CM!r}", f"{BOLTZMANN!r}", f"{JOULE_TO_HARTREE!r}"


def _fold(term: str, modes: str = "m") -> str:
    return f"coalesce(list_sum(list_transform({modes}, lambda x: {term})), 0e0)"


def _terms(t: str = "298.15e0", p: str = "101.325e0", cut: str = "100e0", alpha: str = "4e0",
           linear: bool = False) -> dict[str, str]:
    f = f"(x*{_HC}/({_KB}*{t}))"
    d = f"(1/(1+pow({cut}/x, {alpha})))"
    mode = f"(x*{_HC}*exp(-{f})/(1-exp(-{f})))"
    osc = f"({_KB}*({f}/(exp({f})-1) - ln(1-exp(-{f}))))"
    inertia = f"({PLANCK / LIGHT_SPEED_CM!r}*len(b_vec)/list_sum(b_vec))"
    mu = f"({PLANCK / (8 * math.pi**2 * LIGHT_SPEED_CM)!r}/x)"
    rotor = (f"({_KB}*(0.5e0+0.5e0*ln({mu}*{inertia}/({mu}+{inertia})*{t}*"
             f"{8 * math.pi**3 * BOLTZMANN / PLANCK**2!r})))")
    theta = f"{PLANCK * LIGHT_SPEED_CM / BOLTZMANN!r}"
    if linear:
        rot = f"({_KB}*(ln({t}/(b_vec[1]*{theta}))+1)*{_J})"
    else:
        rot = (f"({_KB}*(ln(sqrt(pi()*pow({t},3)/(b_vec[1]*{theta}*(b_vec[2]*{theta})"
               f"*(b_vec[3]*{theta}))))+1.5e0)*{_J})")
    return {
        "damp": d, "mode": mode, "osc": osc, "rotor": rotor,
        "zpve": f"({_fold('x')}*{0.5 * PLANCK * LIGHT_SPEED_CM * JOULE_TO_HARTREE!r})",
        "u_trans": f"(1.5e0*{_KB}*{t}*{_J})",
        "u_rot": f"({'1e0' if linear else '1.5e0'}*{_KB}*{t}*{_J})",
        "u_vib": f"({_fold(f'{d}*{mode} + (1-{d})*0.5e0*{_KB}*{t}')}*{_J})",
        "s_trans": (f"({_KB}*(2.5e0+ln(pow(2*pi()*mass*{_KB}*{t}/(1000*{AVOGADRO!r}*{PLANCK!r}"
                    f"*{PLANCK!r}), 1.5e0)*({_KB}*{t}/({p}*1000))))*{_J})"),
        "s_rot": rot,
        "s_vib": f"({_fold(f'{d}*{osc} + (1-{d})*{rotor}')}*{_J})",
        "s_el": f"({_KB}*ln(mult)*{_J})",
        "kt": f"({_KB}*{t}*{_J})",
    }


_F = f"""WITH f AS ({FREQUENCIES}),
 c AS (SELECT *, list_filter(freq, lambda x: x > 0) AS m FROM f)"""


def _gibbs_cte(name: str, src: str, t: str = "298.15e0", **kw) -> str:
    q = _terms(t, **kw)
    return f"""{name} AS (SELECT *, e + hh - {t}*ss AS gg FROM (SELECT *, {q['zpve']} AS zz,
 {q['zpve']} + {q['u_trans']} + CASE WHEN {q['zpve']} > 0 THEN {q['u_rot']} ELSE 0 END
  + {q['u_vib']} + {q['kt']} AS hh,
 {q['s_trans']} + {q['s_rot']} + {q['s_vib']} + {q['s_el']} AS ss FROM {src}))"""


def _pops(src: str) -> str:
    keys = "ensemble_id, temperature"
    cols = {"e": "e", "ezpve": "e + zz", "h": "e + hh", "g": "gg"}
    w = ", ".join(f"{weight_sql(f'(({c}) - min({c}) OVER k)*{K}', 'temperature')} AS w_{b}"
                  for b, c in cols.items())
    p = ", ".join(f"w_{b} / sum(w_{b}) OVER k * 100 AS p_{b}, {c} AS b_{b}"
                  for b, c in cols.items())
    win = f"WINDOW k AS (PARTITION BY {keys})"
    return f"(SELECT *, {p} FROM (SELECT *, {w} FROM {src} {win}) {win})"


_SCAN = f"""{_F}, u AS (SELECT c.*, t.temperature FROM c,
 (VALUES {', '.join(f'({t!r}e0)' for t in TEMPERATURES)}) t(temperature)
 WHERE conf_id % 9 <> 0 AND conf_id % 13 <> 0), {_gibbs_cte('s', 'u', 'temperature')},
 p AS (SELECT * FROM {_pops('s')})"""

_T = _terms()
ORACLES = {
    "imaginary_modes": f"""{_F} SELECT ensemble_id, conf_id,
 len(list_filter(freq, lambda x: x < 0)) AS n_imaginary,
 array_to_string(list_transform(list_filter(freq, lambda x: x < 0),
  lambda x: printf('%.2f', x)), ' ') AS imaginary FROM c""",
    "scaled_real_modes": f"""{_F}, s AS (SELECT ensemble_id, conf_id,
 list_filter(list_transform(freq, lambda x: x*{SCALE}e0), lambda x: x > 0) AS q FROM c)
 SELECT ensemble_id, conf_id, i AS mode, {rs('q[i+1]')} AS nu
 FROM s, LATERAL (SELECT unnest(range(len(q))) AS i)""",
    "thermo_vibrational": f"""{_F} SELECT ensemble_id, conf_id, {rs(_T['zpve'] + '*1000')} AS zpve,
 {rs(_T['u_trans'] + '*1000')} AS u_trans, {rs(_T['u_rot'] + '*1000')} AS u_rot,
 {rs(_T['u_vib'] + '*1000')} AS u_vib, {rs(_T['s_trans'] + '*1e6')} AS s_trans,
 {rs(_T['s_rot'] + '*1e6')} AS s_rot, {rs(_T['s_vib'] + '*1e6')} AS s_vib,
 {rs(_T['s_el'] + '*1e6')} AS s_el FROM c""",
    "thermo_modes": f"""{_F}, q AS (SELECT *, m[i+1] AS x FROM c, LATERAL (SELECT unnest(range(len(m))) AS i))
 SELECT ensemble_id, conf_id, i AS mode, {rs(_T['damp'])} AS damp, {rs(_T['mode'] + '*1e21')} AS energy,
 {rs(_T['osc'] + '*1e23')} AS s_oscillator, {rs(_T['rotor'] + '*1e23')} AS s_rotor FROM q""",
    "gibbs": f"""{_F}, {_gibbs_cte('s', 'c')} SELECT ensemble_id, conf_id, {rs('gg', 8)} AS g,
 {rs('zz', 8)} AS zpve, {rs('hh', 8)} AS h, {rs('ss*1e6')} AS s FROM s""",
    "gibbs_linear": f"""{_F}, {_gibbs_cte('s', 'c', '400e0', p='200e0', cut='50e0', alpha='3e0', linear=True)}
 SELECT ensemble_id, conf_id, {rs('gg', 8)} AS g, {rs('hh', 8)} AS h, {rs('ss*1e6')} AS s FROM s""",
    "temperature_scan": f"""{_SCAN} SELECT ensemble_id, conf_id, temperature,
 {', '.join(f"{rs(f'p_{b}', 5)} AS pop_{b}" for b in BASES)} FROM p""",
    "temperature_averages": f"""{_SCAN} SELECT ensemble_id, temperature, count(*) AS n_conf,
 {', '.join(f"{rs(f'sum(b_{b}*p_{b}/100)', 7)} AS {b}_av" for b in BASES)} FROM p
 GROUP BY ensemble_id, temperature""",
}
