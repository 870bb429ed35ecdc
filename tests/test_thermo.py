"""Closed forms against plain NumPy written from the formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotamera import constants as K
from rotamera.functions import thermo as H
from rotamera.operators.thermo import retemper

FREQ = np.array([-50.0, 12.0, 100.0, 200.0, 300.0, 3000.0])
B = np.array([10.0, 7.0, 3.0])


def by_hand(t, p, cut, alpha, linear, e=-100.0, mw=18.0, mult=2):
    nu = FREQ[FREQ > 0]
    hc, kb = K.PLANCK * K.LIGHT_SPEED_CM, K.BOLTZMANN
    d = 1 / (1 + (cut / nu) ** alpha)
    x = hc * nu / (kb * t)
    zpve = (hc * nu / 2).sum()
    u_vib = (d * hc * nu / np.expm1(x) + (1 - d) * kb * t / 2).sum()
    h = zpve + (1.5 + (1 if linear else 1.5) + 1) * kb * t + u_vib
    s_tr = kb * (2.5 + math.log((2 * math.pi * mw * kb * t / (1000 * K.AVOGADRO * K.PLANCK**2)) ** 1.5
                                * kb * t / (1000 * p)))
    th = hc * B / kb
    q = t / th[0] if linear else math.sqrt(math.pi * t**3 / th.prod())
    s_rot = kb * (math.log(q) + (1 if linear else 1.5))
    s_ho = kb * (x / np.expm1(x) - np.log(1 - np.exp(-x)))
    inertia = K.PLANCK / (B * K.LIGHT_SPEED_CM).mean()
    mu = K.PLANCK / (8 * math.pi**2 * nu * K.LIGHT_SPEED_CM)
    red = mu * inertia / (mu + inertia)
    s_fr = kb * (0.5 + 0.5 * np.log(8 * math.pi**3 * red * kb * t / K.PLANCK**2))
    s = s_tr + s_rot + (d * s_ho + (1 - d) * s_fr).sum() + kb * math.log(mult)
    j = K.JOULE_TO_HARTREE
    return dict(zpve=zpve * j, h=h * j, s=s * j, g=e + h * j - t * s * j)


@pytest.fixture()
def mol(spark):
    return spark.createDataFrame([(-100.0, FREQ.tolist(), 18.0, B.tolist(), 2)],
                                 "e double, freq array<double>, mass double, "
                                 "b_vec array<double>, mult int")


@pytest.mark.parametrize("c", [H.Conditions(), H.Conditions(400.0, 50.0, 60.0, 3, True)])
def test_gibbs(mol, c):
    want = by_hand(c.temperature, c.pressure, c.cutoff, c.alpha, c.linear)
    got = H.with_gibbs(mol, c=c).first()
    packed = mol.select(H.gibbs("e", "freq", "mass", "b_vec", "mult", c).alias("t")).first().t
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-10)
        assert packed[k] == pytest.approx(v, rel=1e-10)
    assert got.g == pytest.approx(got.e + got.h - c.temperature * got.s)


def test_damping(spark):
    row = spark.range(1).select(H.damp(F.lit(100.0), H.Conditions(alpha=1)).alias("a"),
                                H.damp(F.lit(1000.0), H.Conditions(cutoff=1.0, alpha=1)).alias("b")).first()
    assert row.a == 0.5 and row.b > 0.99


def test_no_modes_means_no_rotation_energy(spark):
    df = spark.createDataFrame([(-1.0, [-5.0], 18.0, [1.0, 1.0, 1.0], 1)],
                               "e double, freq array<double>, mass double, b_vec array<double>, mult int")
    r = H.with_gibbs(df).first()
    assert r.zpve == 0
    assert r.h == pytest.approx(2.5 * K.BOLTZMANN * K.TEMPERATURE * K.JOULE_TO_HARTREE)


def test_retemper_uses_only_populated_active_rows(spark):
    df = spark.createDataFrame([("a", c, 0, -100.0 + c / 1e4, FREQ.tolist() if c else [], B.tolist(), 18.0, 1,
                                 c != 3, None if c == 2 else 1.0) for c in range(5)],
                               "ensemble_id string, conf_id long, protocol int, e double, freq array<double>, "
                               "b_vec array<double>, mass double, mult int, active boolean, pop double")
    rows = retemper(df, [298.15, 400.0]).collect()
    assert {(r.conf_id, r.temperature) for r in rows} == {(c, t) for c in (0, 1, 4) for t in (298.15, 400.0)}
    for t in (298.15, 400.0):
        mine = [r for r in rows if r.temperature == t]
        assert sum(r.pop_e for r in mine) == pytest.approx(100)
        assert [r.pop_g for r in mine if r.conf_id == 0] == [None]
        assert sum(r.pop_g or 0 for r in mine) == pytest.approx(100)
