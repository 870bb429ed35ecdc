import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotamera.constants import HARTREE_TO_KCAL
from rotamera.functions.energy import effective_energy
from rotamera.operators import energy as E, records as R

# energies printed for one ensemble of eleven, six of them inside the window
ENERGIES = [(2, -966.566566375643), (1, -966.566561842759), (3, -966.564915292485),
            (4, -966.564812715069), (5, -966.558330812902), (6, -966.558040083384)]


@pytest.fixture()
def six(spark):
    return spark.createDataFrame([("a", c, e, None, True) for c, e in ENERGIES],
                                 "ensemble_id string, conf_id long, e double, g double, active boolean")


def test_printed_populations_and_average(six):
    df = E.boltzmann(six, "e")
    pops = {r.conf_id: round(r["pop"], 2) for r in df.collect()}
    assert pops == {2: 43.01, 1: 42.80, 3: 7.48, 4: 6.71, 5: 0.01, 6: 0.01}
    avg = E.weighted_average(df, {"e_av": ("e", "pop")}).first()
    assert avg.e_av == pytest.approx(-966.5663223637399, abs=1e-9)


def test_populations_sum_to_hundred(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 11).alias("ensemble_id"),
        F.col("id").alias("conf_id"), (F.rand(1) / 100 - 5).alias("e"))
    sums = E.boltzmann(df, "e").groupBy("ensemble_id").agg(F.sum("pop").alias("s")).collect()
    assert all(abs(r.s - 100) < 1e-9 for r in sums)


def test_window_is_strict_and_keeps_the_boundary(spark):
    k = 1 / HARTREE_TO_KCAL
    df = spark.createDataFrame([("a", 1, -100.0, None, True), ("a", 2, -99.9, None, True),
                                ("a", 3, -100.0 + 4.9 * k, None, True), ("a", 4, -200.0, None, False),
                                ("a", 5, None, None, True), ("b", 1, 7.0, 6.0, True)],
                               "ensemble_id string, conf_id long, e double, g double, active boolean")
    got = {(r.ensemble_id, r.conf_id): r.active for r in E.energy_window(df, 5.0).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("a", 4): False,
                   ("a", 5): True, ("b", 1): True}


def test_strict_and_skipping_populations(spark):
    df = spark.createDataFrame([("a", 1, -1.0), ("a", 2, float("nan")), ("b", 1, -1.0)],
                               "ensemble_id string, conf_id long, e double")
    strict = {(r.ensemble_id, r.conf_id): r["pop"] for r in E.boltzmann(df, "e").collect()}
    assert strict == {("a", 1): None, ("a", 2): None, ("b", 1): 100.0}
    skip = {(r.ensemble_id, r.conf_id): r["pop"]
            for r in E.boltzmann(df, "e", skip_missing=True).collect()}
    assert skip == {("a", 1): 100.0, ("a", 2): None, ("b", 1): 100.0}


def test_retention_and_block(spark):
    df = spark.createDataFrame([("a", True, i == 0) for i in range(10)] + [("b", False, False)],
                               "ensemble_id string, was boolean, active boolean")
    rep = E.retention(df, F.col("was"), F.col("active"))
    rows = {r.ensemble_id: (r.retention, r.alert) for r in rep.collect()}
    assert rows == {"a": (0.1, True), "b": (1.0, False)}
    with pytest.raises(E.RetentionError):
        E.block_on_retention(rep)
    E.block_on_retention(E.retention(df, F.col("was"), F.col("active"), explicit_clusters=True))


def test_inherited_correction_chains_only_over_consecutive_steps(spark):
    rows = [(0, .1, True), (1, None, False), (2, None, False), (4, None, False), (5, .2, True),
            (6, None, True), (7, None, False)]
    df = spark.createDataFrame([("a", 1, p, -100.0, g, own) for p, g, own in rows],
                               "ensemble_id string, conf_id long, protocol int, e double, "
                               "g_e double, own boolean")
    df = df.withColumns({c: F.col("g_e") for c in ("zpve", "h", "s")})
    got = {r.protocol: r.g for r in R.carry_thermal_correction(df).collect()}
    assert got[0] == got[1] == got[2] == pytest.approx(-99.9)
    assert got[4] is None and got[5] == pytest.approx(-99.8)
    assert got[6] is None and got[7] is None      # own thermochemistry failed, chain broken


def test_lookback_reaches_any_earlier_step(spark):
    df = spark.createDataFrame([("a", 1, 0, [5.0], [1.0, 2.0, 3.0]), ("a", 1, 1, [], None),
                                ("a", 1, 4, [], None), ("a", 2, 0, [], None)],
                               "ensemble_id string, conf_id long, protocol int, "
                               "freq array<double>, b_vec array<double>")
    got = {(r.conf_id, r.protocol): (r.freq, r.b_vec) for r in R.lookback_vectors(df).collect()}
    assert got[1, 4] == ([5.0], [1.0, 2.0, 3.0])
    assert got[2, 0] == (None, [1.0, 1.0, 1.0])


def test_record_status_rules(spark):
    df = spark.createDataFrame([(1, False, False, 3), (2, True, False, 3), (3, True, True, 0),
                                (4, True, True, 3)],
                               "conf_id long, terminated boolean, converged boolean, n_freq int")
    strict = {r.conf_id: (r.status, r.active, r.failed) for r in
              R.record_status(df, F.lit(True), F.lit(True), F.lit(False)).collect()}
    assert strict == {1: ("crashed", False, False), 2: ("not_converged", False, True),
                      3: ("no_frequencies", False, True), 4: ("ok", True, False)}
    lenient = {r.conf_id: r.failed for r in
               R.record_status(df, F.lit(True), F.lit(True), F.lit(True)).collect()}
    assert lenient[2] is False


def test_arithmetic_reports_missing_steps(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 1.0)],
                               "ensemble_id string, protocol int, e_av double")
    df = df.withColumns({f"{b}_av": F.lit(None).cast("double") for b in ("ezpve", "h", "g")})
    got = {(r.ensemble_id, r.operation): (r.status, r.e_kcal) for r in
           E.protocol_arithmetic(df, [(2, "-", 1), (1, "+", 2)]).collect()}
    assert got["a", "2 - 1"] == ("ok", pytest.approx(2 * HARTREE_TO_KCAL))
    assert got["a", "1 + 2"] == ("ok", pytest.approx(4 * HARTREE_TO_KCAL))
    assert got["b", "2 - 1"] == ("missing", None)
    with pytest.raises(ValueError):
        E.protocol_arithmetic(df, [(1, "*", 2)])


def test_rank_puts_inactive_last(six):
    df = six.withColumn("active", F.col("conf_id") != 2)
    got = [r.conf_id for r in E.energy_rank(df).orderBy("energy_rank").collect()]
    assert got == [1, 3, 4, 5, 6, 2]
    assert math.isclose(E.relative_energy(df).where("conf_id = 1").first().erel, 0.0)


def test_summary_of_a_window_is_the_composition(spark):
    rows = [(e, i, i % 5 != 4, -100.0 + (i * 37 % 101) * s, None if e == "hole" and i == 0 else -99.9 + (i * 53 % 97) * s)
            for e, s in (("a", 1e-4), ("far", 5.0), ("hole", 1e-4)) for i in range(60)]
    df = spark.createDataFrame([(e, i, a, None if g is None else x, g) for e, i, a, x, g in rows],
                               "ensemble_id string, conf_id long, active boolean, e double, g double")
    inside = E.boltzmann(E.energy_window(df, 4.0).where("active"), effective_energy("e", "g"))
    inside = inside.withColumn("eff", effective_energy("e", "g"))
    want = E.weighted_average(inside, {"e_av": ("eff", "pop")}, top_pop=F.max("pop"), max_erel=F.max("erel"))
    got, want = ({r.ensemble_id: (r.n_conf, r.e_av, r.top_pop, r.max_erel) for r in d.collect()}
                 for d in (E.window_summary(df, 4.0), want))
    assert got.keys() == want.keys() and got["hole"][1:] == (None, None, None)
    assert got.pop("hole") == want.pop("hole")      # approx takes no nulls
    for e in got:
        assert got[e] == pytest.approx(want[e], rel=1e-12)


def test_partition_function_over_a_wide_range(spark):
    """Energies thousands of kcal/mol apart, with bins far from the smallest."""
    rnd = random.Random(3)
    energies = [-1000 + rnd.choice([0, 0.01, 1.0, 30.0]) + rnd.random() * 1e-3 for _ in range(500)]
    df = spark.createDataFrame([("m", i, x, float(300 + 1000 * (i % 2))) for i, x in enumerate(energies)],
                               "ensemble_id string, conf_id long, e double, t double")
    low = min(energies)
    rel = np.array([(x - low) * 627.5096080305927 for x in energies])
    w = np.exp(-rel * 4186 / (8.31446261815324 * 298.15))
    got = [r["pop"] for r in E.boltzmann(df, "e").orderBy("conf_id").collect()]
    assert np.allclose(got, w / w.sum() * 100, rtol=1e-11, atol=0)
    state = E.partition_functions(df, {"": F.col("e")}, F.col("t")).first()
    w = np.exp(-rel * 4186 / (8.31446261815324 * np.array([300.0, 1300.0] * 250)))
    assert state["_z"] == pytest.approx(w.sum(), rel=1e-11) and state["_c"] == 500
    none = spark.createDataFrame([("m", 1, None)], "ensemble_id string, conf_id long, e double")
    assert [r["pop"] for r in E.boltzmann(none, "e").collect()] == [None]
    assert E.boltzmann(none.where("false"), "e").count() == 0
