import numpy as np
import pytest
from pyspark.sql import functions as F

from rotamera.functions import geometry as GF
from rotamera.operators import geometry as G


def _df(spark, geoms, atoms=None):
    rows = [(i, atoms or ["C"] * len(g), [[float(v) for v in p] for p in g]) for i, g in enumerate(geoms)]
    return spark.createDataFrame(rows, "conf_id long, atoms array<string>, geom array<array<double>>")


def test_two_atoms_one_apart(spark):
    got = G.with_features(_df(spark, [[[0, 0, 0], [1, 0, 0]]])).first().features
    assert np.allclose(got, [-1, 1])


def test_spectrum_is_invariant(spark):
    rng = np.random.default_rng(1)
    g = rng.normal(size=(9, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    variants = [g, g @ q.T, g + 5.0, g[rng.permutation(9)], rng.normal(size=(4, 3))]
    rows = [r.features for r in G.with_features(_df(spark, variants)).orderBy("conf_id").collect()]
    for other in rows[1:4]:
        assert np.allclose(rows[0], other)
    d = np.linalg.norm(g[:, None] - g[None], axis=-1)
    assert sum(rows[0]) == pytest.approx(0, abs=1e-9)
    assert sum(v * v for v in rows[0]) == pytest.approx((d * d).sum())
    assert len(rows[4]) == 4


def test_internals_and_labels(spark):
    g = [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 1, 1]]
    row = G.with_internals(_df(spark, [g]), [[0, 1], [0, 1, 2], [0, 1, 2, 3]]).first()
    assert row["B 0-1"] == pytest.approx(1) and row["A 0-1-2"] == pytest.approx(90)
    assert 0 <= row["D 0-1-2-3"] < 360
    flat = [[1, 0, 0], [0, 0, 0], [0, 1, 0], [1, 1, 0]]
    assert G.with_internals(_df(spark, [flat]), [[0, 1, 2, 3]]).first()["D 0-1-2-3"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        GF.internal("geom", [0])


def test_mass_and_heavy_atoms(spark):
    df = _df(spark, [[[0, 0, 0], [0, 0, 1], [0, 1, 0]]], ["O", "H", "H"])
    assert G.with_mass(df).first().mass == pytest.approx(18.015)
    heavy = G.drop_hydrogens(df).first()
    assert heavy.atoms == ["O"] and heavy.geom == [[0.0, 0.0, 0.0]]
    unknown = _df(spark, [[[0, 0, 0]]], ["Xx"])
    assert G.with_mass(unknown).first().mass is None


def test_pairs_and_rmsd(spark):
    got = G.atom_pairs(_df(spark, [[[0, 0, 0], [3, 4, 0], [0, 0, 2]]]), ["conf_id"]).collect()
    assert {(r.i, r.j): round(r.distance, 6) for r in got} == {(0, 1): 5.0, (0, 2): 2.0, (1, 2): round(29 ** .5, 6)}
    r = spark.range(1).select(GF.spectrum_rmsd(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(4.0))).alias("v"))
    assert r.first().v == pytest.approx(2 ** .5)
