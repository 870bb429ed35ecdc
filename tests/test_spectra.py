import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotamera import constants as K
from rotamera.functions import spectral
from rotamera.functions.spectral import broadened, grid_points
from rotamera.operators import spectra as S

N = 300
LINES = "ensemble_id string, protocol int, graph_type string, x double, w double"


def plain(kind, x, w, shift, fwhm, n=N):
    p = grid_points(kind, n)
    c = x * shift if kind in K.VIBRATIONAL else x + shift
    off = p[:, None] - c[None, :]
    if kind in K.VIBRATIONAL:
        return (w * fwhm**2 / (fwhm**2 + 4 * off**2)).sum(1)
    s = fwhm / (2 * np.sqrt(2 * np.log(2)))
    return (w * np.exp(-off**2 / (2 * s * s)) / (s * np.sqrt(2 * np.pi))).sum(1)


def some_lines(kind, n=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(400, 3000, n) if kind in K.VIBRATIONAL else rng.uniform(2, 8, n)
    return x, rng.normal(size=n)


@pytest.mark.parametrize("kind", K.GRAPH_TYPES)
def test_broadening_equals_the_plain_sum(kind):
    x, w = some_lines(kind)
    d = K.GRAPH_DEFAULTS[kind]
    got = broadened(grid_points(kind, N), x, w, kind, [d["fwhm"], 2 * d["fwhm"]])
    shift = 1.0 if kind in K.VIBRATIONAL else 0.0
    for k, f in enumerate((d["fwhm"], 2 * d["fwhm"])):
        assert np.allclose(got[k], plain(kind, x, w, shift, f), atol=1e-12)


@pytest.mark.parametrize("limit", [10**6, 10])
def test_convolution(spark, limit):
    """Whole in one task, or dealt out and added up."""
    rows = []
    for kind in K.GRAPH_TYPES:
        x, w = some_lines(kind)
        rows += [("a", 1, kind, float(a), float(b)) for a, b in zip(x, w)]
    rows += [("z", 1, "UV", 0.0, 5.0), ("y", 1, "UV", 3.0, 0.0)]      # no spectrum from these
    got = S.convolve(spark.createDataFrame(rows, LINES), N, limit=limit).toPandas()
    assert set(got["ensemble_id"]) == {"a"}
    for kind in K.GRAPH_TYPES:
        x, w = some_lines(kind)
        d = K.GRAPH_DEFAULTS[kind]
        y = got[got["graph_type"] == kind].sort_values("i")
        assert np.allclose(y["x"], np.linspace(d["x_start"], d["x_end"], N))
        assert np.allclose(y["y"], plain(kind, x, w, d["shift"], d["fwhm"]), atol=1e-10)


def test_shift_scales_vibrations_and_moves_excitations(spark):
    df = spark.createDataFrame([("a", 1, "IR", 1000.0, 1.0), ("a", 1, "UV", 5.0, 1.0)], LINES)
    df = df.withColumn("s", F.when(F.col("graph_type") == "IR", 0.98).otherwise(0.5))
    got = S.convolve(df, 6701, shift="s").toPandas()
    top = got.loc[got.groupby("graph_type")["y"].idxmax()].set_index("graph_type")["x"]
    assert top["IR"] == pytest.approx(980, abs=1) and top["UV"] == pytest.approx(5.5, abs=.01)


def test_weights_are_populations_and_invert_flips_chiral_only(spark):
    peaks = spark.createDataFrame([("a", 1, 0, t, 10.0, .1) for t in ("IR", "VCD")]
                                  + [("a", 2, 0, "IR", 10.0, .1)],
                                  "ensemble_id string, conf_id long, protocol int, graph_type string, x double, y double")
    recs = spark.createDataFrame([("a", 1, 0, True, 50.0), ("a", 2, 0, False, 50.0), ("a", 1, 1, True, 20.0)],
                                 "ensemble_id string, conf_id long, protocol int, active boolean, pop double")
    own = {r.graph_type: r.w for r in S.weighted_peaks(peaks, recs, invert=True).collect()}
    assert own == {"IR": pytest.approx(5.0), "VCD": pytest.approx(-5.0)}
    other = S.weighted_peaks(peaks, recs, population_from=1).where("graph_type = 'IR'").collect()
    assert [r.w for r in other] == [pytest.approx(2.0)]


def test_normalisation_includes_negative_peaks(spark):
    df = spark.createDataFrame([("a", 0, "IR", i, y) for i, y in enumerate([10.0, 5.0, -20.0])],
                               "ensemble_id string, protocol int, graph_type string, i int, y double")
    assert [r.y for r in S.max_abs_normalise(df).orderBy("i").collect()] == [.5, .25, -1.0]
    local = df.withColumns({"lo": F.lit(0), "hi": F.lit(2)})
    assert [r.y for r in S.max_abs_normalise(local, lo="lo", hi="hi").orderBy("i").collect()] == [1.0, .5, -2.0]


@pytest.mark.parametrize("points", [[(1000.0, .5), (1100.0, .8), (1101.0, -.3), (2500.0, .1)],
                                    [(300.0, 1.0), (7000.0, -2.0)], [(100.0, 1.0), (9000.0, 3.0)],
                                    [(1000.0, 1.0)]])
def test_interpolation_like_numpy(spark, points):
    df = spark.createDataFrame([("IR", x, y) for x, y in points], "graph_type string, x double, y double")
    got = S.with_bounds(S.interp_to_grid(df, N)).orderBy("i").toPandas()
    grid = np.linspace(300, 7000, N)
    x, y = np.array(points).T
    assert np.allclose(got["y"], np.interp(grid, x, y, left=0, right=0))
    assert got["lo"].iloc[0] == int(np.argmin((grid - x.min()) < 0))
    assert got["hi"].iloc[0] == int(np.argmax((grid - x.max()) > 0))


def test_nm_axis_is_converted(spark):
    df = spark.createDataFrame([("UV", 200.0, 2.0), ("UV", 400.0, -4.0), ("ECD", 3.0, 1.0), ("IR", 1000.0, 1.0)],
                               "graph_type string, x double, y double")
    got = {(r.graph_type, round(r.x, 3)): r.y for r in S.reference_units(df).collect()}
    assert got == {("UV", 6.199): .5, ("UV", 3.1): -1.0, ("ECD", 3.0): 1.0, ("IR", 1000.0): 1.0}


def test_weight_function_shape(spark):
    df = spark.createDataFrame([("IR", 900.0, 1.0), ("IR", 2000.0, 1.0)], "graph_type string, x double, y double")
    got = S.reference_on_grid(df, 6701, interest=(1400, 1100)).orderBy("i").toPandas().set_index("x")
    w = got["weight"]
    assert w[850.0] == 0 and w[2100.0] == 0 and (w[1100.0:1400.0] == 1).all()
    assert w[905.0] == .15 and w[1990.0] == .15
    sigma = .1 * abs(900 - 1100)
    assert w[1090.0] == pytest.approx(np.exp(-.5 * (10 / sigma) ** 2))
    with pytest.raises(ValueError):
        S.weight_function(S.with_bounds(S.interp_to_grid(df, 10)), interest="everything")


def _reference_for(spark, kind, shift, fwhm, n):
    x, w = some_lines(kind)
    y = plain(kind, x, w, shift, fwhm, n)
    d = K.GRAPH_DEFAULTS[kind]
    g = np.linspace(d["x_start"], d["x_end"], n)[2:-2]
    return [(kind, float(a), float(b)) for a, b in zip(g, y[2:-2])]


def test_fit_recovers_shift_and_width(spark):
    n, rows, ref = 1500, [], []
    for kind, s, f in (("IR", .93, 12.0), ("ECD", .2, .3)):
        x, w = some_lines(kind)
        rows += [(e, 1, kind, float(a), float(b)) for e in "ab" for a, b in zip(x, w)]
        ref += _reference_for(spark, kind, s, f, n)
    lines = spark.createDataFrame(rows, LINES)
    on_grid = S.reference_on_grid(spark.createDataFrame(ref, "graph_type string, x double, y double"), n)
    params, spec = S.fitted_spectrum(lines, on_grid, n)
    for r in params.collect():
        s, f = (.93, 12.0) if r.graph_type == "IR" else (.2, .3)
        assert r.converged and r.shift == pytest.approx(s, rel=.002) and r.fwhm == pytest.approx(f, rel=.05)
    sim = S.similarity(spec, on_grid).collect()
    assert len(sim) == 4 and all(r.similarity > 99 for r in sim)
    aligned = {tuple(r[:3]): r.similarity for r in sim}
    compat = {tuple(r[:3]): r.similarity for r in S.similarity(spec, on_grid, compat=True).collect()}
    assert aligned.keys() == compat.keys()


def test_fit_by_passes_equals_fit_in_task(spark):
    n, rows, ref = 120, [], []
    for kind, s, f in (("VCD", .95, 10.0), ("UV", .1, .3)):
        x, w = some_lines(kind)
        rows += [("a", 1, kind, float(a), float(b)) for a, b in zip(x, w)]
        ref += _reference_for(spark, kind, s, f, n)
    lines = spark.createDataFrame(rows, LINES)
    on_grid = S.reference_on_grid(spark.createDataFrame(ref, "graph_type string, x double, y double"), n)

    def fit(limit, **kw):
        out = S.fit_shift_fwhm(lines, on_grid, n, points=3, passes=2, limit=limit, **kw).collect()
        return {r.graph_type: (round(r.shift, 9), round(r.fwhm, 9), round(r.diversity, 9), r.converged) for r in out}
    assert fit(10**6) == fit(1)
    fixed = fit(10**6, shift={"vibro": 1.0, "electro": None}, fwhm={"vibro": (5, 6), "electro": .25})
    assert fixed["VCD"][0] == 1.0 and 5 <= fixed["VCD"][1] <= 6 and fixed["UV"][1] == .25


def test_convolution_is_linear_in_the_weights(spark):
    x, w = some_lines("IR")
    df = spark.createDataFrame([("a", 1, "IR", float(a), float(b)) for a, b in zip(x, w)], LINES)
    one = S.convolve(df, N).orderBy("i").toPandas()["y"]
    two = S.convolve(df.withColumn("w", F.col("w") * 3), N).orderBy("i").toPandas()["y"]
    assert np.allclose(3 * one, two)


def test_spectra_mixes_fitted_and_default_types(spark):
    peaks, recs = [], []
    for kind in ("IR", "UV"):
        x, y = some_lines(kind, 10)
        peaks += [("a", 1, p, kind, float(a), float(b)) for p in (0, 1) for a, b in zip(x, y)]
    p = spark.createDataFrame(peaks, "ensemble_id string, conf_id long, protocol int, graph_type string, x double, y double")
    r = spark.createDataFrame([("a", 1, i, True, 100.0, -1.0, None) for i in (0, 1)],
                              "ensemble_id string, conf_id long, protocol int, active boolean, pop double, e double, g double")
    ref = S.reference_on_grid(spark.createDataFrame(_reference_for(spark, "IR", .95, 8.0, N),
                                                    "graph_type string, x double, y double"), N)
    out = S.spectra(p, r, ref, N).groupBy("graph_type", "protocol").count().collect()
    assert {(x.graph_type, x.protocol, x["count"]) for x in out} == {(t, i, N) for t in ("IR", "UV") for i in (0, 1)}
    again = S.respectra(p, r, [1], n=N)
    assert {x.protocol for x in again.select("protocol").distinct().collect()} == {1}
    borrowed = S.respectra(p, r, [1], population_from=0, n=N)
    assert borrowed.count() == 2 * N


@pytest.mark.parametrize("limit", [10**6, 1])
def test_spectrum_without_a_curve_gets_the_defaults(spark, limit):
    n = 200
    rows = [("a", 1, kind, float(x), float(w)) for kind in ("IR", "UV") for x, w in zip(*some_lines(kind, 5))]
    ref = S.reference_on_grid(spark.createDataFrame(_reference_for(spark, "IR", .95, 8.0, n),
                                                    "graph_type string, x double, y double"), n)
    out = S.fit_shift_fwhm(spark.createDataFrame(rows, LINES), ref, n, points=3, passes=1, limit=limit)
    got = {r.graph_type: r for r in out.collect()}
    assert got.keys() == {"IR", "UV"} and got["IR"].converged
    assert not got["UV"].converged and got["UV"].diversity is None and got["UV"].shift is not None


def test_lines_without_weight_count_for_the_place(spark):
    rows = [("a", 1, "IR", 0.0, 1.0), ("a", 1, "IR", 900.0, 0.0), ("b", 1, "IR", 0.0, 1.0)]
    out = S.convolve(spark.createDataFrame(rows, LINES), 50)
    assert {r.ensemble_id for r in out.select("ensemble_id").distinct().collect()} == {"a"}


def test_registered_full_fit_against_brute_force(spark):
    """Every point of the default grid is scored, and no pair of the first pass is better."""
    from rotamera.plans import spectra_queries as Q
    sf = "/root/testdata/sf0.001"
    got = Q.QUERIES["fit_shift_fwhm_full"](spark, sf).where("diversity is not null").collect()
    lines = Q._lines(spark, sf).where("w <> 0").toPandas()
    ref = Q._reference(spark, sf, 10_000).toPandas()
    assert {r.graph_type for r in got} and len(got) > 1
    for r in {r.graph_type: r for r in got}.values():
        d, vib = K.GRAPH_DEFAULTS[r.graph_type], r.graph_type in ("IR", "VCD")
        g = np.linspace(d["x_start"], d["x_end"], 10_000)
        c = ref[ref.graph_type == r.graph_type].sort_values("i")
        m = lines[(lines.ensemble_id == r.ensemble_id) & (lines.protocol == r.protocol)
                  & (lines.graph_type == r.graph_type)]
        seen = (c.i >= c.lo) & (c.i < c.hi)

        def score(s, f):
            y = np.zeros(len(g))
            for x, w in zip(m.x, m.w):
                y += w * (f * f / (f * f + 4 * (g - x * s) ** 2) if vib
                          else np.exp(-.5 * ((g - x - s) / (f * K.FWHM_TO_SIGMA)) ** 2) / f)
            top = np.abs(y[seen.to_numpy()]).max()
            return np.sqrt((c.weight.to_numpy() * (y / top - c.y.to_numpy()) ** 2).sum() / len(g)) / (
                2 if r.graph_type in ("VCD", "ECD") else 1)
        assert r.diversity == pytest.approx(score(r.shift, r.fwhm), abs=2e-5)
        best = min(score(s, f) for s in np.linspace(*d["shift_range"], 7) for f in np.linspace(*d["fwhm_range"], 7))
        assert r.diversity <= best + 2e-6


@pytest.mark.parametrize("kind", ["IR", "VCD", "UV", "ECD"])
def test_tiles_equal_the_plain_sum(kind, monkeypatch):
    """On 10,000 points, with lines on tile edges, outside the grid and far from it, within 1e-10."""
    from rotamera.functions import spectral
    rng = np.random.default_rng(6)
    at = grid_points(kind, 10_000)
    width = at[-1] - at[0]
    x = rng.uniform(at[0] - width / 2, at[-1] + width / 2, 800)
    x[:6] = at[[0, 1, 78, 79, 9998, 9999]]
    x[6:9] = at[0] + np.arange(3) * width / spectral.TILES
    x[9] = at[0] + 1000 * width
    w = rng.normal(size=len(x)) if kind in ("VCD", "ECD") else rng.random(len(x))
    d = K.GRAPH_DEFAULTS[kind]
    widths = [d["fwhm"], d["fwhm_range"][0], d["fwhm_range"][1]]
    tiled = broadened(at, x, w, kind, widths)
    monkeypatch.setattr(spectral, "PLAIN", 1 << 60)
    plain = broadened(at, x, w, kind, widths)
    assert np.abs(tiled - plain).max() <= 1e-10 * np.abs(plain).max()
    short = broadened(at, x, w, kind, widths, cutoff=6.0)
    assert (np.array_equal(short, plain) if kind in ("IR", "VCD") else
            0 < np.abs(short - plain).max() < 1e-7 * np.abs(plain).max())
    assert not broadened(at, x[:0], w[:0], kind, widths).any()


def test_populations_named_by_the_protocol(spark):
    peaks = spark.createDataFrame([(e, 1, p, "IR", 0, 100.0, 1.0) for e in "ab" for p in (0, 1, 2)],
                                  "ensemble_id string, conf_id long, protocol int, graph_type string, line_no int, x double, y double")
    recs = spark.createDataFrame([(e, 1, p, True, 10.0 * (p + 1) + (e == "b")) for e in "ab" for p in (0, 1, 2)],
                                 "ensemble_id string, conf_id long, protocol int, active boolean, pop double")
    steps = spark.createDataFrame([("a", 1, "0"), ("a", 2, None), ("b", 2, "1")],
                                  "ensemble_id string, protocol int, read_population string")
    got = {(r.ensemble_id, r.protocol): r.w for r in S.weighted_peaks(peaks, recs, population_from=steps).collect()}
    assert got == {("a", 0): 10.0, ("a", 1): 10.0, ("a", 2): 30.0, ("b", 0): 11.0, ("b", 1): 21.0, ("b", 2): 21.0}
    shared = steps.where("ensemble_id = 'a'").drop("ensemble_id")
    got = {(r.ensemble_id, r.protocol): r.w for r in S.weighted_peaks(peaks, recs, population_from=shared).collect()}
    assert got[("b", 1)] == 11.0 and got[("b", 2)] == 31.0


def test_many_lines_are_fitted_in_one_task_and_a_given_pair_once(spark, monkeypatch):
    """12,000 lines of a spectrum go to one task as arrays; two parts of a larger one emit two sums a pair."""
    rng = np.random.default_rng(5)
    rows = [("m", 0, "IR", float(x), float(w)) for x, w in zip(rng.uniform(400, 4000, 12_000), rng.random(12_000))]
    rows += [("m", 0, "UV", None, 1.0), (None, 1, "IR", 900.0, 1.0)]
    lines = spark.createDataFrame(rows, "ensemble_id string, protocol int, graph_type string, x double, w double")
    packed = S.packed_lines(lines, S.SPECTRUM)
    back = packed.select(*S.SPECTRUM, F.explode(F.arrays_zip("_x", "_w")).alias("l")).select(*S.SPECTRUM, "l._x", "l._w")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    n = 50
    ref = spark.createDataFrame([("IR", i, math.sin(i / 9.0), 1.0, 0, n) for i in range(n)],
                                "graph_type string, i int, y double, weight double, lo int, hi int")
    args = dict(n=n, points=2, passes=3, shift=1.0, fwhm=12.0)
    parted = {tuple(r)[:5] + (round(r.diversity, 12),) for r in S.fit_shift_fwhm(
        lines.where("x IS NOT NULL"), ref, limit=6000, **args).collect()}

    def never(*_):
        raise AssertionError("fitted by passes")
    monkeypatch.setattr(S, "_fit_by_passes", never)
    whole = {tuple(r)[:5] + (round(r.diversity, 12),) for r in S.fit_shift_fwhm(
        lines.where("x IS NOT NULL"), ref, **args).collect()}
    assert whole == parted and len(whole) == 2
    done = []
    monkeypatch.setattr(S, "broadened", lambda at, x, w, kind, widths: done.append(widths) or np.ones((len(widths), len(at))))
    one = pd.DataFrame({"graph_type": ["IR"], "_x": [np.array([900.0])], "_w": [np.array([1.0])], "s_lo": 1.0,
                        "s_hi": 1.0, "f_lo": 12.0, "f_hi": 12.0, "s_def": 1.0, "f_def": 10.0})
    S._fit_in_task(["graph_type"], n, 7, 6)(one, ref.toPandas())
    assert [len(d) for d in done] == [1]


def test_tiles_for_many_lines_give_the_plain_sums():
    rng = np.random.default_rng(6)
    x, w = np.sort(rng.uniform(-500, 9000, 40_000)), rng.standard_normal(40_000)
    at = spectral.grid_points("IR", 10_000)
    got = spectral.broadened(at, x, w, "IR", [4.0, 20.0])
    pick = np.arange(0, 10_000, 97)
    for y, f in zip(got, (4.0, 20.0)):
        want = spectral._plain(at[pick], x, w, spectral._lorentz(4.0 / (f * f)), math.inf)
        assert np.abs(y[pick] - want).max() < 1e-11 * np.abs(w).sum()
