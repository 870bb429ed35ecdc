import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rotamera.operators import cluster as C, scan

SCHEMA = "ensemble_id string, conf_id long, features array<double>"


def blobs(spark, sizes=(("a", 60), ("b", 25)), d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e, n in sizes:
        centre = rng.normal(size=(k, d)) * 10
        rows += [(e, i, (centre[i % k] + rng.normal(size=d)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df, col):
    pdf = df.toPandas().sort_values(["ensemble_id", "conf_id"])
    return {e: np.stack(list(g[col])) for e, g in pdf.groupby("ensemble_id")}


@pytest.mark.parametrize("limit", [10**6, 5])
def test_pca_like_svd(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "GROUP_LIMIT", limit)
    df = blobs(spark, (("a", 60), ("b", 4)))
    out = C.pca(df)
    x, s = arrays(df, "features"), arrays(out.scores, "scores")
    for e in "ab":
        xc = x[e] - x[e].mean(0)
        u, sv, vt = np.linalg.svd(xc, full_matrices=False)
        rank = min(x[e].shape)
        assert s[e].shape[1] == rank
        assert np.allclose(np.abs(s[e])[:, :3], np.abs(u * sv)[:, :3], atol=1e-7)
        var = out.variance.where(F.col("ensemble_id") == e).orderBy("pc").toPandas()
        assert np.allclose(var["ratio"][:3], (sv**2 / (sv**2).sum())[:3])
        load = out.loadings.where((F.col("ensemble_id") == e) & (F.col("pc") == 1)).orderBy("feature").toPandas()["loading"]
        assert load[load.abs().idxmax()] > 0 and np.allclose(np.abs(load), np.abs(vt[0]), atol=1e-7)


def test_kmeans_distributed_equals_in_task(spark):
    df = blobs(spark)
    one = C.kmeans(df, 3, points="features").toPandas().set_index(["ensemble_id", "conf_id"])["cluster"]
    two = C.kmeans(df, 3, points="features", group_limit=0).toPandas().set_index(["ensemble_id", "conf_id"])["cluster"]
    assert (one.sort_index() == two.sort_index()).all() and len(one) == 85
    per = C.kmeans(df, F.when(F.col("ensemble_id") == "a", 4).otherwise(2), points="features")
    n = {r.ensemble_id: r.n for r in per.groupBy("ensemble_id").agg(F.countDistinct("cluster").alias("n")).collect()}
    assert n == {"a": 4, "b": 2}


def brute_silhouette(x, lab):
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    out = []
    for i in range(len(x)):
        own = (lab == lab[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][lab == lab[i]].sum() / (own - 1)
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("kw", [{}, {"group_limit": 0, "block": 7}, {"group_limit": 0, "block": 1000}])
def test_silhouette(spark, kw):
    df = blobs(spark).withColumn("cluster", F.when(F.col("conf_id") == 7, 9).otherwise(F.col("conf_id") % 3).cast("int"))
    got = C.silhouette(df, points="features", **kw).toPandas().sort_values(["ensemble_id", "conf_id"])
    x, lab = arrays(df, "features"), arrays(df.withColumn("c", F.array("cluster")), "c")
    for e in "ab":
        want = brute_silhouette(x[e], lab[e].ravel())
        assert np.allclose(got[got["ensemble_id"] == e]["silhouette"], want)
    alone = C.silhouette(df.withColumn("cluster", F.lit(0)), points="features", **kw)
    assert alone.where("silhouette IS NOT NULL").count() == 0


def test_scan_finds_the_blobs_on_both_paths(spark):
    df = blobs(spark, (("a", 20), ("b", 14)))
    small = C.silhouette_curve(df, points="features")
    got = {(r.ensemble_id, r.k): round(r.score, 9) for r in small.collect()}
    assert {k for e, k in got if e == "a"} == set(range(2, 17))
    assert {r.ensemble_id: r.k for r in C.best_k(small).collect()} == {"a": 3, "b": 3}
    tiny = blobs(spark, (("a", 6), ("b", 5)))
    one = {(r.ensemble_id, r.k): round(r.score, 9) for r in C.silhouette_curve(tiny, points="features").collect()}
    two = {(r.ensemble_id, r.k): round(r.score, 9)
           for r in C.silhouette_curve(tiny, points="features", group_limit=0).collect()}
    assert one == two and {k for e, k in one if e == "a"} == {2, 3, 4}
    three = {(r.ensemble_id, r.k): round(r.score, 9)
             for r in C.silhouette_curve(df, points="features", group_limit=0).collect()}
    assert three == got
    alone = blobs(spark, (("a", 2),))        # no room: the smallest k without a score
    for limit in (0, 10):
        assert [(r.k, r.score) for r in C.silhouette_curve(
            alone, points="features", group_limit=limit).collect()] == [(2, None)]


def test_eligibility(spark):
    df = spark.createDataFrame([(e, i, i < n) for e, n in (("a", 5), ("b", 1), ("c", 3)) for i in range(6)],
                               "ensemble_id string, conf_id long, active boolean")

    def ok(k):
        return {r.ensemble_id for r in C.clusterable(df, k=k, minimum=2).select("ensemble_id").collect()}
    assert ok(2) == {"a", "c"} and ok(None) == {"a", "c"} and ok(4) == {"a"}


def test_one_representative_per_cluster(spark):
    df = spark.createDataFrame([("m", 1, 0, -1.0, True), ("m", 2, 0, -2.0, True), ("m", 3, 1, -1.5, True),
                                ("m", 4, 0, -9.0, False), ("m", 5, None, -1.0, True)],
                               "ensemble_id string, conf_id long, cluster int, e double, active boolean")
    df = df.withColumn("g", F.lit(None).cast("double"))
    got = {r.conf_id for r in C.cluster_representatives(df).where("active").collect()}
    assert got == {2, 3, 5}


def test_reduction_leaves_small_ensembles_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(e, i, ["C"] * 4, rng.normal(size=(4, 3)).tolist(), float(i), None, i % 10 != 9)
            for e, n in (("big", 40), ("small", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "ensemble_id string, conf_id long, atoms array<string>, "
                                     "geom array<array<double>>, e double, g double, active boolean")
    out = C.cluster_reduce(df, 6, minimum=20)
    n = {r.ensemble_id: (r.n, r.a) for r in out.groupBy("ensemble_id").agg(
        F.count("*").alias("n"), F.count_if("active").alias("a")).collect()}
    assert n == {"big": (40, 6), "small": (5, 5)}


def test_top_loadings_and_cumulative(spark):
    v = spark.createDataFrame([("m", 1, .8), ("m", 2, .15), ("m", 3, .05)], "ensemble_id string, pc int, ratio double")
    got = [(round(r.cumulative, 6), r.reached) for r in C.cumulative_variance(v).orderBy("pc").collect()]
    assert got == [(80.0, False), (95.0, True), (100.0, True)]
    load = spark.createDataFrame([("m", 1, f, x) for f, x in enumerate([.1, -.9, .5])],
                                 "ensemble_id string, pc int, feature int, loading double")
    assert [r.feature for r in C.top_loadings(load, 2).orderBy("place").collect()] == [1, 2]


def test_scan_of_given_numbers(spark):
    df = blobs(spark, (("a", 20), ("b", 14)))
    full = {(r.ensemble_id, r.k): round(r.score, 9) for r in C.silhouette_curve(df, points="features").collect()}
    want = {(e, k): s for (e, k), s in full.items() if k in (2, 3, 11)}
    for limit in (None, 0):
        got = {(r.ensemble_id, r.k): round(r.score, 9) for r in C.silhouette_curve(
            df, points="features", ks=[3, 2, 11, 1, 99], group_limit=limit).collect()}
        assert got == want


def test_scan_in_narrow_label_matrices(spark, monkeypatch):
    df = blobs(spark, (("a", 20),))
    one = {(r.k, r.score) for r in C.silhouette_curve(df, points="features").collect()}
    monkeypatch.setattr(C, "LABEL_BYTES", 1)
    assert {(r.k, r.score) for r in C.silhouette_curve(df, points="features").collect()} == one


def test_reduction_with_a_number_for_each_ensemble(spark):
    rng = np.random.default_rng(5)
    rows = [(e, i, ["C"] * 4, rng.normal(size=(4, 3)).tolist(), float(i), None, True)
            for e, n in (("four", 12), ("own", 10), ("none", 11)) for i in range(n)]
    df = spark.createDataFrame(rows, "ensemble_id string, conf_id long, atoms array<string>, "
                                     "geom array<array<double>>, e double, g double, active boolean")
    k = F.when(F.col("ensemble_id") == "four", 4)
    out = C.cluster_reduce(df, k, minimum=5, only=F.col("ensemble_id") != "none")
    n = {r.ensemble_id: r.a for r in out.groupBy("ensemble_id").agg(F.count_if("active").alias("a")).collect()}
    whole = C.cluster_reduce(df.where("ensemble_id = 'own'"), minimum=5).where("active").count()
    assert n == {"four": 4, "own": whole, "none": 11}


def test_silhouettes_of_several_labellings_take_one_pass(spark, monkeypatch):
    """On both paths, with clusters in some blocks only, many clusters, equal points and one labelling of one cluster."""
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(150, 5)) + 40.0
    pts[10:20] = pts[0]
    pts[20] = pts[21] + 1e-9
    rows = [("m", i, pts[i].tolist(), [i % 3, i % 90, 0, i // 149]) for i in range(150)]
    df = spark.createDataFrame(rows, "ensemble_id string, conf_id long, points array<double>, labellings array<int>")
    for kw in ({}, {"group_limit": 0, "block": 40}):
        got = {r.conf_id: r.silhouette for r in C.silhouette(df, points="points", labels="labellings", **kw).collect()}
        assert len(got) == 150
        for at in range(4):
            lab = np.array([r[3][at] for r in rows])
            if at == 2:
                assert {v[at] for v in got.values()} == {None}
                continue
            want = brute_silhouette(pts, lab)
            assert np.allclose([got[i][at] for i in range(150)], want, atol=1e-8, rtol=0)
    gaps = C._distances_by_gaps(pts, pts)
    assert np.allclose(C._distances(pts, pts), gaps, rtol=1e-10, atol=0)


def test_copies_of_packed_ensembles_are_about_as_many_as_tasks(spark, monkeypatch):
    """A copy goes to Python alone, and all ensembles together have about four copies a partition, not each of them."""
    rng = np.random.default_rng(4)
    rows = [(e, i, rng.normal(size=2).tolist()) for e in range(12) for i in range(40)]
    df = spark.createDataFrame(rows, "ensemble_id int, conf_id long, points array<double>")
    copies = spark.sparkContext.accumulator(0)
    held = spark.sparkContext.accumulator(0)
    scans = C._scans

    def counted(keys, max_iter):
        run = scans(keys, max_iter)

        def one(pdf):
            copies.add(len(pdf))
            held.add(1)
            return run(pdf)
        return one
    monkeypatch.setattr(C, "_scans", counted)
    curve = C.silhouette_curve(df, points="points").collect()
    assert len(curve) == 12 * (32 - 4 + 1)
    assert copies.value == held.value <= 4 * 4 + 12


def packed(x, h, ks):
    return pd.DataFrame([["m", x.tobytes(), h.astype(float).tobytes(), ks, len(x)]],
                        columns=["ensemble_id", "_x", "_h", "_tried", "_n"])


def odd_points(rng):
    """Points apart, copies of points, points on a grid, half of them equal, far from zero, all equal."""
    x = rng.normal(size=(90, 4))
    same = x.copy()
    same[:45] = same[0]
    return [x, np.repeat(x[:23], 4, axis=0), np.round(x, 0), same, x * 1e-3 + 1e4, np.zeros((20, 2)), x[:, :1] * 1e4]


@pytest.mark.parametrize("max_iter", [50, 3, 1])
def test_scan_equals_each_k_from_scratch(max_iter):
    """Labels to the bit, also where equal distances decide; scores do not depend on the k before."""
    rng = np.random.default_rng(6)
    for x in odd_points(rng):
        h = np.round(rng.permutation(len(x)) / 2)
        ks = list(range(2, len(x) - 1, 2 if len(x) < 50 else 5))
        want = [C._lloyd(x, h, k, max_iter) for k in ks]
        mean = C._silhouettes(x, want).mean(axis=1)
        for kept, room in ((64 << 20, 32 << 20), (20_000, 40_000), (0, 32 << 20)):
            p = scan._Points(x, room)
            labels = scan.Labels(p, h, ks[-1], max_iter, kept)
            assert all((labels.advance(k) == w).all() for k, w in zip(ks, want))
            got = scan.scores(x, h, ks, max_iter, kept, room)
            assert np.allclose(got, mean, atol=1e-12, rtol=0, equal_nan=True)
            alone = [scan.scores(x, h, [k], max_iter, kept, room)[0] for k in ks[::4]]
            assert np.array_equal(got[::4], alone, equal_nan=True)


def test_scan_carries_labels_from_k_to_k(monkeypatch):
    """No k meets all points with all centres anew, which made the scan's work grow with the cube of the members."""
    rng = np.random.default_rng(8)
    x, h, ks = rng.normal(size=(400, 3)), rng.permutation(400), list(range(40, 321))
    anew, met = [], []
    nearest, gaps = C._nearest, scan._Points.gaps
    monkeypatch.setattr(C, "_nearest", lambda *a: anew.append(1) or nearest(*a))
    monkeypatch.setattr(scan._Points, "gaps", lambda self, i, *a: met.append(len(i)) or gaps(self, i, *a))
    out = C._scans(["ensemble_id"], 50)(packed(x, h, ks))
    assert list(out["k"]) == ks and out["score"].notna().all()
    assert not anew and sum(met) < len(ks) * 400 * 40


def test_scan_of_points_without_finite_squares():
    """They take each k from scratch, as before."""
    rng = np.random.default_rng(2)
    x, h = rng.normal(size=(30, 2)), rng.permutation(30)
    x[3] = np.nan
    out = C._scans(["ensemble_id"], 50)(packed(x, h, [2, 3, 9]))
    want = C._silhouettes(x, [C._lloyd(x, h.astype(float), k, 50) for k in (2, 3, 9)]).mean(axis=1)
    assert np.array_equal(out["score"], want, equal_nan=True)


def test_stretches_of_a_scan_cover_its_range_once(spark):
    rng = np.random.default_rng(4)
    rows = [(e, i, rng.normal(size=2).tolist()) for e, n in enumerate((2, 3, 5, 13, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "ensemble_id int, conf_id long, points array<double>")
    got = sorted((r.ensemble_id, r.k) for r in C.silhouette_curve(df, points="points").collect())
    ranges = [(0, 2, 2), (1, 2, 2), (2, 2, 4), (3, 2, 10), (4, 9, 72)]
    assert got == [(e, k) for e, lo, hi in ranges for k in range(lo, hi + 1)]
