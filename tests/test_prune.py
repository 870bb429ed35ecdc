"""Duplicate removal against a quadratic sequential loop, on both paths."""

import random

import pytest
from pyspark.sql import functions as F

from rotamera.constants import HARTREE_TO_KCAL as K
from rotamera.operators import energy as E, prune as P
from rotamera.plans.refine import Step, refine, refine_step

SCHEMA = "ensemble_id string, conf_id long, e double, b double, active boolean, ok boolean"


def brute(rows, thr_e, thr_b):
    links, kept = {}, {}
    for ens, c, e, b, active, ok in sorted(rows, key=lambda r: (r[0], r[1])):
        if not active or e is None or b is None:
            continue
        hit = next((k for k in kept.get(ens, []) if abs(e - k[1]) * K < thr_e
                    and abs(b - k[2]) < thr_b), None)
        if hit:
            links[ens, c] = hit[0]
        elif ok:
            kept.setdefault(ens, []).append((c, e, b))
    return links


def sample(seed, n, spread, sort):
    rnd = random.Random(seed)
    out = []
    for ens in "ab":
        m = n if ens == "a" else n // 4
        pts = [(rnd.uniform(0, spread) / K - 10, rnd.choice([1.0, rnd.uniform(0, spread)]) if rnd.random() < .2
                else rnd.uniform(0, spread)) for _ in range(m)]
        if sort:
            pts.sort()
        for c, (e, b) in enumerate(pts):
            out.append((ens, c, None if c % 41 == 40 else e, b, rnd.random() > .1, b != 1.0))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
@pytest.mark.parametrize("seed,n,spread,sort", [(1, 150, 4.0, False), (2, 120, 12.0, True),
                                                (3, 200, 0.8, False)])
def test_same_as_sequential(spark, limit, seed, n, spread, sort):
    rows = sample(seed, n, spread, sort)
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.duplicate_links(df, 1.0, 1.0, ref_ok=F.col("ok"), active=F.col("active"), group_limit=limit)
    assert {(r.ensemble_id, r.conf_id): r.deactivated_by for r in got.collect()} == brute(rows, 1.0, 1.0)


def test_identical_rows_leave_one(spark):
    rows = [("a", c, -1.0, 2.0, True, True) for c in range(300)]
    for limit in (10**6, 0):
        df = P.greedy_dedup(spark.createDataFrame(rows, SCHEMA), 0.5, 0.1, group_limit=limit)
        assert df.where("active").count() == 1
        assert {r.deactivated_by for r in df.where("NOT active").collect()} == {0}


def test_thresholds_are_strict(spark):
    rows = [("a", 0, 0.0, 0.0, True, True), ("a", 1, 0.0, 0.5, True, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (10**6, 0):
        assert P.duplicate_links(df, 1.0, 0.5, group_limit=limit).count() == 0
        assert P.duplicate_links(df, 1.0, 0.51, group_limit=limit).count() == 1
    assert P.duplicate_links(df, 0.0, 1.0).count() == 0


def test_kept_set_is_independent_and_every_removed_row_is_covered(spark):
    rows = sample(7, 200, 5.0, False)
    df = spark.createDataFrame(rows, SCHEMA)
    links = P.duplicate_links(df, 1.0, 1.0, ref_ok=F.col("ok"), active=F.col("active"))
    pairs = P.survivor_pairs(df.where("active"), links, 1.0, 1.0, m=None, ref_ok=F.col("ok"))
    gone = {(r.ensemble_id, r.conf_id) for r in links.collect()}
    seen = {(r.ensemble_id, r.check_id) for r in pairs.collect()}
    assert seen == gone
    assert not {(r.ensemble_id, r.ref_id) for r in pairs.collect()} & gone


def test_two_row_step(spark):
    confs = spark.createDataFrame([("m", 1, True), ("m", 2, True), ("m", 3, True)],
                                  "ensemble_id string, conf_id long, active boolean")
    recs = spark.createDataFrame([("m", 1, 1, -100.0, None, 10.0), ("m", 2, 1, -100.0001, None, 10.01),
                                  ("m", 3, 1, -99.0, None, 20.0)],
                                 "ensemble_id string, conf_id long, protocol int, e double, g double, b double")
    done = refine_step(confs, recs, Step(1, 0.5, 10.0, 10.0))
    got = {r.conf_id: (r.active, r.deactivated_by) for r in done.conformers.collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, None)}
    assert [(r.conf_id, r["pop"], r.erel) for r in done.records.collect()] == [(1, 100.0, 0.0)]
    untouched = refine_step(confs, recs, Step(1, 0.5, 10.0, 10.0, no_prune=True))
    assert untouched.conformers.where("active").count() == 3


def test_second_step_keeps_what_the_first_removed(spark):
    confs = spark.createDataFrame([("m", i, True) for i in (1, 2, 3)],
                                  "ensemble_id string, conf_id long, active boolean")
    recs = spark.createDataFrame(
        [("m", 1, 1, -100.0, None, 10.0), ("m", 2, 1, -100.0001, None, 10.01), ("m", 3, 1, -99.999, None, 20.0),
         ("m", 1, 2, -100.0, None, 10.0), ("m", 3, 2, -100.0, None, 10.0)],
        "ensemble_id string, conf_id long, protocol int, e double, g double, b double")
    first = refine_step(confs, recs, Step(1, 0.5, 10.0, 10.0)).conformers
    second = refine_step(first, recs, Step(2, 0.5, 10.0, 10.0)).conformers
    got = {r.conf_id: (r.active, r.deactivated_by) for r in second.collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 1)}


def test_step_with_clustering(spark):
    rnd = random.Random(5)
    confs = spark.createDataFrame(
        [("m", i, True, ["C"] * 4, [[rnd.random() for _ in range(3)] for _ in range(4)]) for i in range(60)],
        "ensemble_id string, conf_id long, active boolean, atoms array<string>, geom array<array<double>>")
    recs = spark.createDataFrame([("m", i, 0, -100.0 + i * 1e-5, None, float(i)) for i in range(60)],
                                 "ensemble_id string, conf_id long, protocol int, e double, g double, b double")
    done = refine_step(confs, recs, Step(0, 0.1, 0.1, 100.0, clustering=True, n_clusters=5))
    rows = done.conformers.collect()
    assert len(rows) == 60 and sum(r.active for r in rows) == 5
    best = {}
    for r in rows:
        best[r.cluster] = min(best.get(r.cluster, 99), r.conf_id)
    assert {r.conf_id for r in rows if r.active} == set(best.values())
    assert done.records.count() == 60 and done.retention.first().retention == 1.0


def test_thresholds_of_each_row(spark):
    """Ensembles with thresholds of their own, on both paths, are what each gives alone."""
    rows = sample(7, 120, 5.0, False)
    df = spark.createDataFrame(rows, SCHEMA)
    names = sorted({r[0] for r in rows})
    limits = {n: (0.2 + 0.3 * i, 0.4 + 0.1 * i) for i, n in enumerate(names)} | {"none": (0.0, 1.0)}
    extra = [("none", *r[1:]) for r in rows if r[0] == names[0]]
    both = df.unionByName(spark.createDataFrame(extra, SCHEMA))
    te, tb = (F.element_at(F.create_map(*[F.lit(x) for n, v in limits.items() for x in (n, v[i])]),
                           F.col("ensemble_id")) for i in (0, 1))
    want = set()
    for n in names:
        own = P.duplicate_links(df.where(F.col("ensemble_id") == n), *limits[n], ref_ok=F.col("ok"))
        want |= {tuple(r) for r in own.collect()}
    for limit in (10**6, 0):
        got = P.duplicate_links(both, te, tb, ref_ok=F.col("ok"), group_limit=limit)
        assert {tuple(r) for r in got.collect()} == want and want
    links = P.duplicate_links(both, te, tb, ref_ok=F.col("ok"))
    pairs = P.survivor_pairs(both, links, te, tb, m=None, ref_ok=F.col("ok"))
    assert {(r.ensemble_id, r.check_id) for r in pairs.collect()} == {w[:2] for w in want}


def test_protocols_of_each_ensemble_advance_together(spark):
    """All ensembles at once are what each gives alone, step by step."""
    rnd = random.Random(8)
    rows, steps = [], []
    for n, e in enumerate("abc"):
        rows += [(e, i, p, -100 + rnd.random() * 4e-3, None if i % 3 else -100 + rnd.random() * 4e-3,
                  1.0 if i % 7 == 0 else rnd.random() * 8) for i in range(50) for p in (0, 1, 2) if (i + p) % 5]
        steps += [(e, p, 0.1 + 0.1 * n, 0.5 + p, 1.5 + n, False, e == "b" and p == 1, False, None, False)
                  for p in (0, 1, 2) if e != "c" or p != 1]
    recs = spark.createDataFrame(rows, "ensemble_id string, conf_id long, protocol int, e double, g double, b double")
    confs = recs.select("ensemble_id", "conf_id", F.lit(True).alias("active")).distinct()
    protocols = spark.createDataFrame(steps, "ensemble_id string, protocol int, thr_g double, thr_b double, "
                                             "thr_gmax double, graph boolean, no_prune boolean, clustering boolean, "
                                             "n_clusters int, block_on_retention_rate boolean")
    done = refine(confs, recs, protocols)
    state = {(r.ensemble_id, r.conf_id): (r.active, r.deactivated_by) for r in done.conformers.collect()}
    pops = {(r.ensemble_id, r.conf_id, r.protocol): r["pop"] for r in done.records.collect()}
    kept = {(r.ensemble_id, r.protocol): (r.n_before, r.n_after) for r in done.retention.collect()}
    assert set(kept) == {s[:2] for s in steps}
    for e in "abc":
        alone = confs.where(F.col("ensemble_id") == e)
        for s in protocols.where(F.col("ensemble_id") == e).orderBy("protocol").collect():
            one = refine_step(alone, recs.where(F.col("ensemble_id") == e), Step.of(s))
            alone = one.conformers
            assert {r.conf_id: r["pop"] for r in one.records.collect()} == pytest.approx(
                {c: v for (a, c, p), v in pops.items() if (a, p) == (e, s.protocol)})
        got = {r.conf_id: (r.active, r.deactivated_by) for r in alone.collect()}
        assert got == {c: v for (a, c), v in state.items() if a == e}
    assert any(v[1] is not None for v in state.values()) and any(v[0] for v in state.values())
    blocked = protocols.withColumn("block_on_retention_rate", F.lit(True)).withColumn("thr_gmax", F.lit(1e-9))
    with pytest.raises(E.RetentionError):
        refine(confs, recs, blocked)
    with pytest.raises(ValueError):
        refine(confs, recs, protocols, keys=["ensemble_id", "site"])


def test_one_protocol_for_all(spark):
    confs = spark.createDataFrame([("m", i, True) for i in (1, 2, 3)],
                                  "ensemble_id string, conf_id long, active boolean")
    recs = spark.createDataFrame(
        [("m", 1, 0, -100.0, 0.1, 10.0), ("m", 2, 0, -100.0001, 0.2, 10.01), ("m", 3, 0, -99.999, 0.3, 20.0),
         ("m", 1, 1, -100.0, None, 10.0), ("m", 3, 1, -100.0, None, 30.0)],
        "ensemble_id string, conf_id long, protocol int, e double, g_e double, b double")
    recs = recs.withColumns({c: F.col("g_e") for c in ("zpve", "h", "s")}).withColumn("g", F.col("e") + F.col("g_e"))
    steps = spark.createDataFrame(
        [(p, p == 0, 100.0, 5.0, 1e6, False, False, False, None, False) for p in (0, 1)],
        "protocol int, freq boolean, thr_g double, thr_b double, thr_gmax double, graph boolean, "
        "no_prune boolean, clustering boolean, n_clusters int, block_on_retention_rate boolean")
    done = refine(confs, recs, steps, inherit=True)
    got = {(r.conf_id, r.protocol): r.g for r in done.records.collect()}
    assert got == pytest.approx({(1, 0): -99.9, (3, 0): -99.699, (1, 1): -99.9, (3, 1): -99.7})
    assert {r.conf_id: r.deactivated_by for r in done.conformers.collect()} == {1: None, 2: 1, 3: None}
