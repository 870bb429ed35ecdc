"""Registered queries over geometries, principal components and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rotamera.functions.geometry import spectrum_rmsd as rmsd
from rotamera.operators import cluster as C, geometry as G
from rotamera.operators.grouping import first_per_group
from rotamera.operators.prune import duplicate_links
from rotamera.plans.tools import K, r, rs
from rotamera.plans.views import GEOMETRIES, geometries, table

KM_K, KM_ROUNDS, DIMS = 4, 40, 64     # rounds that the SQL goes, by when labels have settled


THIRDS, LABELLINGS = ((1, 21), (22, 21), (43, 22)), (2, 3, 4, 5, 6)


def _points(spark, sf):
    """All coordinates and a label per conformer."""
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("ensemble_id"), F.col("vec_id").alias("conf_id"),
        F.transform(F.slice(v, 1, DIMS), lambda x: x.cast("double")).alias("points"),
        (F.col("vec_id") % 5).cast("int").alias("cluster"),
        (v[63].cast("double") / 100 - 100).alias("e"), F.lit(None).cast("double").alias("g"),
        (F.col("vec_id") % 7 != 0).alias("active"))


POINTS = f"""SELECT CAST(label AS BIGINT) AS ensemble_id, vec_id AS conf_id,
 list_transform(embedding[1:{DIMS}], lambda x: CAST(x AS DOUBLE)) AS points,
 CAST(vec_id % 5 AS INTEGER) AS cluster, -100 + CAST(embedding[64] AS DOUBLE)/100 AS e,
 vec_id % 7 <> 0 AS active FROM embeddings"""


def atom_pairs(spark, sf):
    return G.atom_pairs(geometries(spark, sf)).select(
        "ensemble_id", "conf_id", F.col("i").cast("long").alias("i"),
        F.col("j").cast("long").alias("j"), r("distance").alias("distance"))


def internals(spark, sf):
    df = G.with_internals(geometries(spark, sf), [[0, 1], [0, 1, 2], [0, 1, 2, 3]])
    return df.select("ensemble_id", "conf_id", r(F.col("`B 0-1`")).alias("distance"),
                     r(F.col("`A 0-1-2`"), 4).alias("angle"),
                     r(F.col("`D 0-1-2-3`"), 4).alias("dihedral"))


def mass(spark, sf):
    return G.with_mass(geometries(spark, sf)).select("ensemble_id", "conf_id",
                                                     r("mass").alias("mass"))


def drop_hydrogens(spark, sf):
    df = G.drop_hydrogens(geometries(spark, sf))
    rows = df.select("ensemble_id", "conf_id", F.posexplode("geom").alias("place", "p"))
    return rows.select("ensemble_id", "conf_id", F.col("place").cast("long").alias("place"),
                       *[r(F.col("p")[i], 8).alias(c) for i, c in enumerate("xyz")])


def edm_spectrum(spark, sf):
    df = G.with_features(geometries(spark, sf))
    return df.select("ensemble_id", "conf_id",
                     F.posexplode("features").alias("place", "value")).select(
        "ensemble_id", "conf_id", "place", r("value").alias("value"))


def edm_moments(spark, sf):
    """Power sums of the distance-matrix spectra, with and without hydrogens: they equal the
    traces of powers of the matrix, which SQL can form from the distances."""
    df = geometries(spark, sf)
    for name, h in (("all", True), ("heavy", False)):
        df = G.with_features(df, h, f"f_{name}")
    power = {n: F.aggregate(f"f_{a}", F.lit(0.0), (lambda p: lambda s, x: s + F.pow(x, F.lit(p)))(p))
             for n, a, p in (("m1", "all", 1.0), ("m2", "all", 2.0), ("m3", "all", 3.0),
                             ("h2", "heavy", 2.0))}
    return df.select("ensemble_id", "conf_id", *[r(c, 5).alias(n) for n, c in power.items()])


def spectrum_rmsd(spark, sf):
    """RMS difference of each conformer's vector from that of its ensemble's first one."""
    df = _points(spark, sf)
    first = first_per_group(df, ["ensemble_id"], [F.col("conf_id")], ["points"]).withColumnRenamed(
        "points", "base")
    return df.join(first, "ensemble_id").select("ensemble_id", "conf_id",
                                                r(rmsd("points", "base")).alias("rmsd"))


def _removals(spark, sf):
    df = geometries(spark, sf).withColumns({"b": F.col("geom")[1][0], "m": F.col("geom")[2][0]})
    return G.removal_report(duplicate_links(df, 0.5, 0.1), df, include_h=False)


def removal_report(spark, sf):
    """Conformers removed as duplicates with their differences from the one that stayed."""
    return _removals(spark, sf).select("ensemble_id", "check_id", "ref_id",
                                       *[r(c).alias(c) for c in ("delta_e", "delta_b", "delta_m")])


def removal_rmsd(spark, sf):
    """The same pairs with the RMSD of their distance-matrix spectra."""
    return _removals(spark, sf).select("ensemble_id", "check_id", "ref_id", r("rmsd").alias("rmsd"))


def clusterable(spark, sf):
    return C.clusterable(_points(spark, sf), k=3, minimum=45).select("ensemble_id", "conf_id")


def _centres(df):
    rows = df.select("ensemble_id", "cluster", F.posexplode("points").alias("f", "v"))
    rows = rows.groupBy("ensemble_id", "cluster", "f").agg(F.avg("v").alias("v"))
    return C._packed(rows, ["ensemble_id", "cluster"], "f", "v", "centre")


def assign_clusters(spark, sf):
    df = _points(spark, sf)
    return C.assign_clusters(df, _centres(df)).select(
        "ensemble_id", "conf_id", F.col("cluster").cast("long").alias("cluster"))


def kmeans(spark, sf):
    """Lloyd iterations from the ensemble's first members."""
    out = C.kmeans(_points(spark, sf), KM_K, points="points", order=F.col("conf_id"))
    return out.select("ensemble_id", "conf_id", F.col("cluster").cast("long").alias("cluster"))


def silhouette(spark, sf):
    return C.silhouette(_points(spark, sf), points="points").select(
        "ensemble_id", "conf_id", r("silhouette").alias("silhouette"))


def cluster_representatives(spark, sf):
    return C.cluster_representatives(_points(spark, sf)).select(
        "ensemble_id", "conf_id", F.col("cluster").cast("long").alias("cluster"), "active")


def _point_pca(spark, sf):
    df = _points(spark, sf).select("ensemble_id", "conf_id", F.col("points").alias("features"))
    return C.pca(df)


def pca_total_variance(spark, sf):
    """Sum of all component variances, equal to the sum of the feature variances."""
    v = _point_pca(spark, sf).variance
    return v.groupBy("ensemble_id").agg(r(F.sum("variance"), 8).alias("total"),
                                        r(F.sum("ratio"), 8).alias("ratio"),
                                        F.count(F.lit(1)).alias("components"))


def pca_score_norms(spark, sf):
    """Length of each score vector: the distance from the ensemble's mean."""
    s = _point_pca(spark, sf).scores
    norm = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x))
    return s.select("ensemble_id", "conf_id", r(norm, 8).alias("norm"))


def pca_variance(spark, sf):
    """Scree table of the geometries' spectra with the 90 % mark."""
    v = C.pca(G.with_features(geometries(spark, sf)).select("ensemble_id", "conf_id", "features"))
    return C.cumulative_variance(v.variance).select(
        "ensemble_id", "pc", r("percent").alias("percent"), r("cumulative").alias("cumulative"),
        "reached")


def _thirds_pca(spark, sf):
    """PCA of three features, the sums over the vector's thirds, whose eigenvalues SQL can solve."""
    v = F.transform(F.col("points"), lambda x: x)
    sums = [F.aggregate(F.slice(v, lo, n), F.lit(0.0), lambda a, x: a + x) for lo, n in THIRDS]
    return C.pca(_points(spark, sf).select("ensemble_id", "conf_id", F.array(*sums).alias("features")))


def cumulative_variance(spark, sf):
    return C.cumulative_variance(_thirds_pca(spark, sf).variance).select(
        "ensemble_id", F.col("pc").cast("long").alias("pc"), r("percent").alias("percent"),
        r("cumulative").alias("cumulative"), "reached")


def top_loadings(spark, sf):
    return C.top_loadings(_thirds_pca(spark, sf).loadings).select(
        "ensemble_id", F.col("pc").cast("long").alias("pc"), F.col("feature").cast("long").alias("feature"),
        F.col("place").cast("long").alias("place"), r("loading").alias("loading"))


def best_k(spark, sf):
    """The best of five labellings by their silhouettes."""
    labellings = F.array(*[(F.col("conf_id") % k).cast("int") for k in LABELLINGS])
    each = C.silhouette(_points(spark, sf).withColumn("labellings", labellings), points="points", labels="labellings")
    scores = each.select("ensemble_id", F.posexplode("silhouette").alias("_at", "silhouette")).groupBy(
        "ensemble_id", F.array(*map(F.lit, LABELLINGS))[F.col("_at")].alias("k")).agg(F.avg("silhouette").alias("score"))
    return C.best_k(scores).select("ensemble_id", F.col("k").cast("long").alias("k"), r("score").alias("score"))


def _scores(spark, sf):
    df = G.with_features(geometries(spark, sf)).select("ensemble_id", "conf_id", "features")
    return C.pca(df).scores


def silhouette_curve(spark, sf):
    """Mean silhouette for each number of clusters tried."""
    return C.silhouette_curve(_scores(spark, sf)).select(
        "ensemble_id", "k", r("score").alias("score"))


def choose_k(spark, sf):
    return C.best_k(C.silhouette_curve(_scores(spark, sf))).select(
        "ensemble_id", "k", r("score").alias("score"))


def kmeans_reduce(spark, sf):
    df = geometries(spark, sf).withColumns({
        "active": F.lit(True), "g": F.lit(None).cast("double")})
    return C.cluster_reduce(df, 10).select("ensemble_id", "conf_id", "active", "cluster")


QUERIES = {f.__name__: f for f in (
    atom_pairs, internals, mass, drop_hydrogens, edm_spectrum, edm_moments, spectrum_rmsd,
    removal_report, removal_rmsd, clusterable, assign_clusters, kmeans, silhouette, cluster_representatives,
    pca_total_variance, pca_score_norms, pca_variance, cumulative_variance, top_loadings, best_k,
    silhouette_curve, choose_k, kmeans_reduce)}

# --- oracles ------------------------------------------------------------------

_G = f"WITH g AS ({GEOMETRIES})"
_P = f"WITH p AS ({POINTS})"
_ATOMS = f"""{_G}, a AS (SELECT ensemble_id, conf_id, i, atoms[i+1] AS atom, geom[i+1][1] AS x,
 geom[i+1][2] AS y, geom[i+1][3] AS z FROM g, (SELECT unnest(range(21)) AS i)),
 d AS (SELECT a.ensemble_id, a.conf_id, a.i, b.i AS j, a.atom <> 'H' AND b.atom <> 'H' AS heavy,
 sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2) + pow(a.z-b.z, 2)) AS dist
 FROM a JOIN a b ON a.conf_id = b.conf_id)"""


def _v(k: int, n: int = 1) -> str:
    return f"geom[{n + 1}][{k}] - geom[{n}][{k}]"


def _cross(p: str, q: str, k: int) -> str:
    i, j = [(2, 3), (3, 1), (1, 2)][k - 1]
    return f"({p}{i}*{q}{j} - {p}{j}*{q}{i})"


_DIST2 = "list_sum(list_transform(range(1, {n}), lambda i: pow({a}[i] - {b}[i], 2)))"


def _d2(a: str, b: str) -> str:
    return _DIST2.format(n=DIMS + 1, a=a, b=b)


def _mean(src: str) -> str:
    cols = ", ".join(f"avg(points[{i}])" for i in range(1, DIMS + 1))
    return f"SELECT ensemble_id, cluster, [{cols}] AS centre FROM {src} GROUP BY ensemble_id, cluster"


def _assign(src: str, centres: str) -> str:
    return (f"SELECT p.ensemble_id, p.conf_id, p.points, c.cluster FROM {src} p JOIN {centres} c "
            f"ON c.ensemble_id = p.ensemble_id QUALIFY row_number() OVER (PARTITION BY p.ensemble_id, "
            f"p.conf_id ORDER BY {_d2('p.points', 'c.centre')}, c.cluster) = 1")


def _lloyd_sql() -> str:
    parts = [f"{_P}, c0 AS (SELECT ensemble_id, row_number() OVER (PARTITION BY ensemble_id "
             f"ORDER BY conf_id) - 1 AS cluster, points AS centre FROM p "
             f"QUALIFY row_number() OVER (PARTITION BY ensemble_id ORDER BY conf_id) <= {KM_K}), a0 AS ({_assign('p', 'c0')})"]
    for i in range(1, KM_ROUNDS):
        parts.append(f"m{i} AS MATERIALIZED ({_mean(f'a{i - 1}')}), c{i} AS MATERIALIZED (SELECT c.ensemble_id, c.cluster, "
                     f"coalesce(m.centre, c.centre) AS centre FROM c{i - 1} c LEFT JOIN m{i} m "
                     f"USING (ensemble_id, cluster)), a{i} AS MATERIALIZED ({_assign('p', f'c{i}')})")
    return (", ".join(parts) + f" SELECT ensemble_id, conf_id, cluster FROM a{KM_ROUNDS - 1}")


# eigenvalues of the symmetric 3 x 3 covariance by the trigonometric solution, vectors as cross products
_X = [f"list_sum(points[{lo}:{lo + n - 1}])" for lo, n in THIRDS]
_EIGEN = f"""{_P}, f AS (SELECT ensemble_id, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X))} FROM p),
 cv AS (SELECT ensemble_id, {', '.join(f'covar_samp(x{i}, x{j}) AS a{i}{j}' for i in range(3) for j in range(i, 3))}
  FROM f GROUP BY 1),
 q AS (SELECT *, (a00 + a11 + a22)/3 AS q FROM cv),
 pq AS (SELECT *, sqrt((pow(a00 - q, 2) + pow(a11 - q, 2) + pow(a22 - q, 2)
  + 2*(a01*a01 + a02*a02 + a12*a12))/6) AS s FROM q),
 rq AS (SELECT *, greatest(-1e0, least(1e0, ((a00 - q)*((a11 - q)*(a22 - q) - a12*a12) - a01*(a01*(a22 - q) - a12*a02)
  + a02*(a01*a12 - (a11 - q)*a02))/(2*s*s*s))) AS hd FROM pq),
 ph AS (SELECT *, acos(hd)/3 AS phi FROM rq),
 ev AS (SELECT *, unnest([1, 2, 3]) AS pc, unnest([q + 2*s*cos(phi), q - 2*s*cos(phi) - 2*s*cos(phi + 2*pi()/3),
  q + 2*s*cos(phi + 2*pi()/3)]) AS ew FROM ph)"""

ORACLES = {
    "atom_pairs": f"""{_ATOMS} SELECT ensemble_id, conf_id, i, j, {rs('dist')} AS distance FROM d WHERE i < j""",
    "internals": f"""{_G}, v AS (SELECT *, {', '.join(f'{_v(k, n)} AS {p}{k}' for p, n in (('u', 1), ('v', 2), ('w', 3)) for k in (1, 2, 3))} FROM g),
 n AS (SELECT *, {', '.join(f'{_cross("u", "v", k)} AS s{k}, {_cross("v", "w", k)} AS t{k}' for k in (1, 2, 3))} FROM v),
 q AS (SELECT *, degrees(atan2((u1*t1 + u2*t2 + u3*t3)*sqrt(v1*v1 + v2*v2 + v3*v3), s1*t1 + s2*t2 + s3*t3)) AS dh FROM n)
 SELECT ensemble_id, conf_id, {rs('sqrt(u1*u1 + u2*u2 + u3*u3)')} AS distance,
 {rs('degrees(acos(-(u1*v1 + u2*v2 + u3*v3)/sqrt((u1*u1 + u2*u2 + u3*u3)*(v1*v1 + v2*v2 + v3*v3))))', 4)} AS angle,
 {rs('CASE WHEN dh < 0 THEN dh + 360 ELSE dh END', 4)} AS dihedral FROM q""",
    "mass": f"""{_G} SELECT ensemble_id, conf_id,
 {rs("list_sum(list_transform(atoms, lambda a: CASE a WHEN 'H' THEN 1.008e0 ELSE 12.011e0 END))")} AS mass FROM g""",
    "drop_hydrogens": f"""{_ATOMS} SELECT ensemble_id, conf_id,
 row_number() OVER (PARTITION BY conf_id ORDER BY i) - 1 AS place, {rs('x', 8)} AS x, {rs('y', 8)} AS y,
 {rs('z', 8)} AS z FROM a WHERE atom <> 'H'""",
    "edm_moments": f"""{_ATOMS}, m3 AS (SELECT p.conf_id, sum(p.dist*q.dist*s.dist) AS m3 FROM d p
 JOIN d q ON p.conf_id = q.conf_id AND p.j = q.i JOIN d s ON s.conf_id = q.conf_id AND s.i = q.j AND s.j = p.i
 GROUP BY 1), m2 AS (SELECT ensemble_id, conf_id, sum(dist*dist) AS m2,
 sum(CASE WHEN heavy THEN dist*dist END) AS h2 FROM d GROUP BY ALL)
 SELECT ensemble_id, conf_id, 0e0 AS m1, {rs('m2', 5)} AS m2, {rs('m3', 5)} AS m3, {rs('h2', 5)} AS h2
 FROM m2 JOIN m3 USING (conf_id)""",
    "spectrum_rmsd": f"""{_P}, f AS (SELECT ensemble_id, points AS base FROM p
 QUALIFY row_number() OVER (PARTITION BY ensemble_id ORDER BY conf_id) = 1)
 SELECT ensemble_id, conf_id, {rs(f"sqrt({_d2('points', 'base')}/{DIMS})")} AS rmsd
 FROM p JOIN f USING (ensemble_id)""",
    "clusterable": f"""{_P} SELECT ensemble_id, conf_id FROM p
 QUALIFY count(*) FILTER (active) OVER (PARTITION BY ensemble_id) >= 45""",
    "assign_clusters": f"""{_P}, c AS ({_mean('p')}), a AS ({_assign('p', 'c')})
 SELECT ensemble_id, conf_id, CAST(cluster AS BIGINT) AS cluster FROM a""",
    "kmeans": _lloyd_sql(),
    "silhouette": f"""{_P}, t AS (SELECT a.ensemble_id, a.conf_id, a.cluster AS own, b.cluster,
  sum(sqrt({_d2('a.points', 'b.points')})) AS t, count(*) AS n
  FROM p a JOIN p b ON a.ensemble_id = b.ensemble_id GROUP BY ALL),
 m AS (SELECT ensemble_id, conf_id, max(CASE WHEN own = cluster THEN t/nullif(n - 1, 0) END) AS a,
  max(CASE WHEN own = cluster THEN n END) AS n, min(CASE WHEN own <> cluster THEN t/n END) AS b
  FROM t GROUP BY ALL)
 SELECT ensemble_id, conf_id, {rs('CASE WHEN n = 1 THEN 0e0 ELSE (b - a)/greatest(a, b) END')} AS silhouette FROM m""",
    "cluster_representatives": f"""{_P} SELECT ensemble_id, conf_id, CAST(cluster AS BIGINT) AS cluster,
 active AND row_number() OVER (PARTITION BY ensemble_id, cluster ORDER BY active DESC, e, conf_id) = 1 AS active
 FROM p""",
    "pca_total_variance": f"""{_P} SELECT ensemble_id,
 {rs(' + '.join(f'var_samp(points[{i}])' for i in range(1, DIMS + 1)), 8)} AS total, 1e0 AS ratio,
 least(count(*), {DIMS}) AS components FROM p GROUP BY ensemble_id""",
    "pca_score_norms": f"""{_P}, m AS (SELECT ensemble_id, [{', '.join(f'avg(points[{i}])' for i in range(1, DIMS + 1))}] AS mn
 FROM p GROUP BY 1) SELECT ensemble_id, conf_id, {rs(f"sqrt({_d2('points', 'mn')})", 8)} AS norm
 FROM p JOIN m USING (ensemble_id)""",
    "cumulative_variance": f"""{_EIGEN}, rt AS (SELECT ensemble_id, pc, ew / (3*q) * 100 AS percent FROM ev),
 cm AS (SELECT *, sum(percent) OVER (PARTITION BY ensemble_id ORDER BY pc) AS cu FROM rt)
 SELECT ensemble_id, pc::BIGINT AS pc, {rs('percent')} AS percent, {rs('cu')} AS cumulative, cu >= 90 AS reached FROM cm""",
    "top_loadings": f"""{_EIGEN}, cr AS (SELECT ensemble_id, pc, [a01*a12 - a02*(a11 - ew), a02*a01 - (a00 - ew)*a12,
  (a00 - ew)*(a11 - ew) - a01*a01] AS v FROM ev),
 un AS (SELECT ensemble_id, pc, v, list_max(list_transform(v, lambda x: abs(x))) AS m,
  sqrt(list_sum(list_transform(v, lambda x: x*x))) AS norm FROM cr),
 ld AS (SELECT ensemble_id, pc, unnest([0, 1, 2]) AS feature, unnest(list_transform(v, lambda x: x / norm
  * CASE WHEN list_contains(v, m) THEN 1 ELSE -1 END)) AS loading FROM un)
 SELECT ensemble_id, pc::BIGINT AS pc, feature::BIGINT AS feature,
 row_number() OVER (PARTITION BY ensemble_id, pc ORDER BY abs(loading) DESC, feature) AS place, {rs('loading')} AS loading FROM ld""",
    "best_k": f"""{_P}, d AS (SELECT a.ensemble_id, a.conf_id, b.conf_id AS other, sqrt({_d2('a.points', 'b.points')}) AS d
  FROM p a JOIN p b ON a.ensemble_id = b.ensemble_id),
 t AS (SELECT ensemble_id, k, conf_id, conf_id % k AS own, other % k AS cluster, sum(d) AS t, count(*) AS n
  FROM d, (SELECT unnest([{', '.join(map(str, LABELLINGS))}]) AS k) GROUP BY ALL),
 m AS (SELECT ensemble_id, k, conf_id, max(CASE WHEN own = cluster THEN t/nullif(n - 1, 0) END) AS a,
  max(CASE WHEN own = cluster THEN n END) AS n, min(CASE WHEN own <> cluster THEN t/n END) AS b FROM t GROUP BY ALL),
 s AS (SELECT ensemble_id, k, avg(CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0e0 ELSE (b - a)/greatest(a, b) END) AS score
  FROM m GROUP BY ALL)
 SELECT ensemble_id, k::BIGINT AS k, {rs('score')} AS score FROM s
 QUALIFY row_number() OVER (PARTITION BY ensemble_id ORDER BY score DESC NULLS LAST, k) = 1""",
}
# the duplicate removal again, here over the geometries, one member per recursion step
ORACLES["removal_report"] = f"""WITH RECURSIVE g AS ({GEOMETRIES}),
 o AS (SELECT *, geom[2][1] AS b, geom[3][1] AS m,
  row_number() OVER (PARTITION BY ensemble_id ORDER BY conf_id) AS rn FROM g),
 step AS (SELECT ensemble_id, 0::BIGINT AS rn, CAST(NULL AS BIGINT) AS conf_id, CAST(NULL AS BIGINT) AS by_id,
   CAST([] AS STRUCT(id BIGINT, e DOUBLE, b DOUBLE)[]) AS kept FROM (SELECT DISTINCT ensemble_id FROM o)
  UNION ALL SELECT q.ensemble_id, q.rn, q.conf_id, q.hit, CASE WHEN q.hit IS NULL
   THEN list_append(q.kept, {{'id': q.conf_id, 'e': q.e, 'b': q.b}}) ELSE q.kept END
  FROM (SELECT o.ensemble_id, o.rn, o.conf_id, o.e, o.b, s.kept, list_min(list_transform(list_filter(s.kept,
    lambda z: abs(z.e - o.e)*{K} < 0.5 AND abs(z.b - o.b) < 0.1), lambda z: z.id)) AS hit
   FROM step s JOIN o ON o.ensemble_id = s.ensemble_id AND o.rn = s.rn + 1) q)
 SELECT c.ensemble_id, c.conf_id AS check_id, f.conf_id AS ref_id, {rs(f'abs(c.e - f.e)*{K}')} AS delta_e,
 {rs('abs(c.b - f.b)')} AS delta_b, {rs('abs(c.m - f.m)')} AS delta_m
 FROM step s JOIN o c ON c.conf_id = s.conf_id JOIN o f ON f.conf_id = s.by_id"""
