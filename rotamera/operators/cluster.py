"""Principal components, k-means, silhouettes and reduction by cluster, per ensemble.

Ensembles up to a row limit are handled whole by one task each, many at a time. Larger ones
take a distributed form of the same algorithm, so no task ever holds an unbounded ensemble.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql import types as T

from rotamera.constants import MIN_PCA_MEMBERS
from rotamera.functions.energy import effective_energy
from rotamera.operators import KEYS, scan
from rotamera.operators.geometry import with_features
from rotamera.operators.grouping import (_join_on, attach, attach_stats, dealt_runs,
                                         split_by_size, spread)
from rotamera.session import cut_lineage

GROUP_LIMIT = 20_000      # members of an ensemble that one task may cluster
SCAN_BYTES = 32 << 20     # coordinates of an ensemble that the tasks of a k scan hold whole
LABEL_BYTES = 64 << 20    # of a label matrix at a time, or of the rounds that a scan keeps
BLOCK = 8_000             # members per side of a distance block
BLOCK_BYTES = 32 << 20    # of intermediate distances at a time
CANCELLED = 1e-3          # of the two squared lengths: squared distances below are summed from the gaps
FEW = 64                  # clusters whose distance sums are one matrix product
SEED = 42


def clusterable(df: DataFrame, keys: Sequence[str] = KEYS, k: int | None = None,
                minimum: int = MIN_PCA_MEMBERS) -> DataFrame:
    """Rows of the ensembles with enough active members, and at least ``k``."""
    df = attach_stats(df, keys, _active=F.count_if(F.col("active")))
    return df.where(F.col("_active") >= max(minimum, k or 0)).drop("_active")


# --- principal components -----------------------------------------------------

@dataclass
class PCA:
    """``scores``: the input rows with an array of scores; ``variance``: (keys, pc, variance,
    ratio); ``loadings``: (keys, pc, feature, loading). Components count from 1."""

    scores: DataFrame
    variance: DataFrame
    loadings: DataFrame


def _partial_products(keys: Sequence[str]):
    """Sum of xᵀx for each run of equal keys in a sorted partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total = None, None
        for pdf in batches:
            out = []
            for values, g in pdf.groupby(list(keys), sort=False, dropna=False):
                x = np.stack(list(g["_x"]))
                if values != current:
                    if current is not None:
                        out.append({**dict(zip(keys, current)), "p": total.ravel()})
                    current, total = values, np.zeros((x.shape[1], x.shape[1]))
                total += x.T @ x
            if out:
                yield pd.DataFrame(out)
        if current is not None:
            yield pd.DataFrame([{**dict(zip(keys, current)), "p": total.ravel()}])
    return run


@F.pandas_udf(T.StructType([
    T.StructField("value", T.ArrayType(T.DoubleType())),
    T.StructField("vector", T.ArrayType(T.ArrayType(T.DoubleType())))]))
def _components(products: pd.Series, rows: pd.Series) -> pd.DataFrame:
    """Eigenpairs of each summed product matrix, largest first. The sign makes the largest
    loading of a component positive."""
    values, vectors = [], []
    for p, n in zip(products, rows):
        d = int(round(len(p) ** 0.5))
        val, vec = np.linalg.eigh(np.asarray(p).reshape(d, d))
        keep = min(int(n), d)
        val, vec = np.maximum(val[::-1][:keep], 0.0), vec[:, ::-1][:, :keep].T
        top = vec[np.arange(keep), np.abs(vec).argmax(axis=1)]
        vec = vec * np.where(top < 0, -1.0, 1.0)[:, None]
        values.append(val)
        vectors.append([list(v) for v in vec])
    return pd.DataFrame({"value": values, "vector": vectors})


def _packed(df: DataFrame, keys: Sequence[str], index: str, value: str, name: str) -> DataFrame:
    """(keys, index, value) rows as one array per key, in index order."""
    pairs = F.array_sort(F.collect_list(F.struct(index, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s[value]).alias(name))


def pca(df: DataFrame, keys: Sequence[str] = KEYS, features: str = "features") -> PCA:
    """Mean-centred PCA of every ensemble at once, with all min(n, d) components. Means and
    cross products are mergeable sums; only the d × d eigenproblem, d being the number of
    atoms, is solved in one place."""
    keys = list(keys)
    df = cut_lineage(df)
    means = (df.select(*keys, F.posexplode(features).alias("_f", "_v")).groupBy(*keys, "_f")
             .agg(F.avg("_v").alias("_v"), F.count(F.lit(1)).alias("_n")))
    means = cut_lineage(_packed(means, keys, "_f", "_v", "_mean").join(
        means.where("_f = 0").select(*keys, "_n"), keys))
    size = means.agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("t"),
                     F.max(F.size("_mean")).alias("d")).first()
    d = size["d"] or 1
    centred = attach(df, means, keys, size["n"], 100 + 8 * d, "_n", size["t"]).withColumn(
        "_x", F.zip_with(F.col(features), "_mean", lambda a, m: a - m)).drop("_mean", "_n")
    schema = T.StructType([df.schema[k] for k in keys]
                          + [T.StructField("p", T.ArrayType(T.DoubleType()))])
    parts = (dealt_runs(centred.select(*keys, "_x"), keys, GROUP_LIMIT, F.xxhash64("_x"))
             .mapInPandas(_partial_products(keys), schema))
    products = (spread(parts, keys)
                .select(*keys, F.posexplode("p").alias("_f", "_v"))
                .groupBy(*keys, "_f").agg(F.sum("_v").alias("_v")))
    products = _packed(products, keys, "_f", "_v", "_p").join(means.select(*keys, "_n"), keys)
    comps = cut_lineage(products.select(*keys, "_n", _components("_p", "_n").alias("_c")))
    vectors = comps.select(*keys, "_n", F.col("_c.vector").alias("_vec"))
    dot = F.transform("_vec", lambda v: F.aggregate(
        F.zip_with(v, F.col("_x"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    scores = attach(centred, vectors, keys, size["n"], 100 + 8 * d * (d + 2), "_n", size["t"])
    scores = scores.withColumn("scores", dot).drop("_vec", "_x", "_n")
    total = F.aggregate("_c.value", F.lit(0.0), lambda s, x: s + x)
    variance = comps.select(*keys, "_n", total.alias("_t"),
                            F.posexplode("_c.value").alias("pc", "_v")).select(
        *keys, (F.col("pc") + 1).alias("pc"),
        F.try_divide("_v", F.col("_n") - 1).alias("variance"),
        F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).alias("ratio"))
    loadings = (comps.select(*keys, F.posexplode("_c.vector").alias("pc", "_l"))
                .select(*keys, (F.col("pc") + 1).alias("pc"),
                        F.posexplode("_l").alias("feature", "loading")))
    return PCA(scores, variance, loadings)


def cumulative_variance(variance: DataFrame, keys: Sequence[str] = KEYS, mark: float = 90.0
                        ) -> DataFrame:
    """Ratios in percent, their running sum, and whether it has reached ``mark``. The window
    runs over the components of one ensemble."""
    w = W.partitionBy(*keys).orderBy("pc").rowsBetween(W.unboundedPreceding, 0)
    return (variance.withColumn("percent", F.col("ratio") * 100.0)
            .withColumn("cumulative", F.sum("percent").over(w))
            .withColumn("reached", F.col("cumulative") >= mark))


def top_loadings(loadings: DataFrame, n: int = 5, pcs: int = 3, keys: Sequence[str] = KEYS
                 ) -> DataFrame:
    """The features with the largest |loading| of the first components."""
    w = W.partitionBy(*keys, "pc").orderBy(F.abs("loading").desc(), "feature")
    return (loadings.where(F.col("pc") <= pcs).withColumn("place", F.row_number().over(w))
            .where(F.col("place") <= n))


# --- k-means ------------------------------------------------------------------

def _block_rows(doubles: int) -> int:
    """Rows of a block that needs so many doubles a row."""
    return max(1, min(512, BLOCK_BYTES // (8 * max(1, doubles))))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int32)
    block = _block_rows(centres.size)
    for a in range(0, len(points), block):
        gap = points[a:a + block, None, :] - centres[None, :, :]
        out[a:a + block] = (gap * gap).sum(-1).argmin(axis=1)
    return out


def _lloyd(points: np.ndarray, order: np.ndarray, k: int, max_iter: int) -> np.ndarray:
    """k-means from the first ``k`` points in ``order``; an emptied cluster keeps its centre."""
    centres = points[np.argsort(order, kind="stable")[:k]].copy()
    labels = _nearest(points, centres)
    for _ in range(max_iter - 1):
        by = np.argsort(labels, kind="stable")
        used, starts, sizes = np.unique(labels[by], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(points[by], starts, axis=0) / sizes[:, None]
        new = _nearest(points, centres)
        if (new == labels).all():
            break
        labels = new
    return labels


def _nearest_column(points: str, centres: str) -> Column:
    """Index of the nearest of an array of (id, centre), the lowest id on ties."""
    def dist(c: Column) -> Column:
        return F.aggregate(F.zip_with(points, c["centre"], lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda s, x: s + x)
    options = F.transform(centres, lambda c: F.struct(dist(c).alias("d"), c["id"].alias("id")))
    return F.array_min(options)["id"]


def assign_clusters(points: DataFrame, centroids: DataFrame, keys: Sequence[str] = KEYS,
                    column: str = "points") -> DataFrame:
    """Add ``cluster``, the nearest of the ensemble's (keys, cluster, centre). The k centres
    travel as one array per ensemble and no pair of point and centre becomes a row."""
    keys = list(keys)
    packed = cut_lineage(centroids.groupBy(*keys).agg(F.collect_list(
        F.struct(F.col("cluster").alias("id"), "centre")).alias("_centres")))
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.max(
        F.size("_centres") * (F.size(F.col("_centres")[0]["centre"]) + 4)).alias("w")).first()
    out = attach(points.drop("cluster"), packed, keys, size["n"], 100 + 8 * (size["w"] or 1))
    return out.withColumn("cluster", _nearest_column(column, "_centres").cast("int")).drop("_centres")


def _kmeans_by_rounds(rows: DataFrame, keys: list[str], column: str, max_iter: int) -> DataFrame:
    most = rows.agg(F.max("_k")).first()[0]
    w = W.partitionBy(*keys).orderBy("_h", "conf_id")
    # a literal limit on row_number prunes map-side, so few rows of any ensemble shuffle
    first = (rows.select(*keys, "conf_id", "_h", "_k", F.col(column).alias("centre"))
             .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(most))
             .where(F.col("_rn") <= F.col("_k")))
    centres = cut_lineage(first.select(*keys, (F.col("_rn") - 1).alias("cluster"), "centre"))
    for _ in range(max_iter - 1):
        labelled = assign_clusters(rows, centres, keys, column)
        moved = (labelled.select(*keys, "cluster", F.posexplode(column).alias("_f", "_v"))
                 .groupBy(*keys, "cluster", "_f").agg(F.avg("_v").alias("_v")))
        moved = _packed(moved, [*keys, "cluster"], "_f", "_v", "_new")
        new = cut_lineage(centres.join(moved, [*keys, "cluster"], "left").select(
            *keys, "cluster", F.coalesce("_new", "centre").alias("centre"),
            (F.col("_new").isNotNull() & (F.col("_new") != F.col("centre"))).alias("_moved")))
        centres = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    return assign_clusters(rows, centres, keys, column)


def kmeans(df: DataFrame, k: int | Column, keys: Sequence[str] = KEYS, points: str = "scores",
           seed: int = SEED, max_iter: int = 50, order: Column | None = None,
           group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``cluster``. Starts from the ``k`` members first in ``order``, by default that of
    a seeded hash of the conformer id, so the labels are the same on any cluster."""
    keys = list(keys)
    start = F.xxhash64("conf_id", F.lit(seed)) if order is None else order
    k_col = k if isinstance(k, Column) else F.lit(int(k))
    rows = df.select(*keys, "conf_id", F.col(points).alias("_pts"),
                     start.cast("double").alias("_h"), k_col.cast("int").alias("_k"))
    small, large = split_by_size(rows, keys, group_limit)
    schema = T.StructType([rows.schema[c] for c in (*keys, "conf_id")]
                          + [T.StructField("cluster", T.IntegerType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("conf_id")
        out = pdf[[*keys, "conf_id"]].copy()
        out["cluster"] = _lloyd(np.stack(list(pdf["_pts"])), pdf["_h"].to_numpy(),
                                int(pdf["_k"].iloc[0]), max_iter)
        return out
    labels = spread(small, keys).groupBy(*keys).applyInPandas(fit, schema)
    if large is not None:
        labels = labels.unionByName(_kmeans_by_rounds(large, keys, "_pts", max_iter)
                                    .select(*keys, "conf_id", "cluster"))
    return _join_on(df.drop("cluster"), labels, [*keys, "conf_id"], "inner")


# --- silhouettes --------------------------------------------------------------

def _silhouettes(points: np.ndarray, labellings: Sequence[np.ndarray]) -> np.ndarray:
    """Silhouettes of the points (columns) under each labelling (rows). Each block of the
    distance matrix is made once and summed by cluster for all labellings."""
    out = np.full((len(labellings), len(points)), np.nan)
    ready = []
    for n, labels in enumerate(labellings):
        ids, own = np.unique(labels, return_inverse=True)
        if len(ids) > 1:
            order = np.argsort(own, kind="stable")
            starts = np.searchsorted(own[order], np.arange(len(ids)))
            ready.append((n, own, order, starts, np.bincount(own)))
    block = _block_rows(3 * len(points))
    for lo in range(0, len(points) if ready else 0, block):
        dist = _distances(points[lo:lo + block], points)
        at = np.arange(len(dist))
        for n, own, order, starts, sizes in ready:
            if len(sizes) <= FEW:
                sums = dist @ (own[:, None] == np.arange(len(sizes))).astype(float)
            else:
                sums = np.add.reduceat(dist[:, order], starts, axis=1)
            mine = own[lo:lo + block]
            a = sums[at, mine] / np.maximum(sizes[mine] - 1, 1)
            others = sums / sizes
            others[at, mine] = np.inf
            b = others.min(axis=1)
            top = np.maximum(a, b)
            out[n, lo:lo + block] = np.where((sizes[mine] > 1) & (top > 0),
                                             (b - a) / np.where(top > 0, top, 1.0), 0.0)
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product, and from the gaps where that would cancel."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return _distances_by_gaps(x, y)
    centre = y.mean(axis=0)
    a, b = x - centre, y - centre
    na, nb = (a * a).sum(1), (b * b).sum(1)
    out = a @ b.T
    out *= -2.0
    out += na[:, None]
    out += nb[None, :]
    pairs = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
    rows = max(1, BLOCK_BYTES // (8 * max(1, len(y))))
    for lo in range(0, len(x), rows):
        i, j = np.nonzero(out[lo:lo + rows] < CANCELLED * (na[lo:lo + rows, None] + nb[None, :]))
        if 4 * len(i) > out[lo:lo + rows].size:
            out[lo:lo + rows] = _distances_by_gaps(x[lo:lo + rows], y) ** 2
            continue
        for k in range(0, len(i), pairs):
            p, q = i[k:k + pairs] + lo, j[k:k + pairs]
            gap = x[p] - y[q]
            out[p, q] = (gap * gap).sum(-1)
    return np.sqrt(np.maximum(out, 0.0, out=out), out=out)


def _distances_by_gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    block = _block_rows(y.size)
    for a in range(0, len(x), block):
        gap = x[a:a + block, None, :] - y[None, :, :]
        out[a:a + block] = np.sqrt((gap * gap).sum(-1))
    return out


def _silhouette_by_blocks(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Distance sums of large ensembles, block of members against block of members. A task
    holds two blocks and emits one row a member, with its sums by labelling and cluster; never the pairs."""
    rows = attach_stats(rows, keys, _size=F.count(F.lit(1)))
    rows = rows.withColumn("_nb", F.ceil(F.col("_size") / F.lit(block)).cast("int"))
    rows = rows.withColumn("_blk", F.pmod(F.xxhash64("conf_id"), F.col("_nb")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    left = rows.withColumn("_c", others).withColumns({"_r": F.col("_blk"), "_left": F.lit(True)})
    right = rows.withColumn("_r", others).withColumns({"_c": F.col("_blk"), "_left": F.lit(False)})
    cells = left.unionByName(right).select(*keys, "_r", "_c", "_left", "conf_id", "_pts", "_labels")
    schema = T.StructType([rows.schema[c] for c in (*keys, "conf_id", "_labels")] + [
        T.StructField(c, T.ArrayType(t)) for c, t in (("place", T.IntegerType()), ("cluster", T.IntegerType()),
                                                      ("total", T.DoubleType()), ("n", T.LongType()))])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_left"]], pdf[~pdf["_left"]]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[f.name for f in schema])
        x, y = np.stack(list(a["_pts"])), np.stack(list(b["_pts"]))
        found = [np.unique(c, return_inverse=True) for c in np.stack(list(b["_labels"])).T]
        place = np.repeat(np.arange(len(found)), [len(ids) for ids, _ in found])
        first = np.cumsum([0] + [len(ids) for ids, _ in found])
        total = np.empty((len(x), first[-1]))
        orders = [np.argsort(own, kind="stable") for _, own in found]
        step = _block_rows(3 * len(y))
        for lo in range(0, len(x), step):
            dist = _distances(x[lo:lo + step], y)
            for k, (ids, own) in enumerate(found):
                if len(ids) <= FEW:
                    part = dist @ (own[:, None] == np.arange(len(ids))).astype(float)
                else:
                    part = np.add.reduceat(dist[:, orders[k]], np.searchsorted(own[orders[k]], np.arange(len(ids))), axis=1)
                total[lo:lo + step, first[k]:first[k + 1]] = part
        ids = np.concatenate([i for i, _ in found])
        count = np.concatenate([np.bincount(own) for _, own in found])
        out = a[[*keys, "conf_id", "_labels"]].copy()
        out["place"], out["cluster"] = [place] * len(a), [ids] * len(a)
        out["total"], out["n"] = list(total), [count] * len(a)
        return out
    parts = spread(cells, [*keys, "_r", "_c"]).groupBy(*keys, "_r", "_c").applyInPandas(sums, schema)
    # a member's rows come together once; the sums per cluster then need no shuffle of their own
    conf = [*keys, "conf_id", "_labels"]
    rows = spread(parts, [*keys, "conf_id"]).select(*conf, F.inline(F.arrays_zip("place", "cluster", "total", "n")))
    per = rows.groupBy(*conf, "place", "cluster").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    mine = F.col("cluster") == F.get("_labels", F.col("place"))
    per = per.groupBy(*conf, "place").agg(
        F.max(F.when(mine, F.try_divide("t", F.col("n") - 1))).alias("a"),
        F.max(F.when(mine, F.col("n"))).alias("size"),
        F.min(F.when(~mine, F.col("t") / F.col("n"))).alias("b"))
    s = (F.when(F.col("b").isNull(), F.lit(None).cast("double"))
         .when(F.col("size") == 1, 0.0)
         .when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b"))
         .otherwise(0.0))
    per = per.groupBy(*conf).agg(F.array_sort(F.collect_list(F.struct("place", s.alias("s")))).alias("_s"))
    return per.select(*keys, "conf_id", F.col("_s.s").alias("silhouette"))


def silhouette(df: DataFrame, keys: Sequence[str] = KEYS, points: str = "scores",
               group_limit: int = GROUP_LIMIT // 2, block: int = BLOCK, labels: str = "cluster") -> DataFrame:
    """(keys, conf_id, silhouette) on Euclidean distance; 0 for the only member of a
    cluster, NULL where an ensemble has a single cluster. Where ``labels`` is an array of several
    labellings' clusters, so is ``silhouette``, and all take one pass over the distances."""
    keys = list(keys)
    several = isinstance(df.schema[labels].dataType, T.ArrayType)
    given = F.col(labels) if several else F.array(labels)
    rows = df.select(*keys, "conf_id", F.col(points).alias("_pts"), given.cast("array<int>").alias("_labels"))
    small, large = split_by_size(rows, keys, group_limit)
    schema = T.StructType([rows.schema[c] for c in (*keys, "conf_id")]
                          + [T.StructField("silhouette", T.ArrayType(T.DoubleType()))])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(list(pdf["_pts"]))
        out = pdf[[*keys, "conf_id"]].copy()
        out["silhouette"] = list(_silhouettes(x, list(np.stack(list(pdf["_labels"])).T)).T)
        return out
    res = spread(small, keys).groupBy(*keys).applyInPandas(whole, schema)
    res = res.withColumn("silhouette", F.transform("silhouette", lambda s: F.nanvl(s, F.lit(None).cast("double"))))
    if large is not None:
        res = res.unionByName(_silhouette_by_blocks(large, keys, block))
    return res if several else res.withColumn("silhouette", F.col("silhouette")[0])


def _whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ensemble: its points and start order as packed numbers, members by id."""
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("_x", T.BinaryType()), T.StructField("_h", T.BinaryType()),
        T.StructField("_ks", T.ArrayType(T.IntegerType())), T.StructField("_n", T.IntegerType())])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("conf_id")
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], np.stack(list(pdf["_pts"])).tobytes(),
                              pdf["_h"].to_numpy().tobytes(), pdf["_ks"].iloc[0], len(pdf)]],
                            columns=schema.names)
    return spread(rows, keys).groupBy(*keys).applyInPandas(pack, schema)


def _scans(keys: list[str], max_iter: int):
    """A packed ensemble with some of its numbers of clusters, rising -> (keys, k, score). What one k has found
    is carried to the next. Where squares are not finite, each k starts anew: labels of as many k as fit form the
    columns of a matrix, whose silhouettes take one pass over the distances."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            x = np.frombuffer(row["_x"]).reshape(row["_n"], -1)
            h, ks = np.frombuffer(row["_h"]), [int(k) for k in row["_tried"]]
            with np.errstate(over="ignore", invalid="ignore"):
                plain = np.isfinite(8.0 * (x * x).sum())
            if plain:
                found = scan.scores(x, h, ks, max_iter, LABEL_BYTES, BLOCK_BYTES)
                out += [[*[row[c] for c in keys], k, s] for k, s in zip(ks, found)]
                continue
            columns = max(1, LABEL_BYTES // (24 * len(x)))
            for lo in range(0, len(ks), columns):
                part = ks[lo:lo + columns]
                labels = [_lloyd(x, h, k, max_iter) for k in part]
                out += [[*[row[c] for c in keys], k, s] for k, s in zip(part, _silhouettes(x, labels).mean(axis=1))]
        return pd.DataFrame(out, columns=[*keys, "k", "score"])
    return run


def silhouette_curve(df: DataFrame, keys: Sequence[str] = KEYS, points: str = "scores",
                     seed: int = SEED, max_iter: int = 50, group_limit: int | None = None,
                     ks: Sequence[int] | None = None) -> DataFrame:
    """(keys, k, score): mean silhouette for every number of clusters of the ensemble's
    range, or for those of ``ks`` that are at least 2 and fewer than its members.

    An ensemble whose coordinates fit a task (``SCAN_BYTES``, or ``group_limit`` members) is packed into
    one row, of which copies go out with stretches of the range, as many as its part of the work of all
    ensembles: there are at most about as many copies as tasks, and a task holds one at a time. Within a
    stretch a k starts from what the one before has found; the lowest take longest, so early stretches are
    shorter. In a larger ensemble each k is a group of its own and all go through the distributed forms at once. A range with no room (largest below smallest) yields its smallest k with a
    NULL score."""
    keys = list(keys)
    rows = df.select(*keys, "conf_id", F.col(points).alias("_pts"),
                     F.xxhash64("conf_id", F.lit(seed)).cast("double").alias("_h"))
    rows = attach_stats(rows, keys, _n=F.count(F.lit(1)))
    lo = F.greatest(F.floor(F.col("_n") * 0.1), F.lit(2)).cast("int")
    hi = F.floor(F.col("_n") * 0.8).cast("int")
    if ks is None:
        tried = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    else:
        asked = F.array(*[F.lit(int(k)) for k in sorted(set(ks))]).cast("array<int>")
        tried = F.filter(asked, lambda k: (k >= 2) & (k < F.col("_n")))
    if group_limit is None:
        group_limit = SCAN_BYTES // (8 * (rows.agg(F.max(F.size("_pts"))).first()[0] or 1))
    small, large = split_by_size(rows.withColumn("_ks", tried), keys, group_limit)
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("k", T.IntegerType()), T.StructField("score", T.DoubleType())])
    packed = cut_lineage(_whole(small, keys))
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a stretch begins with one k from scratch, so more of them than keep the cores busy are waste
    tasks = 8 * spark.sparkContext.defaultParallelism
    # a third of a thousand members a side is about a second's work, whatever the range
    sides = F.ceil(F.col("_n") / F.lit(333)).cast("int")
    work = F.col("_n").cast("double") * F.col("_n") * F.size("_ks")
    total = packed.agg(F.sum(work).alias("w")).first()["w"] or 1.0
    part = F.floor(work * F.lit(tasks / total)).cast("int")
    shares = F.greatest(F.lit(1), F.least(F.greatest(F.lit(8), sides * sides), part, F.size("_ks")))

    def edge(chunk: Column) -> Column:
        return F.floor(F.size("_ks") * F.pow(chunk / F.col("_share"), F.lit(1.7))).cast("int")
    dealt = (packed.where("size(_ks) > 0").withColumn("_share", shares)
             .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_share") - 1)))
             .withColumn("_tried", F.slice("_ks", edge(F.col("_chunk")) + 1,
                                           edge(F.col("_chunk") + 1) - edge(F.col("_chunk"))))
             .where("size(_tried) > 0"))
    # few rows that take long: over more partitions than rows, so that two seldom share one
    chunks = dealt.drop("_ks").repartition(max(partitions, 4 * tasks), *keys, "_chunk").groupBy(*keys, "_chunk")
    curve = (chunks.applyInPandas(_scans(keys, max_iter), schema)
             .withColumn("score", F.nanvl("score", F.lit(None).cast("double"))))
    if large is not None:
        each = large.withColumnRenamed("_pts", points).withColumn("k", F.explode("_ks"))
        by_k = [*keys, "k"]
        labelled = kmeans(each, F.col("k"), by_k, points, seed, max_iter)
        curve = curve.unionByName(silhouette(labelled, by_k, points).groupBy(*by_k).agg(
            F.avg("silhouette").alias("score")))
    if ks is None:
        none = rows.where(lo > hi).select(*keys, lo.alias("k"), F.lit(None).cast("double").alias("score"))
        curve = curve.unionByName(none.distinct())
    return curve


def best_k(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k of the highest score, the smallest on ties."""
    order = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col("k"))
    return curve.groupBy(*keys).agg(F.min_by(F.struct("k", "score"), order).alias("_b")).select(
        *keys, "_b.*")


# --- reduction ----------------------------------------------------------------

def cluster_representatives(df: DataFrame, keys: Sequence[str] = KEYS,
                            energy: Column | None = None) -> DataFrame:
    """Only the lowest active member of each cluster stays active, ties by conformer id."""
    eff = effective_energy("e", "g") if energy is None else energy
    place = F.struct(F.coalesce(eff, F.lit(float("inf"))).alias("e"), F.col("conf_id").alias("c"))
    df = attach_stats(df, [*keys, "cluster"], _best=F.min(F.when(F.col("active"), place)))
    stays = F.col("active") & (F.col("conf_id") == F.col("_best.c"))
    return df.withColumn("active", F.coalesce(stays, F.lit(False))).drop("_best")


def cluster_reduce(df: DataFrame, k: int | Column | None = None, keys: Sequence[str] = KEYS,
                   include_h: bool = True, minimum: int = MIN_PCA_MEMBERS,
                   energy: Column | None = None, only: Column | None = None) -> DataFrame:
    """Cluster the active members of every ensemble that is large enough and keep one member
    per cluster; other ensembles are returned unchanged. Without ``k`` it is chosen per
    ensemble by silhouette; a column gives each ensemble its own, null where it is to be chosen.
    ``only`` names the ensembles to cluster."""
    keys = list(keys)
    asked = k if isinstance(k, Column) else F.lit(k).cast("int")
    df = attach_stats(df.withColumn("_asked", asked), keys, _active=F.count_if(F.col("active")))
    enough = ((F.col("_active") >= F.greatest(F.lit(minimum), F.coalesce("_asked", F.lit(0))))
              & F.col("active") & (F.lit(True) if only is None else only))
    work = with_features(df.where(enough).select(*keys, "conf_id", "atoms", "geom"), include_h)
    scores = cut_lineage(pca(work.select(*keys, "conf_id", "features"), keys).scores)
    if k is None or isinstance(k, Column):
        given = cut_lineage(df.where(enough).groupBy(*keys).agg(F.max("_asked").alias("_given")))
        scores = attach(scores, given, keys, given.count())
        chosen = cut_lineage(best_k(silhouette_curve(scores.where("_given IS NULL"), keys), keys).select(
            *keys, F.col("k").alias("_best_k")))
        scores = attach(scores, chosen, keys, chosen.count())
        labels = kmeans(scores, F.coalesce("_given", "_best_k"), keys)
    else:
        labels = kmeans(scores, k, keys)
    labels = cut_lineage(labels.select(*keys, "conf_id", F.col("cluster").alias("_now")))
    out = _join_on(df, labels, [*keys, "conf_id"], "left")
    # members left out now keep the label of an earlier clustering
    earlier = ["cluster"] if "cluster" in df.columns else []
    out = out.withColumn("cluster", F.coalesce("_now", *earlier))
    clustered, rest = out.where("_now IS NOT NULL"), out.where("_now IS NULL")
    return (cluster_representatives(clustered, keys, energy).unionByName(rest)
            .drop("_active", "_now", "_asked"))
