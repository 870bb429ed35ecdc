"""Order-exact removal of near-duplicates.

A row goes iff an *earlier, surviving* row of its ensemble is within both thresholds, so the
answer depends on the order and a plain anti-join is wrong. The thresholds cut the (energy,
rotational constant) plane into cells one threshold wide. Similar rows lie in the same or
adjacent cells, and survivors are so sparse that a cell holds about one: comparing against
survivors costs at most nine partners a row however dense the ensemble is.

Thresholds may be columns, one pair for each ensemble: a row carries its own, cells are as wide
as they say, and both belong to the key of every group and cell. Rows of an ensemble that differ in
them are never compared; a threshold that is null, zero or negative makes a row similar to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from rotamera.constants import HARTREE_TO_KCAL
from rotamera.functions.energy import kcal
from rotamera.operators import KEYS
from rotamera.operators.grouping import _join_on, split_by_size, spread
from rotamera.session import cut_lineage

GROUP_LIMIT = 1_000_000   # rows of an ensemble that one task streams through
SALTS = 64                # pieces a crowded cell is compared in
_SLACK = 1.0 + 1e-9       # cells a hair wider than the threshold, so rounding loses no pair


def _similar(x: str, y: str) -> Column:
    return ((kcal(F.abs(F.col(f"{x}e") - F.col(f"{y}e"))) < F.col("_te"))
            & (F.abs(F.col(f"{x}b") - F.col(f"{y}b")) < F.col("_tb")))


def _changes(names: pd.DataFrame) -> np.ndarray:
    """Where a row differs from the one before; missing keys are equal."""
    before = names.shift()
    return ((names != before) & ~(names.isna() & before.isna())).any(axis=1).to_numpy().copy()


def _greedy_pass(keys: Sequence[str]):
    """Sequential first-wins pass over partitions sorted by ensemble, thresholds and order. Held
    in memory are the survivors of one ensemble, by cell; rows stream through in batches."""
    group = [*keys, "_te", "_tb"]
    stride = 1 << 40      # one integer per cell: stride * energy cell + constant cell
    near = [stride * i + j for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[tuple[float, float, int]]] = {}
        last: tuple | None = None
        for pdf in batches:
            names = pdf[group]
            change = _changes(names)
            first = tuple(None if pd.isna(x) else x for x in names.iloc[0])
            change[0] = first != last
            last = tuple(None if pd.isna(x) else x for x in names.iloc[-1])
            energy, const = pdf["_e"].to_numpy(), pdf["_b"].to_numpy()
            thr_e, thr_b = pdf["_te"].to_numpy(), pdf["_tb"].to_numpy()
            cell = (np.floor(energy * HARTREE_TO_KCAL / (thr_e * _SLACK)).astype(np.int64).astype(object)
                    * stride + np.floor(const / (thr_b * _SLACK)).astype(np.int64)).tolist()
            limits = list(zip(thr_e.tolist(), thr_b.tolist()))
            order, is_ref = pdf["_o"].tolist(), pdf["_ref"].tolist()
            hits: list[int | None] = []
            for i, (e, b) in enumerate(zip(energy.tolist(), const.tolist())):
                if change[i]:
                    kept = {}
                hit = None
                te, tb = limits[i]
                for d in near:
                    for ke, kb, ko in kept.get(cell[i] + d, ()):
                        if (abs(e - ke) * HARTREE_TO_KCAL < te and abs(b - kb) < tb
                                and (hit is None or ko < hit)):
                            hit = ko
                hits.append(hit)
                if hit is None and is_ref[i]:
                    kept.setdefault(cell[i], []).append((e, b, order[i]))
            out = pdf[[*keys, "_o"]].copy()
            out["_by"] = pd.array(hits, dtype="Int64")
            yield out[out["_by"].notna()]
    return run


def _neighbourhood(df: DataFrame, prefix: str) -> DataFrame:
    """Copy each row to its own cell and the eight around it."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (df.withColumn("_de", F.explode(step)).withColumn("_db", F.explode(step))
            .withColumn("_ce", F.col(f"{prefix}ce") + F.col("_de"))
            .withColumn("_cb", F.col(f"{prefix}cb") + F.col("_db"))
            .drop("_de", "_db", f"{prefix}ce", f"{prefix}cb"))


def _against(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Similar (row, survivor or candidate) pairs. ``few`` has about one row a cell; its
    copies are sent to the occupied pieces of each cell, so a cell holding most of the
    ensemble is still compared in ``SALTS`` tasks."""
    cell = [*keys, "_ce", "_cb"]
    pieces = rows.select(*cell, "_salt").distinct()
    targets = _neighbourhood(few, "_c_").join(pieces, cell)
    return (rows.join(targets, [*cell, "_salt"])
            .where(_similar("_", "_c_") & (F.col("_o") != F.col("_c_o"))))


def _celled(rows: DataFrame) -> DataFrame:
    """Rows with the cell that their thresholds put them in, and a salt."""
    return rows.withColumns({
        "_ce": F.floor(kcal(F.col("_e")) / (F.col("_te") * F.lit(_SLACK))),
        "_cb": F.floor(F.col("_b") / (F.col("_tb") * F.lit(_SLACK))),
        "_salt": F.pmod(F.xxhash64("_o"), F.lit(SALTS))})


def _survivors_by_rounds(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Surviving references of ensembles too large for one task. Each round takes the first
    undecided row of every cell, keeps those no earlier undecided similar row stands against,
    and drops what the kept ones cover. Every round decides at least each ensemble's first
    undecided row; in practice a handful of rounds is enough."""
    cell = [*keys, "_ce", "_cb"]
    undecided = cut_lineage(refs)
    kept_parts: list[DataFrame] = []
    while not undecided.isEmpty():
        cand = (undecided.groupBy(*cell)
                .agg(F.min(F.struct("_o", "_e", "_b")).alias("_m"))
                .select(*keys, F.col("_ce").alias("_c_ce"), F.col("_cb").alias("_c_cb"),
                        F.col("_m._o").alias("_c_o"), F.col("_m._e").alias("_c_e"),
                        F.col("_m._b").alias("_c_b")))
        cand = cut_lineage(cand)
        blocked = (_against(undecided, cand, keys)
                   .where("_o < _c_o").select(*keys, "_c_o").distinct())
        kept = cut_lineage(cand.join(blocked, [*keys, "_c_o"], "left_anti"))
        kept_parts.append(kept)
        covered = (_against(undecided, kept, keys).where("_o > _c_o")
                   .select(*keys, "_o").distinct())
        decided = covered.unionByName(kept.select(*keys, F.col("_c_o").alias("_o")))
        undecided = cut_lineage(undecided.join(decided, [*keys, "_o"], "left_anti"))
    out = kept_parts[0]
    for p in kept_parts[1:]:
        out = out.unionByName(p)
    return out


def _rows(df: DataFrame, keys: list[str], order: str, e: Column, b: Column, thr_e: Column | float,
          thr_b: Column | float, ref_ok: Column | None, *more: Column) -> DataFrame:
    """What can be compared: order, energy, constant, thresholds and whether it may remove others."""
    limits = [(t if isinstance(t, Column) else F.lit(float(t))).cast("double") for t in (thr_e, thr_b)]
    rows = df.select(*keys, F.col(order).cast("long").alias("_o"), e.alias("_e"), b.alias("_b"),
                     (F.lit(True) if ref_ok is None else F.coalesce(ref_ok, F.lit(False))).alias("_ref"),
                     limits[0].alias("_te"), limits[1].alias("_tb"), *more)
    return rows.where(F.col("_e").isNotNull() & F.col("_b").isNotNull() & ~F.isnan("_e") & ~F.isnan("_b")
                      & (F.col("_te") > 0) & (F.col("_tb") > 0))


def duplicate_links(df: DataFrame, thr_e: Column | float, thr_b: Column | float,
                    keys: Sequence[str] = KEYS,
                    order: str = "conf_id", e: Column | str = "e", b: Column | str = "b",
                    ref_ok: Column | None = None, active: Column | None = None,
                    group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(keys, order, deactivated_by): the rows to remove, each with the first surviving row
    that is similar to it. ``order`` is an integer unique within the ensemble; ``ref_ok``
    bars rows from removing others (constants missing at this step). Rows without an energy
    or a constant are similar to nothing."""
    keys = list(keys)
    e = F.col(e) if isinstance(e, str) else e
    b = F.col(b) if isinstance(b, str) else b
    rows = _rows(df if active is None else df.where(active), keys, order, e, b, thr_e, thr_b, ref_ok)
    schema = T.StructType([rows.schema[k] for k in keys]
                          + [T.StructField("_o", T.LongType()), T.StructField("_by", T.LongType())])
    named = [*keys, F.col("_o").alias(order), F.col("_by").alias("deactivated_by")]
    small, large = split_by_size(rows, keys, group_limit)
    group = [*keys, "_te", "_tb"]
    links = (spread(small, keys).sortWithinPartitions(*group, "_o")
             .mapInPandas(_greedy_pass(keys), schema))
    if large is not None:
        celled = _celled(large)
        kept = _survivors_by_rounds(celled.where("_ref").drop("_ref"), group)
        links = links.unionByName(
            _against(celled, kept, group).where("_c_o < _o")
            .groupBy(*keys, "_o").agg(F.min("_c_o").alias("_by")))
    return links.select(*named)


def apply_links(df: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS,
                order: str = "conf_id") -> DataFrame:
    """Clear ``active`` on the linked rows and record what removed them."""
    base = df.drop("deactivated_by")
    out = _join_on(base, links, [*keys, order], "left")
    return out.withColumn("active", F.col("active") & F.col("deactivated_by").isNull())


def greedy_dedup(df: DataFrame, thr_e: Column | float, thr_b: Column | float, keys: Sequence[str] = KEYS,
                 order: str = "conf_id", **kw) -> DataFrame:
    """``df`` with ``active`` and ``deactivated_by`` after duplicate removal."""
    kw.setdefault("active", F.col("active"))
    return apply_links(df, duplicate_links(df, thr_e, thr_b, keys, order, **kw), keys, order)


def survivor_pairs(df: DataFrame, links: DataFrame, thr_e: Column | float, thr_b: Column | float,
                   keys: Sequence[str] = KEYS, order: str = "conf_id", e: str = "e",
                   b: str = "b", m: str | None = "m", ref_ok: Column | None = None) -> DataFrame:
    """Every (ref, check) with the ref surviving, earlier and similar: the comparisons that
    can remove a row, with their differences. At most about nine refs a check."""
    keys = list(keys)
    group = [*keys, "_te", "_tb"]
    m_col = F.col(m) if m else F.lit(None).cast("double")
    rows = _celled(_rows(df, keys, order, F.col(e), F.col(b), thr_e, thr_b, ref_ok, m_col.alias("_m")))
    dropped = links.select(*keys, F.col(order).alias("_o"))
    kept = (rows.where("_ref").join(dropped, [*keys, "_o"], "left_anti")
            .select(*group, *[F.col(f"_{c}").alias(f"_c_{c}") for c in ("ce", "cb", "o", "e", "b", "m")]))
    pairs = _against(rows, kept, group).where("_c_o < _o")
    return pairs.select(
        *keys, F.col("_c_o").alias("ref_id"), F.col("_o").alias("check_id"),
        kcal(F.abs(F.col("_e") - F.col("_c_e"))).alias("delta_e"),
        F.abs(F.col("_b") - F.col("_c_b")).alias("delta_b"),
        F.abs(F.col("_m") - F.col("_c_m")).alias("delta_m"))
