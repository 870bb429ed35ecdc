"""Refinement by protocol and the average-energy analysis, composed of the operators.

A protocol table has one row per step, or one per ensemble and step: then ensembles on different protocols
advance together, each by its own thresholds and flags, and one that lacks a step waits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rotamera.constants import TEMPERATURE
from rotamera.functions.energy import effective_energy
from rotamera.functions.thermo import Conditions
from rotamera.operators import KEYS
from rotamera.operators import energy as E
from rotamera.operators.cluster import cluster_reduce
from rotamera.operators.grouping import _join_on, attach
from rotamera.operators.prune import duplicate_links
from rotamera.operators.records import (carry_thermal_correction, complete_thermochemistry,
                                        normalise_records, record_status, with_norms)
from rotamera.operators.thermo import retemper
from rotamera.session import cut_lineage


@dataclass(frozen=True)
class Step:
    """Settings of one step, as a row of the protocol table holds them."""

    protocol: int
    thr_g: float
    thr_b: float
    thr_gmax: float
    graph: bool = False
    no_prune: bool = False
    clustering: bool = False
    n_clusters: int | None = None
    block_on_retention_rate: bool = False

    @classmethod
    def of(cls, row) -> "Step":
        d = row.asDict()
        return cls(**{k: d[k] for k in cls.__dataclass_fields__ if k in d})


def records_from_logs(parsed: DataFrame, opt: Column, freq: Column, skip_opt_fail: Column,
                      mult: Column, freq_factor: Column | float = 1.0,
                      conditions: Conditions = Conditions()) -> DataFrame:
    """Parsed outputs of a step to its records: status rules, thermochemistry where the step
    has frequencies, norms and normalisation. Needs ``mass``. Rows that are not ``ok`` keep
    their status and carry no numbers; see ``carry_thermal_correction`` for steps without
    frequencies."""
    asked = F.coalesce(freq, F.lit(False))
    df = parsed.withColumn("freq", F.when(asked, F.col("freq")).otherwise(
        F.array().cast("array<double>")))
    df = record_status(df.withColumn("n_freq", F.size("freq")), opt, asked, skip_opt_fail)
    df = complete_thermochemistry(df.withColumn("mult", mult), conditions, freq_factor)
    df = normalise_records(with_norms(df))
    numbers = ("e", "g", "h", "s", "g_e", "zpve", "b", "m")
    df = df.withColumns({c: F.when(F.col("status") == "ok", F.col(c)) for c in numbers})
    return df.drop("n_freq", "terminated", "converged", "version")


_KINDS = {"thr_g": "double", "thr_b": "double", "thr_gmax": "double", "graph": "boolean",
          "no_prune": "boolean", "clustering": "boolean", "n_clusters": "int",
          "block_on_retention_rate": "boolean"}


def _with_settings(df: DataFrame, step: Step | DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_in``, whether the ensemble has the step, and its settings as ``_<name>``."""
    if isinstance(step, Step):
        return df.withColumns({"_in": F.lit(True), **{
            f"_{c}": F.lit(getattr(step, c)).cast(t) for c, t in _KINDS.items()}})
    rows = step.select(*keys, F.lit(True).alias("_in"), *[F.col(c).cast(t).alias(f"_{c}")
                                                         for c, t in _KINDS.items()])
    out = attach(df, rows, keys, rows.count())
    flags = [f"_{c}" for c, t in _KINDS.items() if t == "boolean"]
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_in", *flags)})


@dataclass
class Refined:
    """``conformers`` with active, deactivated_by and cluster as the step leaves them;
    ``records`` of the step with erel and pop of the survivors; ``retention`` per ensemble."""

    conformers: DataFrame
    records: DataFrame
    retention: DataFrame


def _clustered(conformers: DataFrame, pruned: DataFrame, keys: list[str], ids: list[str],
               include_h: bool, step: Step | DataFrame) -> DataFrame:
    """``pruned`` after the ensembles that ask for it are clustered down to representatives.
    Only here geometries are read."""
    shapes = conformers.select(*ids, "atoms", "geom")
    if isinstance(step, Step):
        full = _join_on(pruned, shapes, ids, "left")
        return cluster_reduce(full, step.n_clusters, keys, include_h).drop("atoms", "geom")
    full = _join_on(pruned, shapes, ids, "left")
    done = cluster_reduce(full, F.col("_n_clusters"), keys, include_h, only=F.col("_clustering"))
    return done.drop("atoms", "geom")


def _advance(state: DataFrame, conformers: DataFrame, records: DataFrame, step: Step | DataFrame,
             protocol: int, temperature: float, keys: list[str], include_h: bool) -> Refined:
    """One step on the narrow ``state`` (keys, conf_id, active, deactivated_by, cluster)."""
    ids = [*keys, "conf_id"]
    own = records.where(F.col("protocol") == protocol)
    now = F.when(F.col("protocol") == protocol, F.struct("e", "g", "b"))
    # one aggregate gives the latest record and the step's own
    seen = records.where(F.col("protocol") <= protocol).groupBy(*ids).agg(
        F.max_by(F.struct("e", "g", "b"), "protocol").alias("_r"), F.first(now, ignorenulls=True).alias("_own"))
    df = cut_lineage(_join_on(state, seen, ids, "left").select(
        *state.columns, "_r.e", "_r.g", "_r.b", "_own", F.col("_own.b").alias("_b_now")))
    df = _with_settings(df, step, keys).withColumn("_was", F.col("active"))
    prunes = F.col("_in") & ~F.col("_graph") & ~F.col("_no_prune")
    if not isinstance(step, Step) or not (step.graph or step.no_prune):
        df = E.energy_window(df, F.col("_thr_gmax"), keys, skip=~prunes).drop("rel_kcal")
        links = cut_lineage(duplicate_links(
            df, F.col("_thr_g"), F.col("_thr_b"), keys, e=effective_energy("e", "g"),
            ref_ok=F.coalesce(F.col("_b_now") != 1, F.lit(True)),
            active=F.col("active") & prunes).withColumnRenamed("deactivated_by", "_by"))
        df = _join_on(df, links, ids, "left").withColumn("active", F.col("active") & F.col("_by").isNull())
        # what an earlier step removed stays on record
        df = df.withColumn("deactivated_by", F.coalesce("_by", "deactivated_by")).drop("_by")
    pruned = cut_lineage(df.drop("_b_now"))
    left = pruned.where(F.col("active") & F.col("_in") & F.col("_own").isNotNull()).select(*ids, "_own.e", "_own.g")
    pops = E.boltzmann(left, effective_energy("e", "g"), temperature, keys).select(*ids, "erel", "pop")
    populated = _join_on(own.drop("erel", "pop"), pops, ids, "inner")
    report = E.retention(pruned.where("_in"), F.col("_was"), F.col("active"),
                         [*keys, "_n_clusters", "_block_on_retention_rate"])
    report = report.withColumn("alert", F.col("alert") & F.col("_n_clusters").isNull())
    blocks = step.block_on_retention_rate if isinstance(step, Step) else True
    if blocks:
        E.block_on_retention(report.where("_block_on_retention_rate"))
    report = report.drop("_n_clusters", "_block_on_retention_rate")
    if step.clustering if isinstance(step, Step) else not step.where("clustering").isEmpty():
        pruned = _clustered(conformers, pruned, keys, ids, include_h, step)
    left = pruned.select(*ids, "active", "deactivated_by", "cluster")
    return Refined(left, populated, report)


def _state(conformers: DataFrame, ids: list[str]) -> DataFrame:
    none = {"deactivated_by": "long", "cluster": "int"}
    return conformers.select(*ids, "active", *[
        (F.col(c) if c in conformers.columns else F.lit(None).cast(t)).alias(c) for c, t in none.items()])


def _full(conformers: DataFrame, state: DataFrame, ids: list[str], always: Sequence[str]) -> DataFrame:
    kept = [c for c in ("active", "deactivated_by", "cluster") if c in conformers.columns or c in always]
    return _join_on(conformers.drop(*kept), state.select(*ids, *kept), ids, "left")


def refine_step(conformers: DataFrame, records: DataFrame, step: Step | DataFrame,
                temperature: float = TEMPERATURE, keys: Sequence[str] = KEYS,
                include_h: bool = True, protocol: int | None = None) -> Refined:
    """Energy window, duplicate removal, populations and optional clustering of one step,
    for all ensembles. Energies and constants come from each conformer's latest record, the
    mark of missing constants (b = 1) from the step's own, populations from the step's own
    energies. The cheap window runs first, so the comparison sees fewer rows.

    ``step`` is one setting for all, or a table with a row for each ensemble that takes step
    ``protocol``: thresholds then come from each row's own ensemble."""
    keys = list(keys)
    ids = [*keys, "conf_id"]
    protocol = step.protocol if isinstance(step, Step) else protocol
    done = _advance(_state(conformers, ids), conformers, records, step, protocol, temperature, keys, include_h)
    always = ["deactivated_by"]
    if not isinstance(step, Step) or step.clustering:
        always.append("cluster")
    return Refined(_full(conformers, done.conformers, ids, ["active", *always]), done.records, done.retention)


def inherited(records: DataFrame, protocols: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records with ``g_e``, ``zpve``, ``h``, ``s`` and ``g`` of steps without frequencies taken
    from the step before, as the protocol table's ``freq`` tells."""
    by = [k for k in keys if k in protocols.columns]
    asks = protocols.select(*by, "protocol", F.col("freq").alias("own"))
    out = attach(records, asks, [*by, "protocol"], asks.count())
    out = out.withColumn("own", F.coalesce("own", F.lit(False)))
    return carry_thermal_correction(out, [*keys, "conf_id"]).drop("own")


def refine(conformers: DataFrame, records: DataFrame, protocols: DataFrame,
           temperature: float = TEMPERATURE, keys: Sequence[str] = KEYS, include_h: bool = True,
           inherit: bool = False) -> Refined:
    """All steps of a protocol table (``read_protocols`` or ``parse_protocols``) in order.

    The loop is over step numbers, of which a protocol has few; every pass is one set of jobs for all
    ensembles that take the step. Between steps only the narrow state (ids, active, deactivated_by,
    cluster) is kept. ``records`` and ``retention`` hold every step's, the latter with ``protocol``.
    ``inherit`` carries thermal corrections into steps without frequencies."""
    keys = list(keys)
    ids = [*keys, "conf_id"]
    by = [k for k in keys if k in protocols.columns]
    if by and by != keys:
        raise ValueError(f"the protocol table must have all of {keys} or none")
    protocols = cut_lineage(protocols)
    if inherit:
        records = inherited(records, protocols, keys)
    state, populated, reports = cut_lineage(_state(conformers, ids)), None, None
    for p in sorted(r.protocol for r in protocols.select("protocol").distinct().collect()):
        rows = protocols.where(F.col("protocol") == p)
        done = _advance(state, conformers, records, rows if by else Step.of(rows.first()), p, temperature,
                        keys, include_h)
        state = cut_lineage(done.conformers)
        report = done.retention.withColumn("protocol", F.lit(p))
        populated = done.records if populated is None else populated.unionByName(done.records)
        reports = report if reports is None else reports.unionByName(report)
    return Refined(_full(conformers, state, ids, ["active", "deactivated_by", "cluster"]), populated, reports)


def average_energies(records: DataFrame, temperatures: Sequence[float] = (TEMPERATURE,),
                     conditions: Conditions = Conditions(),
                     operations: Sequence[tuple[int, str, int]] = (), keys: Sequence[str] = KEYS
                     ) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(per conformer, averages per step, differences and sums of steps) with all
    thermochemistry recomputed at each temperature."""
    keys = list(keys)
    report = cut_lineage(retemper(records, temperatures, conditions, [*keys, "protocol"],
                                  [*keys, "conf_id"]))
    averages = E.ensemble_averages(report, [*keys, "protocol", "temperature"])
    sums = None
    if operations:
        sums = E.protocol_arithmetic(averages, operations, [*keys, "temperature"])
    return report, averages, sums
