"""Per-record rules: normalisation, status, inheritance between steps, thresholds.

The windows here run over the steps of one conformer, a group no larger than the protocol
has steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from rotamera.constants import LEVEL_THRESHOLDS
from rotamera.functions.energy import (known, real_modes, scaled_frequencies, step_level,
                                       vector_norm)
from rotamera.functions.thermo import Conditions, with_gibbs
from rotamera.operators import KEYS

CONF_KEYS = [*KEYS, "conf_id"]


def normalise_records(df: DataFrame) -> DataFrame:
    """Zero energy means missing, zero norms mean 1, corrections need the values they were
    derived from, NaN becomes NULL."""
    has_g = known("g").isNotNull()
    e = F.nullif(known("e"), F.lit(0.0))
    return df.withColumns({
        "e": e, "g": known("g"),
        "b": F.coalesce(F.nullif(known("b"), F.lit(0.0)), F.lit(1.0)),
        "m": F.coalesce(F.nullif(known("m"), F.lit(0.0)), F.lit(1.0)),
        "zpve": F.when(has_g, known("zpve")), "h": F.when(has_g, known("h")),
        "s": F.when(has_g, known("s")),
        "g_e": F.when(has_g & e.isNotNull(), known("g_e")),
    })


def with_norms(df: DataFrame) -> DataFrame:
    """``b`` and ``m`` from their vectors."""
    return df.withColumns({"b": vector_norm("b_vec"), "m": vector_norm("m_vec")})


def latest_record(df: DataFrame, keys: Sequence[str] = CONF_KEYS, step: str = "protocol"
                  ) -> DataFrame:
    """Each conformer's record of its last step, by a mergeable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.col(step)).alias("_r")
    return df.groupBy(*keys).agg(picked).select(*keys, "_r.*")


def pending(conformers: DataFrame, records: DataFrame, protocol: int,
            keys: Sequence[str] = CONF_KEYS) -> DataFrame:
    """Active conformers without a record of the step."""
    done = records.where(F.col("protocol") == protocol).select(*keys)
    return conformers.where("active").join(done, list(keys), "left_anti")


def record_status(df: DataFrame, opt: Column, freq: Column, skip_opt_fail: Column) -> DataFrame:
    """``status`` ok / crashed / not_converged / no_frequencies and the resulting ``active``
    and ``failed``, from ``terminated``, ``converged`` and ``n_freq``. A crash or a permitted
    non-convergence only deactivates; the other two are failures."""
    status = (F.when(~F.col("terminated"), "crashed")
              .when(opt & ~F.col("converged"), "not_converged")
              .when(freq & (F.col("n_freq") == 0), "no_frequencies").otherwise("ok"))
    failed = ((F.col("status") == "no_frequencies")
              | ((F.col("status") == "not_converged") & ~skip_opt_fail))
    return (df.withColumn("status", status).withColumn("active", F.col("status") == "ok")
            .withColumn("failed", failed))


def thresholds_by_level(protocols: DataFrame, defaults: Sequence[tuple] = LEVEL_THRESHOLDS
                        ) -> DataFrame:
    """``level`` and the three pruning thresholds: the user's value, else the level's. The
    defaults are four literals, so they are looked up in a map and nothing is joined."""
    out = protocols.withColumn("level", step_level("opt", "freq"))
    for i, name in enumerate(("thr_g", "thr_b", "thr_gmax"), start=1):
        table = F.create_map(*[F.lit(v) for row in defaults for v in (row[0], float(row[i]))])
        out = out.withColumn(name, F.coalesce(F.col(name), table[F.col("level")]))
    return out


def carry_thermal_correction(df: DataFrame, keys: Sequence[str] = CONF_KEYS) -> DataFrame:
    """A step without frequencies takes g_e, zpve, h and s of the step right before it, as
    completed there: G = E + G_E. Chains over consecutive such steps; a missing step or a
    failed thermochemistry ends the chain. ``own`` says which steps have frequencies."""
    w = W.partitionBy(*keys).orderBy("protocol")
    starts = F.col("own") | F.coalesce(F.col("protocol") - F.lag("protocol").over(w) > 1,
                                       F.lit(True))
    df = df.withColumn("_run", F.sum(starts.cast("int")).over(w))
    run = W.partitionBy(*keys, "_run").orderBy("protocol")
    corr = {c: F.first(F.when(F.col("own"), F.col(c))).over(run) for c in ("g_e", "zpve", "h", "s")}
    df = df.withColumns(corr).withColumn("g", F.col("e") + F.col("g_e"))
    for c in ("zpve", "h", "s"):
        df = df.withColumn(c, F.when(F.col("g").isNotNull(), F.col(c)))
    return df.drop("_run")


def lookback_vectors(df: DataFrame, keys: Sequence[str] = CONF_KEYS) -> DataFrame:
    """Frequencies (non-empty) and rotational constants of the nearest step at or before
    each record, each on its own; constants missing everywhere become [1, 1, 1]."""
    w = W.partitionBy(*keys).orderBy("protocol").rowsBetween(W.unboundedPreceding, 0)
    freq = F.last(F.when(F.size("freq") > 0, F.col("freq")), ignorenulls=True).over(w)
    ones = F.array(*[F.lit(1.0)] * 3)
    return df.withColumns({
        "freq": freq, "b_vec": F.coalesce(F.last("b_vec", ignorenulls=True).over(w), ones)})


def complete_thermochemistry(df: DataFrame, conditions: Conditions = Conditions(),
                             freq_factor: Column | float = 1.0) -> DataFrame:
    """Scale the frequencies and add zpve, h, s, g and g_e where there are any."""
    df = df.withColumn("freq", scaled_frequencies("freq", freq_factor))
    df = with_gibbs(df, c=conditions)
    none = F.coalesce(F.size(real_modes("freq")), F.lit(0)) == 0
    missing = F.lit(None).cast("double")
    df = df.withColumns({c: F.when(none, missing).otherwise(F.col(c))
                         for c in ("zpve", "h", "s", "g")})
    return df.withColumn("g_e", F.col("g") - F.col("e"))
