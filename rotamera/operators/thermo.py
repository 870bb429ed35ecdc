"""Thermochemistry at other conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rotamera.functions.energy import known
from rotamera.functions.thermo import Conditions, with_gibbs
from rotamera.operators.energy import BASES, boltzmann
from rotamera.operators.records import CONF_KEYS, lookback_vectors
from rotamera.session import cut_lineage


def retemper(records: DataFrame, temperatures: Sequence[float], conditions: Conditions = Conditions(),
             keys: Sequence[str] = ("ensemble_id", "protocol"),
             conf_keys: Sequence[str] = CONF_KEYS) -> DataFrame:
    """Thermochemistry and populations anew at each temperature, over active rows that have
    a population. Frequencies and constants are looked up in earlier steps first. The short
    list of temperatures is exploded onto the rows, so one job serves a whole scan.

    Adds ``temperature``, the four energies ``basis_*`` and their ``pop_*``. Needs freq,
    b_vec, mass and mult."""
    df = lookback_vectors(records, conf_keys)
    df = df.where("active").where(known("pop").isNotNull() & known("e").isNotNull())
    df = df.drop("pop", "erel", "g", "h", "s", "zpve")
    temps = F.array(*[F.lit(float(t)) for t in temperatures])
    df = df.withColumn("temperature", F.explode(temps))
    at = Conditions(F.col("temperature"), conditions.pressure, conditions.cutoff,
                    conditions.alpha, conditions.linear)
    df = with_gibbs(df, c=at)
    has = F.coalesce(F.size("freq") > 0, F.lit(False))
    df = df.withColumns({
        "basis_e": F.col("e"), "basis_ezpve": F.when(has, F.col("e") + F.col("zpve")),
        "basis_h": F.when(has, F.col("e") + F.col("h")), "basis_g": F.when(has, known("g"))})
    # the populations need the energies three times; compute the sums over modes once
    return boltzmann(cut_lineage(df), {b: F.col(f"basis_{b}") for b in BASES}, F.col("temperature"),
                     [*keys, "temperature"], skip_missing=True)
