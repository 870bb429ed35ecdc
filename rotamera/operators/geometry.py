"""Geometry features of conformers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rotamera.functions.geometry import (distance_matrix, distance_spectrum, internal,
                                         internal_label, molecular_mass, spectrum_rmsd,
                                         without_hydrogens)
from rotamera.operators import KEYS


def drop_hydrogens(df: DataFrame) -> DataFrame:
    """``atoms`` and ``geom`` of the heavy atoms only."""
    return (df.withColumn("_heavy", without_hydrogens("atoms", "geom"))
            .withColumns({"atoms": F.col("_heavy.atom"), "geom": F.col("_heavy.pos")})
            .drop("_heavy"))


def with_features(df: DataFrame, include_h: bool = True, name: str = "features") -> DataFrame:
    """The ascending distance-matrix spectrum of each conformer."""
    geom = F.col("geom") if include_h else without_hydrogens("atoms", "geom")["pos"]
    return df.withColumn(name, distance_spectrum(geom))


def with_internals(df: DataFrame, monitored: Sequence[Sequence[int]]) -> DataFrame:
    """One column per monitored internal coordinate, named like ``B 0-1``."""
    return df.withColumns({internal_label(ix): internal("geom", ix) for ix in monitored})


def with_mass(df: DataFrame) -> DataFrame:
    return df.withColumn("mass", molecular_mass("atoms"))


def atom_pairs(df: DataFrame, keys: Sequence[str] = (*KEYS, "conf_id")) -> DataFrame:
    """Distances of all atom pairs i < j of each molecule, computed in place."""
    rows = df.select(*keys, F.posexplode(distance_matrix("geom")).alias("i", "_row"))
    return (rows.select(*keys, "i", F.posexplode("_row").alias("j", "distance"))
            .where("i < j"))


def removal_report(links: DataFrame, conformers: DataFrame, keys: Sequence[str] = KEYS,
                   conf: str = "conf_id", include_h: bool = True) -> DataFrame:
    """For each removed conformer the differences from the one that removed it, among them
    the distance-spectrum RMSD. Geometries are looked up for the matched pairs only."""
    from rotamera.functions.energy import kcal
    keys = list(keys)
    rows = conformers.select(*keys, conf, "atoms", "geom", "e", "b", "m")
    ref = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in
                               (conf, "atoms", "geom", "e", "b", "m")])
    pairs = (links.withColumnRenamed("deactivated_by", f"_{conf}")
             .join(rows, [*keys, conf]).join(ref, [*keys, f"_{conf}"]))

    def geom(p: str):
        return F.col(f"{p}geom") if include_h else without_hydrogens(f"{p}atoms", f"{p}geom")["pos"]
    pairs = pairs.withColumns({"_l1": distance_spectrum(geom("")),
                               "_l2": distance_spectrum(geom("_"))})
    return pairs.select(
        *keys, F.col(conf).alias("check_id"), F.col(f"_{conf}").alias("ref_id"),
        kcal(F.abs(F.col("e") - F.col("_e"))).alias("delta_e"),
        F.abs(F.col("b") - F.col("_b")).alias("delta_b"),
        F.abs(F.col("m") - F.col("_m")).alias("delta_m"),
        spectrum_rmsd("_l1", "_l2").alias("rmsd"))
