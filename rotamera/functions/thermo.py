"""Quasi-rigid-rotor harmonic-oscillator thermochemistry as Column expressions.

Energies are in hartree, frequencies and rotational constants in cm-1, temperature in K,
pressure in kPa, molar mass in g/mol. Each sum over modes is one fold over the array, so a
row never leaves its partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from rotamera.constants import (AVOGADRO, BOLTZMANN, DAMP_EXPONENT, FREQ_CUTOFF,
                                JOULE_TO_HARTREE, LIGHT_SPEED_CM, PLANCK, PRESSURE,
                                TEMPERATURE)
from rotamera.functions.energy import col, real_modes

QUANTUM = PLANCK * LIGHT_SPEED_CM     # J per cm-1


@dataclass(frozen=True)
class Conditions:
    """Where the thermochemistry is evaluated. ``temperature`` may be a Column."""

    temperature: Column | float = TEMPERATURE
    pressure: float = PRESSURE
    cutoff: float = FREQ_CUTOFF
    alpha: float = DAMP_EXPONENT
    linear: bool = False

    @property
    def t(self) -> Column:
        if isinstance(self.temperature, Column):
            return self.temperature
        return F.lit(float(self.temperature))


def _sum(modes: Column, term) -> Column:
    return F.aggregate(modes, F.lit(0.0), lambda acc, v: acc + term(v))


def _reduced(v: Column, c: Conditions) -> Column:
    return v * F.lit(QUANTUM / BOLTZMANN) / c.t


def damp(v: Column, c: Conditions = Conditions()) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(float(c.cutoff)) / v, F.lit(float(c.alpha))))


def zero_point(modes: Column) -> Column:
    return _sum(modes, lambda v: v) * F.lit(0.5 * QUANTUM * JOULE_TO_HARTREE)


def translational_energy(c: Conditions = Conditions()) -> Column:
    return c.t * F.lit(1.5 * BOLTZMANN * JOULE_TO_HARTREE)


def rotational_energy(c: Conditions = Conditions()) -> Column:
    return c.t * F.lit((1.0 if c.linear else 1.5) * BOLTZMANN * JOULE_TO_HARTREE)


def mode_energy(v: Column, c: Conditions = Conditions()) -> Column:
    """Thermal energy of one harmonic mode, in joule."""
    decay = F.exp(-_reduced(v, c))
    return F.try_divide(v * F.lit(QUANTUM) * decay, 1.0 - decay)


def vibrational_energy(modes: Column, c: Conditions = Conditions()) -> Column:
    def term(v: Column) -> Column:
        d = damp(v, c)
        return d * mode_energy(v, c) + (1.0 - d) * c.t * F.lit(0.5 * BOLTZMANN)
    return _sum(modes, term) * F.lit(JOULE_TO_HARTREE)


def translational_entropy(mass: Column, c: Conditions = Conditions()) -> Column:
    per_volume = F.pow(mass * c.t * F.lit(2 * math.pi * BOLTZMANN
                                          / (1000.0 * AVOGADRO * PLANCK ** 2)), F.lit(1.5))
    volume = c.t * F.lit(BOLTZMANN / (1000.0 * c.pressure))
    return (F.lit(2.5) + F.ln(per_volume * volume)) * F.lit(BOLTZMANN * JOULE_TO_HARTREE)


def rotational_entropy(b_vec: Column, c: Conditions = Conditions(), symmetry: int = 1) -> Column:
    if c.linear:
        q = F.try_divide(c.t, F.element_at(b_vec, 1) * F.lit(QUANTUM / BOLTZMANN))
        extra = 1.0
    else:
        product = F.aggregate(b_vec, F.lit(1.0),
                              lambda a, x: a * x * F.lit(QUANTUM / BOLTZMANN))
        q = F.sqrt(F.try_divide(F.lit(math.pi) * F.pow(c.t, F.lit(3.0)), product))
        extra = 1.5
    return (F.ln(q / F.lit(float(symmetry))) + F.lit(extra)) * F.lit(
        BOLTZMANN * JOULE_TO_HARTREE)


def mode_entropy_oscillator(v: Column, c: Conditions = Conditions()) -> Column:
    """Harmonic-oscillator entropy of one mode, in J/K."""
    f = _reduced(v, c)
    return F.lit(BOLTZMANN) * (F.try_divide(f, F.exp(f) - 1.0) - F.ln(1.0 - F.exp(-f)))


def mean_inertia(b_vec: Column) -> Column:
    """h divided by the mean rotational frequency."""
    total = F.aggregate(b_vec, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(F.lit(PLANCK / LIGHT_SPEED_CM) * F.size(b_vec), total)


def mode_entropy_rotor(v: Column, inertia: Column, c: Conditions = Conditions()) -> Column:
    """Free-rotor entropy of one mode, in J/K."""
    mu = F.lit(PLANCK / (8 * math.pi ** 2 * LIGHT_SPEED_CM)) / v
    f = mu * inertia / (mu + inertia) * c.t * F.lit(
        8 * math.pi ** 3 * BOLTZMANN / PLANCK ** 2)
    return F.lit(BOLTZMANN) * (0.5 + 0.5 * F.ln(f))


def vibrational_entropy(modes: Column, inertia: Column, c: Conditions = Conditions()) -> Column:
    def term(v: Column) -> Column:
        d = damp(v, c)
        return (d * mode_entropy_oscillator(v, c)
                + (1.0 - d) * mode_entropy_rotor(v, inertia, c))
    return _sum(modes, term) * F.lit(JOULE_TO_HARTREE)


def electronic_entropy(multiplicity: Column) -> Column:
    return F.ln(multiplicity.cast("double")) * F.lit(BOLTZMANN * JOULE_TO_HARTREE)


def gibbs(e: Column | str, freq: Column | str, mass: Column | str, b_vec: Column | str,
          mult: Column | str, c: Conditions = Conditions()) -> Column:
    """STRUCT<g, zpve, h, s>; ``h`` is the thermal correction, so total enthalpy is e + h.
    Where a formula has no value, as with a zero rotational constant, the result is NULL."""
    modes, b_vec = real_modes(freq), col(b_vec)
    zpve = zero_point(modes)
    h = (zpve + translational_energy(c)
         + F.when(zpve > 0, rotational_energy(c)).otherwise(0.0)
         + vibrational_energy(modes, c) + c.t * F.lit(BOLTZMANN * JOULE_TO_HARTREE))
    s = (translational_entropy(col(mass), c) + rotational_entropy(b_vec, c)
         + vibrational_entropy(modes, mean_inertia(b_vec), c)
         + electronic_entropy(col(mult)))
    return F.struct((col(e) + h - c.t * s).alias("g"), zpve.alias("zpve"), h.alias("h"),
                    s.alias("s"))


def with_gibbs(df, e="e", freq="freq", mass="mass", b_vec="b_vec", mult="mult",
               c: Conditions = Conditions()):
    """Add g, zpve, h, s. The folds are evaluated once per row: ``h`` and ``s`` are first
    made columns of their own and ``g`` is put together from them."""
    modes, bv = F.col("_modes"), col(b_vec)
    df = (df.withColumn("_modes", real_modes(freq))
          .withColumn("zpve", zero_point(modes))
          .withColumn("h", F.col("zpve") + translational_energy(c)
                      + F.when(F.col("zpve") > 0, rotational_energy(c)).otherwise(0.0)
                      + vibrational_energy(modes, c)
                      + c.t * F.lit(BOLTZMANN * JOULE_TO_HARTREE))
          .withColumn("_inertia", mean_inertia(bv))
          .withColumn("s", translational_entropy(col(mass), c) + rotational_entropy(bv, c)
                      + vibrational_entropy(modes, F.col("_inertia"), c)
                      + electronic_entropy(col(mult)))
          .withColumn("g", col(e) + F.col("h") - c.t * F.col("s")))
    return df.drop("_modes", "_inertia")
