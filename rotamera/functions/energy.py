"""Energy and record scalars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rotamera.constants import CAL_TO_J, GAS_CONSTANT, HARTREE_TO_KCAL


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """NaN, the text formats' mark for a missing number, as NULL."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def effective_energy(e: Column | str, g: Column | str) -> Column:
    """Free energy where there is one, else electronic energy."""
    return F.coalesce(known(g), known(e))


def vector_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x * x))


def kcal(hartree: Column) -> Column:
    return hartree * F.lit(HARTREE_TO_KCAL)


def boltzmann_weight(excess_kcal: Column, temperature: Column | float,
                     cal_to_j: float = CAL_TO_J) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return F.exp(-excess_kcal * F.lit(1000.0 * cal_to_j) / (F.lit(GAS_CONSTANT) * t))


def step_level(opt: Column | str, freq: Column | str) -> Column:
    """SP, OPT, FREQ or OPT+FREQ."""
    rank = (F.coalesce(col(opt), F.lit(False)).cast("int")
            + 2 * F.coalesce(col(freq), F.lit(False)).cast("int"))
    names = F.array(*[F.lit(n) for n in ("SP", "OPT", "FREQ", "OPT+FREQ")])
    return F.element_at(names, rank + 1)


def scaled_frequencies(freq: Column | str, factor: Column | float = 1.0) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(col(freq), lambda x: x * f)


def real_modes(freq: Column | str) -> Column:
    """The modes that enter thermochemistry."""
    return F.filter(col(freq), lambda x: x > 0)


def imaginary_modes(freq: Column | str) -> Column:
    return F.filter(col(freq), lambda x: x < 0)
