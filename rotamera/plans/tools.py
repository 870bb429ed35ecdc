"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rotamera.constants import CAL_TO_J, GAS_CONSTANT, HARTREE_TO_KCAL

K = f"{HARTREE_TO_KCAL!r}e0"


def r(c: Column | str, digits: int = 6) -> Column:
    """Round, and turn a negative zero into zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def above(c: Column | str) -> Column:
    """kcal/mol above -100 hartree: the test energies have few decimals, and rounding them as
    they are would meet exact ties."""
    return r(((F.col(c) if isinstance(c, str) else c) + 100.0) * HARTREE_TO_KCAL, 5)


def above_sql(expr: str) -> str:
    return rs(f"({expr} + 100)*{K}", 5)


def weight_sql(excess_kcal: str, temperature: str = "298.15e0") -> str:
    return f"exp(-({excess_kcal}) * {1000.0 * CAL_TO_J!r}e0 / ({GAS_CONSTANT!r}e0 * {temperature}))"
