"""Geometry scalars. Internal-coordinate indices are 0-based, as in protocol files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from rotamera.constants import ATOMIC_MASSES
from rotamera.functions.energy import col


def _atom(geom: Column, i: int) -> list[Column]:
    point = F.element_at(geom, i + 1)
    return [F.element_at(point, k) for k in (1, 2, 3)]


def _sub(a, b):
    return [x - y for x, y in zip(a, b)]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def internal(geom: Column | str, idx: Sequence[int]) -> Column:
    """Distance in angstrom (2 atoms), angle (3) or dihedral in [0, 360) (4) in degrees."""
    g = col(geom)
    p = [_atom(g, i) for i in idx]
    if len(p) == 2:
        d = _sub(p[1], p[0])
        return F.sqrt(_dot(d, d))
    if len(p) == 3:
        u, v = _sub(p[0], p[1]), _sub(p[2], p[1])
        cosine = F.try_divide(_dot(u, v), F.sqrt(_dot(u, u) * _dot(v, v)))
        return F.degrees(F.acos(F.when(cosine.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    if len(p) == 4:
        b1, b2, b3 = _sub(p[1], p[0]), _sub(p[2], p[1]), _sub(p[3], p[2])
        n1, n2 = _cross(b1, b2), _cross(b2, b3)
        y = _dot(b1, n2) * F.sqrt(_dot(b2, b2))
        angle = F.degrees(F.atan2(y, _dot(n1, n2)))
        return F.when(angle < 0, angle + 360.0).otherwise(angle)
    raise ValueError("an internal coordinate needs 2, 3 or 4 atoms")


def internal_label(idx: Sequence[int]) -> str:
    kind = {2: "B", 3: "A", 4: "D"}[len(idx)]
    return f"{kind} {'-'.join(str(i) for i in idx)}"


def molecular_mass(atoms: Column | str) -> Column:
    """Sum of atomic masses; an unknown symbol gives NULL."""
    masses = F.create_map(*[F.lit(v) for pair in ATOMIC_MASSES for v in pair])
    return F.aggregate(col(atoms), F.lit(0.0), lambda acc, a: acc + masses[a])


def without_hydrogens(atoms: Column | str, geom: Column | str) -> Column:
    """ARRAY<STRUCT<atom, pos>> of the heavy atoms."""
    zipped = F.arrays_zip(col(atoms).alias("atom"), col(geom).alias("pos"))
    return F.filter(zipped, lambda a: a["atom"] != "H")


def distance_matrix(geom: Column | str) -> Column:
    """Plain Euclidean distances, ARRAY<ARRAY<DOUBLE>>."""
    g = col(geom)

    def dist(p: Column, q: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)),
                                  F.lit(0.0), lambda s, x: s + x))
    return F.transform(g, lambda p: F.transform(g, lambda q: dist(p, q)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def distance_spectrum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ascending eigenvalues of each geometry's distance matrix: rotation, translation and
    permutation invariant. Geometries of equal size in an Arrow batch share one LAPACK call."""
    for geoms in batches:
        out: list = [None] * len(geoms)
        by_size: dict[int, list[int]] = {}
        for row, g in enumerate(geoms):
            if g is not None and len(g):
                by_size.setdefault(len(g), []).append(row)
        for size, rows in by_size.items():
            xyz = np.stack([np.stack(list(geoms.iloc[r])) for r in rows]).astype(float)
            gap = xyz[:, :, None, :] - xyz[:, None, :, :]
            values = np.linalg.eigvalsh(np.sqrt((gap * gap).sum(-1)))
            for r, v in zip(rows, values):
                out[r] = v
        yield pd.Series(out)


def spectrum_rmsd(a: Column | str, b: Column | str) -> Column:
    """Root-mean-square difference of two eigenvalue vectors of equal length."""
    sq = F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x) / F.size(col(a)))
