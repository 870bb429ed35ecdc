"""Spectrum grids, type defaults and line shapes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from rotamera.constants import CHIRAL, FWHM_TO_SIGMA, GRAPH_DEFAULTS, NM_EV, VIBRATIONAL
from rotamera.functions.energy import col


def default_of(graph_type: Column | str, name: str, part: int | None = None) -> Column:
    """A type's default, by a literal map: x_start, x_end, shift, fwhm, or one end of
    shift_range, fwhm_range, interest."""
    pairs = []
    for t, d in GRAPH_DEFAULTS.items():
        value = d[name] if part is None else d[name][part]
        pairs += [F.lit(t), F.lit(value)]
    return F.create_map(*pairs)[col(graph_type)]


def is_vibrational(graph_type: Column | str) -> Column:
    return col(graph_type).isin(VIBRATIONAL)


def is_chiral(graph_type: Column | str) -> Column:
    return col(graph_type).isin(CHIRAL)


def max_scale(graph_type: Column | str) -> Column:
    """Largest possible difference of two normalised spectra."""
    return F.when(is_chiral(graph_type), 2.0).otherwise(1.0)


def grid_x(i: Column | str, graph_type: Column | str, n: int) -> Column:
    """Grid point ``i`` of ``n``, both ends included."""
    lo, hi = default_of(graph_type, "x_start"), default_of(graph_type, "x_end")
    return lo + col(i) * ((hi - lo) / F.lit(float(n - 1)))


def grid_points(graph_type: str, n: int) -> np.ndarray:
    d = GRAPH_DEFAULTS[graph_type]
    return d["x_start"] + np.arange(n) * ((d["x_end"] - d["x_start"]) / float(n - 1))


def as_nanometres(ev: Column | str) -> Column:
    return F.lit(NM_EV) / col(ev)


def shifted_lines(x: np.ndarray, graph_type: str, shift) -> np.ndarray:
    """Vibrational lines scale, electronic lines move rigidly."""
    return x * shift if graph_type in VIBRATIONAL else x + shift


CUTOFF = 39.0            # standard deviations
NODES = 22               # of the interpolation in a tile
TILES = 128              # of the grid, for Lorentzians; up to four times as many for many lines
BATCH = 1 << 14          # lines whose polynomials are held at a time
PLAIN = 1 << 20          # line shapes at single points below which tiles do not pay


def broadened(points: np.ndarray, lines: np.ndarray, weight: np.ndarray, graph_type: str,
              widths, cutoff: float = CUTOFF) -> np.ndarray:
    """Sum of all line shapes at ascending ``points``, one row for each of ``widths``.

    Vibrational lines are Lorentzians of unit height, electronic ones Gaussians of unit area.
    Gaussians are left out beyond ``cutoff`` standard deviations; at the default of 39 they are zero in
    double precision, at 10 below 1e-21 of their height. Many lines on many points are summed by tiles, see ``_tiled``; its result is within
    1e-11 of the sum of absolute line heights."""
    order = np.argsort(lines, kind="stable")
    x, w = lines[order], weight[order]
    total = np.zeros((len(widths), len(points)))
    known = w != 0
    x, w = x[known], w[known]
    if graph_type in VIBRATIONAL and len(x) * len(points) > PLAIN:
        # what is summed point by point falls with the number of tiles, what goes by pairs of tiles rises
        tiles = max(TILES, min(4 * TILES, int(1.2 * math.sqrt(len(x))), len(points) // 16))
        return _tiled(points, x, w, [_lorentz(4.0 / (f * f)) for f in widths],
                      (points[-1] - points[0]) / tiles, math.inf, near=1)
    for k, f in enumerate(widths):
        if graph_type in VIBRATIONAL:
            total[k] = _plain(points, x, w, _lorentz(4.0 / (f * f)), math.inf)
            continue
        sigma = f * FWHM_TO_SIGMA
        kernel, reach = _gauss(sigma), cutoff * sigma
        if len(x) * len(points) > PLAIN and sigma * len(points) > 2 * NODES * (points[-1] - points[0]):
            # a Gaussian is smooth over a tile as wide as its deviation, so no line is near
            total[k] = _tiled(points, x, w, [kernel], sigma, reach, near=-1)[0]
        else:
            total[k] = _plain(points, x, w, kernel, reach)
    return total


def _lorentz(scale: float):
    def shape(gap: np.ndarray) -> np.ndarray:
        out = gap * gap
        out *= scale
        out += 1.0
        return np.reciprocal(out, out=out)
    return shape


def _gauss(sigma: float):
    def shape(gap: np.ndarray) -> np.ndarray:
        out = gap * gap
        out *= -0.5 / (sigma * sigma)
        np.exp(out, out=out)
        out *= 1.0 / (sigma * math.sqrt(2.0 * math.pi))
        return out
    return shape


def _plain(points: np.ndarray, x: np.ndarray, w: np.ndarray, kernel, reach: float,
           block: tuple[int, int] = (32, 1024)) -> np.ndarray:
    """Every shape at every point within reach, in blocks that fit the processor cache."""
    total = np.zeros(len(points))
    n_points = block[1]
    for a in range(0, len(points), n_points):
        p = points[a:a + n_points]
        n_lines = block[0] * n_points // len(p)
        lo = np.searchsorted(x, p[0] - reach)
        hi = np.searchsorted(x, p[-1] + reach, side="right")
        for b in range(lo, hi, n_lines):
            end = min(b + n_lines, hi)
            total[a:a + n_points] += w[b:end] @ kernel(p[None, :] - x[b:end, None])
    return total


def _polynomials(t: np.ndarray) -> np.ndarray:
    """Chebyshev polynomials up to ``NODES`` - 1 at ``t``, one column each."""
    out = np.empty((NODES, len(t)))
    out[0], out[1] = 1.0, t
    for q in range(2, NODES):
        out[q] = 2.0 * t * out[q - 1] - out[q - 2]
    return out.T


def _tiled(points: np.ndarray, x: np.ndarray, w: np.ndarray, kernels, width: float, reach: float,
           near: int) -> np.ndarray:
    """The sums of some kernels by tiles of ``width``, one row each. Lines of a tile act through ``NODES`` Chebyshev nodes of it, and what
    they add to another tile is a polynomial through its nodes, so work is in proportion to lines plus
    points plus pairs of tiles. Tiles up to ``near`` apart are summed point by point.

    Error: a line at least three half-widths h from a tile's centre leaves a Lorentzian analytic
    inside the ellipse of parameter 3 + sqrt(8) about it, so the interpolation in either variable
    errs by less than 4 (3 + sqrt(8))**-22 / (2 + sqrt(8)), 1e-17, times the largest value there; a
    Gaussian over h = sigma / 2 by 2 (h / 2 sigma)**22 21!! / 22! of its height, below 1e-20. What is left is
    rounding."""
    node = np.cos((np.arange(NODES) + 0.5) * (np.pi / NODES))
    basis = _polynomials(node).T * (2.0 / NODES)       # values at nodes -> coefficients
    basis[0] *= 0.5
    h, start = 0.5 * width, points[0]
    tile = np.minimum(((points - start) / width).astype(np.int64), int((points[-1] - start) / width))
    tiles = int(tile[-1]) + 1
    most = tiles if math.isinf(reach) else int(reach / width) + 2
    at = np.floor((x - start) / width)
    inside = (at >= -most) & (at < tiles + most)
    local = np.zeros((len(kernels), tiles, NODES))     # values at the nodes of each tile
    centres = start + (np.arange(tiles) + 0.5) * width
    if not inside.all() and math.isinf(reach):         # far off the grid: straight to the nodes
        far = ~inside
        nodes = centres.repeat(NODES) + h * np.tile(node, tiles)
        for part, kernel in zip(local, kernels):
            part += _plain(nodes, x[far], w[far], kernel, reach).reshape(tiles, NODES)
    sx, sw, at = x[inside], w[inside], at[inside].astype(np.int64) + most
    sources = np.zeros((tiles + 2 * most, NODES))
    for a in range(0, len(sx), BATCH):                 # one block of lines at a time
        its = at[a:a + BATCH]
        first = np.flatnonzero(np.r_[True, its[1:] != its[:-1]])
        t = (sx[a:a + BATCH] - start - (its - most + 0.5) * width) / h
        sources[its[first]] += np.add.reduceat(_polynomials(t) * sw[a:a + BATCH, None], first, axis=0)
    sources = sources @ basis
    for apart in range(-(tiles + most) + 1, tiles + most):
        if abs(apart) <= near or abs(apart) > most and not math.isinf(reach):
            continue
        lo, hi = max(0, apart - most), min(tiles, apart + tiles + most)     # target i, source i - apart
        if lo >= hi:
            continue
        part = sources[lo - apart + most:hi - apart + most]
        if part.any():
            gap = apart * width + h * (node[None, :] - node[:, None])
            for values, kernel in zip(local, kernels):
                values[lo:hi] += part @ kernel(gap)
    to_points = _polynomials((points - centres[tile]) / h)
    total = np.stack([(to_points * (values @ basis.T)[tile]).sum(1) for values in local])
    if near >= 0:
        edge = np.searchsorted(tile, np.arange(tiles + 1))
        for i in range(tiles):
            lo, hi = np.searchsorted(at, [i - near + most, i + near + most + 1])
            if lo < hi and edge[i] < edge[i + 1]:
                p = slice(edge[i], edge[i + 1])
                for y, kernel in zip(total, kernels):
                    y[p] += _plain(points[p], sx[lo:hi], sw[lo:hi], kernel, math.inf)
    return total
