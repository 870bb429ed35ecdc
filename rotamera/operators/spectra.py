"""Line lists to spectra, measured curves on the grid, comparison and fitting.

Spectra are long tables (keys, graph_type, i, x, y). Their groups have as many rows as the
grid has points, so windows over one spectrum are bounded. Line lists are not, and are
summed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql import types as T

from rotamera.constants import MIN_WEIGHT, NM_EV, NM_THRESHOLD, TEMPERATURE
from rotamera.functions.energy import col, effective_energy
from rotamera.functions.spectral import (CUTOFF, as_nanometres, broadened, default_of, grid_points,
                                         grid_x, is_chiral, is_vibrational, max_scale,
                                         shifted_lines)
from rotamera.operators import KEYS
from rotamera.operators.energy import boltzmann
from rotamera.operators.grouping import (attach, attach_stats, dealt_runs, lookup,
                                         split_by_size, spread)
from rotamera.session import cut_lineage

SPECTRUM = ["ensemble_id", "protocol", "graph_type"]
GRID = 10_000
LINE_LIMIT = 1_000_000   # lines of one spectrum that one task may broaden or fit
PACKED_LINES = 1 << 18    # lines that a task holds while it packs them by spectrum


# --- weighted line lists ------------------------------------------------------

def load_spectra(table: DataFrame, protocols: Sequence[int] | None = None) -> DataFrame:
    """Computed spectra, all or of the listed steps (partition pruned where the table is
    partitioned by step)."""
    return table if protocols is None else table.where(
        F.col("protocol").isin([int(p) for p in protocols]))


def weighted_peaks(peaks: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS,
                   population_from: int | DataFrame | None = None, invert: bool = False) -> DataFrame:
    """Lines of active conformers with weight ``w`` = y·population. Populations come from
    the lines' own step, from step ``population_from``, or, where that is a protocol table, from the step
    that each step's ``read_population`` names (its own where there is none); a table with ensemble
    keys says so for each ensemble. ``invert`` flips chiral types only."""
    conf = [*keys, "conf_id"]
    pops = records.where("active").select(*conf, F.col("protocol").alias("_from"), "pop")
    source = F.col("protocol")
    if isinstance(population_from, DataFrame):
        by = [*[k for k in keys if k in population_from.columns], "protocol"]
        named = population_from.select(*by, F.col("read_population").try_cast("int").alias("_named"))
        peaks = lookup(peaks, named.where(F.col("_named").isNotNull()), by, "left")
        source = F.coalesce("_named", source)
    elif population_from is not None:
        source = F.lit(int(population_from))
    joined = peaks.withColumn("_from", source.cast("int")).join(pops, [*conf, "_from"]).drop("_from", "_named")
    sign = F.when(is_chiral("graph_type") & F.lit(invert), -1.0).otherwise(1.0)
    return joined.withColumn("w", F.col("y") * F.col("pop") * sign)


def has_peaks(peaks: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Active conformers that have lines of a (step, type)."""
    conf = [*keys, "conf_id", "protocol"]
    active = records.where("active").select(*conf)
    lines = peaks.select(*conf, "graph_type").distinct()
    return lines.join(active, conf, "left_semi")


# --- convolution --------------------------------------------------------------

def _partial_spectra(keys: Sequence[str], n: int, cutoff: float):
    """Sum each run of equal keys in a sorted partition onto the grid. State is one run."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, total, nonzero, weighted = None, None, False, False

        def row(values, y, *flags):
            return {**dict(zip(keys, values)), "ys": y, **dict(zip(("nonzero", "weighted"), flags))}

        grids: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = []
            for values, g in pdf.groupby(list(keys), sort=False, dropna=False):
                kind = g["graph_type"].iloc[0]
                if kind not in grids:
                    grids[kind] = grid_points(kind, n)
                if values != current:
                    if current is not None:
                        out.append(row(current, total, nonzero, weighted))
                    current, total, nonzero, weighted = values, np.zeros(n), False, False
                x = g["x"].to_numpy(dtype=float)
                nonzero = nonzero or bool((x != 0).any())
                lines = shifted_lines(x, kind, g["shift"].to_numpy(dtype=float))
                width = g["fwhm"].to_numpy(dtype=float)
                weight = g["w"].to_numpy(dtype=float)
                weighted = weighted or bool((weight != 0).any())
                for f in np.unique(width):
                    pick = width == f
                    total += broadened(grids[kind], lines[pick], weight[pick], kind, [f], cutoff)[0]
            if out:
                yield pd.DataFrame(out)
        if current is not None:
            yield pd.DataFrame([row(current, total, nonzero, weighted)])
    return run


def convolve(lines: DataFrame, n: int = GRID, keys: Sequence[str] = SPECTRUM,
             shift: Column | str | None = None, fwhm: Column | str | None = None,
             limit: int = LINE_LIMIT, cutoff: float = CUTOFF) -> DataFrame:
    """Broaden weighted lines (x, w) onto the type's grid: (keys, i, x, y). A type whose
    lines are all at x = 0 gives nothing. Gaussians end ``cutoff`` standard deviations from
    their centre.

    A task sums the lines of its spectra with NumPy. The lines of a spectrum with more than
    ``limit`` are dealt out over all tasks. Either way a task emits one partial spectrum for
    each spectrum it saw, so there are at most as many parts as tasks, and these are added
    point by point."""
    keys = list(keys)
    s = default_of("graph_type", "shift") if shift is None else col(shift)
    f = default_of("graph_type", "fwhm") if fwhm is None else col(fwhm)
    # lines without weight add nothing, but count when all x = 0 is judged
    rows = (lines.where(F.col("w").isNotNull() & ((F.col("w") != 0) | (F.col("x") != 0)))
            .select(*keys, "x", "w", s.alias("shift"), f.alias("fwhm")))
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("ys", T.ArrayType(T.DoubleType())),
        T.StructField("nonzero", T.BooleanType()), T.StructField("weighted", T.BooleanType())])
    parts = dealt_runs(rows, keys, limit, F.xxhash64("x", "w")).mapInPandas(
        _partial_spectra(keys, n, cutoff), schema)
    # the compact parts are shuffled, by spectrum; the sums per point and any later window
    # over a spectrum then need no shuffle of their own
    return (spread(parts, keys)
            .select(*keys, "nonzero", "weighted", F.posexplode("ys").alias("i", "y"))
            .groupBy(*keys, "i").agg(F.sum("y").alias("y"), F.bool_or("nonzero").alias("_nz"),
                                     F.bool_or("weighted").alias("_w"))
            .where("_nz AND _w").select(*keys, "i", grid_x("i", "graph_type", n).alias("x"), "y"))


def packed_lines(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _x, _w, _n): lines as arrays, a row for each spectrum that stands among some ``PACKED_LINES``
    of a task. A line then costs 16 bytes wherever it goes."""
    keys = list(keys)
    schema = T.StructType([lines.schema[k] for k in keys] + [
        T.StructField("_x", T.ArrayType(T.DoubleType())), T.StructField("_w", T.ArrayType(T.DoubleType())),
        T.StructField("_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            got = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate(
                [("x", "list"), ("w", "list"), ([], "count_all")])
            got = got.rename_columns({"x_list": "_x", "w_list": "_w", "count_all": "_n"})
            return got.select([*keys, "_x", "_w", "_n"]).to_batches()
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= PACKED_LINES:
                yield from packed()
                held, size = [], 0
        if size:
            yield from packed()
    rows = lines.select(*keys, F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"))
    return rows.mapInArrow(run, schema)


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x, w = (np.concatenate([np.asarray(a, dtype=float) for a in rows[c]]) for c in ("_x", "_w"))
    return x, w


def _partial_candidates(keys: Sequence[str], n: int):
    """Sum one part of a spectrum's lines onto the grid for every (shift, width) of its candidate list."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        cands = sorted((c["c_s"], c["c_f"]) for c in head["_c"])
        x, w = _unpacked(pdf)
        kind, total = head["graph_type"], np.zeros((len(cands), n))
        at = grid_points(kind, n)
        for s in sorted({s for s, _ in cands}):
            mine = [i for i, c in enumerate(cands) if c[0] == s]
            total[mine] = broadened(at, shifted_lines(x, kind, s), w, kind, [cands[i][1] for i in mine])
        return pd.DataFrame([[*[head[k] for k in keys], s, f, y] for (s, f), y in zip(cands, total)],
                            columns=[*keys, "c_s", "c_f", "ys"])
    return run


def convolve_candidates(parts: DataFrame, candidates: DataFrame, n: int, keys: Sequence[str],
                        row_bytes: int) -> DataFrame:
    """(keys, c_s, c_f, i, y): spectra of packed lines, dealt out by ``_part``, for each pair in the list
    ``_c`` of (keys, _c). A part emits one sum for each pair, so what is shuffled follows the number
    of parts, which follows that of lines, and not the number of tasks."""
    keys = list(keys)
    rows = attach(parts, candidates, keys, candidates.count(), row_bytes)
    schema = T.StructType([parts.schema[k] for k in keys] + [
        T.StructField("c_s", T.DoubleType()), T.StructField("c_f", T.DoubleType()),
        T.StructField("ys", T.ArrayType(T.DoubleType()))])
    sums = rows.groupBy(*keys, "_part").applyInPandas(_partial_candidates(keys, n), schema)
    ck = [*keys, "c_s", "c_f"]
    return (spread(sums, ck).select(*ck, F.posexplode("ys").alias("i", "y")).groupBy(*ck, "i")
            .agg(F.sum("y").alias("y")))


def max_abs_normalise(spectrum: DataFrame, keys: Sequence[str] = SPECTRUM, lo: str | None = None,
                      hi: str | None = None, only_above_one: bool = False) -> DataFrame:
    """Divide by max |y| over the spectrum, or over points lo <= i < hi where bounds are
    given. ``only_above_one`` leaves spectra alone whose maximum does not exceed 1. An empty
    range or an all-zero spectrum gives NULL."""
    inside = F.lit(True)
    if lo is not None:
        inside = (F.col("i") >= F.col(lo)) & (F.col("i") < F.col(hi))
    top = F.max(F.when(inside, F.abs(F.col("y")))).over(W.partitionBy(*keys))
    scaled = F.when(F.col("_top") > 0, F.col("y") / F.col("_top"))
    if only_above_one:
        scaled = F.when(F.col("_top") > 1, scaled).otherwise(F.col("y"))
    return spectrum.withColumn("_top", top).withColumn("y", scaled).drop("_top")


def default_spectrum(lines: DataFrame, n: int = GRID, keys: Sequence[str] = SPECTRUM
                     ) -> DataFrame:
    """Default shift and width, normalised over the whole range."""
    return max_abs_normalise(convolve(lines, n, keys), keys).where(F.col("y").isNotNull())


# --- measured curves ----------------------------------------------------------

def reference_units(curve: DataFrame, keys: Sequence[str] = ("graph_type",)) -> DataFrame:
    """Scale to max |y| = 1 and turn nanometres into eV: an electronic curve whose smallest
    x exceeds 20 is taken to be in nm."""
    curve = attach_stats(curve, keys, _min=F.min("x"), _top=F.max(F.abs("y")))
    in_nm = ~is_vibrational("graph_type") & (F.col("_min") > NM_THRESHOLD)
    return (curve.withColumn("x", F.when(in_nm, F.lit(NM_EV) / F.col("x")).otherwise(F.col("x")))
            .withColumn("y", F.try_divide("y", "_top")).drop("_min", "_top"))


def _grid_of(table: DataFrame, n: int) -> DataFrame:
    """One row per grid point for each row of a (small) table of curves."""
    return (table.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("gx", grid_x("i", "graph_type", n)))


def interp_to_grid(curve: DataFrame, n: int = GRID, keys: Sequence[str] = ("graph_type",)
                   ) -> DataFrame:
    """Linear interpolation on the type's grid, 0 outside the measured range. Also gives the
    range ``x_min``, ``x_max``.

    The points are first reduced to the first and the last one in each grid interval, a
    mergeable aggregate; all that follows runs over at most n + 1 intervals a curve."""
    keys = list(keys)
    lo, hi = default_of("graph_type", "x_start"), default_of("graph_type", "x_end")
    step = (hi - lo) / F.lit(float(n - 1))
    guess = F.floor((F.col("x") - lo) / step).cast("int")
    cell = (F.when(grid_x(guess + 1, "graph_type", n) <= F.col("x"), guess + 1)
            .when(grid_x(guess, "graph_type", n) > F.col("x"), guess - 1).otherwise(guess))
    cell = F.greatest(F.lit(-1), F.least(F.lit(n - 1), cell))
    point = F.struct("x", "y")
    cells = (curve.withColumn("cell", cell).groupBy(*keys, "cell")
             .agg(F.min(point).alias("first"), F.max(point).alias("last")))
    curves = cells.groupBy(*keys).agg(F.min("first.x").alias("x_min"),
                                      F.max("last.x").alias("x_max"))
    grid = _grid_of(curves, n)
    slots = (grid.select(*keys, "i", "gx", "x_min", "x_max",
                         F.lit(None).cast(cells.schema["first"].dataType).alias("first"),
                         F.lit(None).cast(cells.schema["last"].dataType).alias("last"),
                         F.lit(0).alias("kind"))
             .unionByName(cells.select(*keys, F.col("cell").alias("i"),
                                       F.lit(None).cast("double").alias("gx"),
                                       F.lit(None).cast("double").alias("x_min"),
                                       F.lit(None).cast("double").alias("x_max"),
                                       "first", "last", F.lit(1).alias("kind"))))
    # grid point i comes before interval i: the point's left neighbour is in an earlier
    # interval, its right one in this or a later interval
    up = W.partitionBy(*keys).orderBy("i", "kind").rowsBetween(W.unboundedPreceding, 0)
    down = (W.partitionBy(*keys).orderBy(F.desc("i"), F.desc("kind"))
            .rowsBetween(W.unboundedPreceding, 0))
    left, right = F.last("last", True).over(up), F.last("first", True).over(down)
    y = (F.when(F.col("r.x") == F.col("gx"), F.col("r.y"))
         .when(F.col("l").isNotNull() & F.col("r").isNotNull(),
               F.col("l.y") + (F.col("r.y") - F.col("l.y")) / (F.col("r.x") - F.col("l.x"))
               * (F.col("gx") - F.col("l.x"))).otherwise(0.0))
    return (slots.withColumns({"l": left, "r": right}).where("kind = 0")
            .select(*keys, "i", F.col("gx").alias("x"), y.alias("y"), "x_min", "x_max"))


def with_bounds(on_grid: DataFrame, keys: Sequence[str] = ("graph_type",)) -> DataFrame:
    """``lo``: first point at or above the measured range's start; ``hi``: first point above
    its end, 0 if there is none."""
    w = W.partitionBy(*keys)
    lo = F.min(F.when(F.col("x") >= F.col("x_min"), F.col("i"))).over(w)
    hi = F.min(F.when(F.col("x") > F.col("x_max"), F.col("i"))).over(w)
    return on_grid.withColumns({"lo": F.coalesce(lo, F.lit(0)), "hi": F.coalesce(hi, F.lit(0))})


Interest = Mapping[str, object] | tuple | float | bool | None


def _interest(interest: Interest) -> tuple[Column, Column]:
    """Two columns, NULL where no area is of special interest."""
    def ends(v, i):
        if v is None:
            return F.lit(None).cast("double")
        if v is True:
            return default_of("graph_type", "interest", i)
        if isinstance(v, (tuple, list)) and len(v) == 2:
            return F.lit(float(sorted(v)[i]))
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return F.lit(float(v))
        raise ValueError("an interest area is None, True, a number or a pair")
    if isinstance(interest, Mapping):
        return tuple(F.when(is_vibrational("graph_type"), ends(interest.get("vibro"), i))
                     .otherwise(ends(interest.get("electro"), i)) for i in (0, 1))
    return ends(interest, 0), ends(interest, 1)


def weight_function(on_grid: DataFrame, interest: Interest = None,
                    keys: Sequence[str] = ("graph_type",)) -> DataFrame:
    """``weight``: without an interest area 1 inside the measured range and 0 outside; with
    one a plateau of 1 with half-Gaussian flanks, at least 0.15 inside the range."""
    w = W.partitionBy(*keys)
    at = {n: F.max(F.when(F.col("i") == F.col(c), F.col("x"))).over(w)
          for n, c in (("_l1", "lo"), ("_l2", "hi"))}
    a, b = _interest(interest)
    df = on_grid.withColumns(at).withColumns({"_a": a, "_b": b})

    def bell(centre: str, limit: str) -> Column:
        sigma = F.abs(F.col(limit) - F.col(centre)) * 0.1
        return F.when(sigma > 0, F.exp(-0.5 * F.pow(F.col("x") - F.col(centre), F.lit(2.0))
                                       / (sigma * sigma)))
    df = df.withColumns({"_g1": bell("_a", "_l1"), "_g2": bell("_b", "_l2")})
    df = df.withColumns({"_t1": F.max("_g1").over(w), "_t2": F.max("_g2").over(w)})
    x, l1, l2 = F.col("x"), F.col("_l1"), F.col("_l2")
    shape = (F.when((x >= F.col("_a")) & (x <= F.col("_b")), 1.0)
             .when((l1 < x) & (x < F.col("_a")), F.try_divide("_g1", "_t1"))
             .when((F.col("_b") < x) & (x < l2), F.try_divide("_g2", "_t2")).otherwise(0.0))
    shape = F.greatest(F.coalesce(shape, F.lit(0.0)), F.lit(MIN_WEIGHT))
    inside = (x >= l1) & (x <= l2)
    weight = F.when(~inside, 0.0).when(F.col("_a").isNull(), 1.0).otherwise(shape)
    return df.withColumn("weight", weight).drop(
        "_l1", "_l2", "_a", "_b", "_g1", "_g2", "_t1", "_t2")


def reference_on_grid(curve: DataFrame, n: int = GRID, keys: Sequence[str] = ("graph_type",),
                      interest: Interest = None) -> DataFrame:
    """(keys, i, x, y, weight, lo, hi) of measured curves."""
    on_grid = with_bounds(interp_to_grid(reference_units(curve, keys), n, keys), keys)
    return weight_function(on_grid, interest, keys).drop("x_min", "x_max")


# --- comparison ---------------------------------------------------------------

def diversity(a: Column, b: Column, weight: Column, n: Column, scale: Column) -> Column:
    """√(Σ w(a−b)²/n)/max, an aggregate."""
    return F.sqrt(F.sum(weight * (a - b) * (a - b)) / n) / scale


def similarity(spectrum: DataFrame, reference: DataFrame, keys: Sequence[str] = SPECTRUM,
               ref_keys: Sequence[str] = ("graph_type",), compat: bool = False) -> DataFrame:
    """Percent similarity of normalised spectra to their measured curve over [lo, hi),
    weighted and not. ``compat`` takes the weights from the start of the grid instead of
    from ``lo``, as some published numbers do. An empty range gives NULL."""
    ref = reference.select(*ref_keys, "i", F.col("y").alias("ry"), "weight", "lo", "hi")
    pair = lookup(spectrum, ref, [*ref_keys, "i"]).where(
        (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
    if compat:
        moved = reference.select(*ref_keys, (F.col("i") + F.col("lo")).alias("i"),
                                 F.col("weight").alias("_cw"))
        pair = lookup(pair, moved, [*ref_keys, "i"], "left").withColumn(
            "weight", F.coalesce("_cw", F.lit(0.0))).drop("_cw")
    scale = F.first(max_scale("graph_type"))
    n = F.count(F.lit(1))
    y, ry = F.col("y"), F.col("ry")
    out = pair.groupBy(*keys).agg(
        diversity(y, ry, F.col("weight"), n, scale).alias("diversity"),
        diversity(y, ry, F.lit(1.0), n, scale).alias("diversity_unweighted"))
    top = max_scale("graph_type")
    for c in ("", "_unweighted"):
        out = out.withColumn(f"similarity{c}", (top - F.col(f"diversity{c}")) / top * 100.0)
    return out


def spectrum_convergence(spectrum: DataFrame, keys: Sequence[str] = SPECTRUM) -> DataFrame:
    """Diversity of each step's spectrum from that of the step before, where there is one."""
    rest = [k for k in keys if k != "protocol"]
    w = W.partitionBy(*rest, "i").orderBy("protocol")
    paired = spectrum.withColumns({"_py": F.lag("y").over(w),
                                   "previous": F.lag("protocol").over(w)})
    return (paired.where(F.col("_py").isNotNull()).groupBy(*keys, "previous")
            .agg(diversity(F.col("y"), F.col("_py"), F.lit(1.0), F.count(F.lit(1)),
                           F.first(max_scale("graph_type"))).alias("diversity")))


def overlay(spectrum: DataFrame, reference: DataFrame | None = None,
            keys: Sequence[str] = SPECTRUM, ref_keys: Sequence[str] = ("graph_type",)
            ) -> DataFrame:
    """Computed spectra and, inside its bounds, the measured curve in one table, with an nm
    axis for electronic types. Spectra that exceed 1 inside the bounds are rescaled."""
    comp = spectrum
    if reference is not None:
        bounds = (reference.where("i = 0").select(*ref_keys, "lo", "hi"))
        comp = lookup(comp, bounds, ref_keys, "left")
        known = F.col("hi") > F.col("lo")
        comp = comp.withColumns({"lo": F.when(known, F.col("lo")), "hi": F.when(known, F.col("hi"))})
        comp = max_abs_normalise(comp, keys, "lo", "hi", only_above_one=True).drop("lo", "hi")
    comp = comp.select(*keys, F.concat(F.lit("Protocol "), F.col("protocol")).alias("series"),
                       "i", "x", "y")
    if reference is not None:
        extra = [k for k in keys if k not in ref_keys]
        fill = [F.lit(None).cast(spectrum.schema[k].dataType).alias(k) for k in extra]
        comp = comp.unionByName(
            reference.where((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
            .select(*fill, *ref_keys, F.lit("Experimental").alias("series"), "i", "x", "y"))
    return comp.withColumn("x_nm", F.when(~is_vibrational("graph_type"), as_nanometres("x")))


# --- fitting ------------------------------------------------------------------

def _range(user, name: str) -> tuple[Column, Column]:
    """Search interval: a pair is a range, a number is fixed, None is the type's default."""
    if isinstance(user, Mapping):
        parts = [_range(user.get(k), name) for k in ("vibro", "electro")]
        return tuple(F.when(is_vibrational("graph_type"), parts[0][i]).otherwise(parts[1][i])
                     for i in (0, 1))
    if user is None:
        return default_of("graph_type", name, 0), default_of("graph_type", name, 1)
    if isinstance(user, (tuple, list)):
        return F.lit(float(user[0])), F.lit(float(user[1]))
    return F.lit(float(user)), F.lit(float(user))


def _axis(lo: float, hi: float, points: int) -> np.ndarray:
    return lo + np.arange(points) * ((hi - lo) / max(points - 1, 1))


def _zoomed(best: float, lo: float, hi: float, points: int, limits: tuple[float, float]):
    step = (hi - lo) / max(points - 1, 1)
    return max(best - step, limits[0]), min(best + step, limits[1])


def _narrows_width(done: int, passes: int) -> bool:
    """While the lines are still off their places a wide shape always scores best, so the
    width keeps its whole range for the first half of the passes."""
    return 2 * done >= passes


def _score(y: np.ndarray, ref: np.ndarray, weight: np.ndarray, seen: np.ndarray, n: int,
           scale: float) -> float:
    top = np.abs(y[seen]).max() if seen.any() else 0.0
    if not top > 0:
        return float("nan")
    d = y / top - ref
    return float(np.sqrt((weight * d * d).sum() / n) / scale)


def _fit_in_task(keys: Sequence[str], n: int, points: int, passes: int):
    """Zooming grid search for one spectrum. Only the grid points with a weight enter the
    sum, and only those in [lo, hi) the normalisation, so no others are computed."""
    def run(lines: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "shift", "fwhm", "diversity", "converged"]
        if not len(lines):
            return pd.DataFrame(columns=names)
        if not len(ref):                      # no measured curve: the defaults
            head = lines.iloc[0]
            return pd.DataFrame([[head[k] for k in keys] + [
                head["s_def"], head["f_def"], None, False]], columns=names)
        kind = lines["graph_type"].iloc[0]
        ref = ref.sort_values("i")
        use = ref[(ref["weight"] > 0) | ((ref["i"] >= ref["lo"]) & (ref["i"] < ref["hi"]))]
        i = use["i"].to_numpy()
        at = grid_points(kind, n)[i]
        ry, rw = use["y"].to_numpy(), use["weight"].to_numpy()
        seen = (i >= use["lo"].to_numpy()) & (i < use["hi"].to_numpy())
        scale = 2.0 if kind in ("VCD", "ECD") else 1.0
        x, w = _unpacked(lines)
        head = lines.iloc[0]
        slim, flim = (head["s_lo"], head["s_hi"]), (head["f_lo"], head["f_hi"])
        (s_lo, s_hi), (f_lo, f_hi) = slim, flim
        best = (float("inf"), head["s_def"], head["f_def"])
        for done in range(1, passes + 1):
            shifts = _axis(s_lo, s_hi, points if s_hi > s_lo else 1)
            widths = _axis(f_lo, f_hi, points if f_hi > f_lo else 1)
            for s in shifts:
                totals = broadened(at, shifted_lines(x, kind, s), w, kind, widths)
                for k, f in enumerate(widths):
                    d = _score(totals[k], ry, rw, seen, n, scale)
                    if (d, s, f) < best:
                        best = (d, s, f)
            if not np.isfinite(best[0]) or len(shifts) == len(widths) == 1:    # nothing left to search
                break
            s_lo, s_hi = _zoomed(best[1], s_lo, s_hi, points, slim)
            if _narrows_width(done, passes):
                f_lo, f_hi = _zoomed(best[2], f_lo, f_hi, points, flim)
        found = bool(np.isfinite(best[0]))
        row = [head[k] for k in keys] + [best[1], best[2], best[0] if found else None, found]
        return pd.DataFrame([row], columns=names)
    return run


def _fit_by_passes(lines: DataFrame, reference: DataFrame, keys: list[str], ref_keys: list[str],
                   n: int, points: int, passes: int, limit: int) -> DataFrame:
    """The same search for spectra with too many lines for one task: every pass broadens the packed
    lines, dealt out once in parts of about ``limit``, for all its candidates, adds the parts up and
    picks the best."""
    state = cut_lineage(lines.groupBy(*keys).agg(*[
        F.first(c).alias(c) for c in ("s_lo", "s_hi", "f_lo", "f_hi", "s_def", "f_def")])
        .withColumns({"a_lo": F.col("s_lo"), "a_hi": F.col("s_hi"), "b_lo": F.col("f_lo"),
                      "b_hi": F.col("f_hi"), "best": F.lit(None).cast(
                          "struct<d:double,s:double,f:double>")}))
    if state.where("s_hi > s_lo OR f_hi > f_lo").isEmpty():        # one pair each, nothing to zoom into
        passes = 1
    parts = attach_stats(lines.select(*keys, "_x", "_w", "_n"), keys, _lines=F.sum("_n"))
    dealt = F.pmod(F.xxhash64("_x", "_w"), F.ceil(F.col("_lines") / F.lit(float(limit))))
    parts = cut_lineage(spread(parts.select(*keys, "_x", "_w", dealt.alias("_part")), [*keys, "_part"]))

    def axis(lo: str, hi: str) -> Column:
        last = F.when(F.col(hi) > F.col(lo), F.lit(points - 1)).otherwise(F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.col(lo) + k * (
            (F.col(hi) - F.col(lo)) / F.lit(float(max(points - 1, 1)))))
    ref = reference.select(*ref_keys, "i", F.col("y").alias("ry"), "weight", "lo", "hi")
    for done in range(1, passes + 1):
        cand = (state.select(*keys, F.explode(axis("a_lo", "a_hi")).alias("c_s"),
                             "b_lo", "b_hi")
                .select(*keys, "c_s", F.explode(axis("b_lo", "b_hi")).alias("c_f")))
        packed = cut_lineage(cand.groupBy(*keys).agg(
            F.collect_list(F.struct("c_s", "c_f")).alias("_c")))
        ck = [*keys, "c_s", "c_f"]
        spec = convolve_candidates(parts, packed, n, keys, 100 + 32 * points * points)
        spec = lookup(spec, ref, [*ref_keys, "i"], ready=True)
        spec = max_abs_normalise(spec, ck, "lo", "hi")
        d = (spec.where(F.col("y").isNotNull()).groupBy(*ck)
             .agg(diversity(F.col("y"), F.col("ry"), F.col("weight"), F.lit(n),
                            F.first(max_scale("graph_type"))).alias("d")))
        won = d.groupBy(*keys).agg(F.min(F.struct(
            "d", F.col("c_s").alias("s"), F.col("c_f").alias("f"))).alias("won"))
        state = state.join(won, keys, "left").withColumn(
            "best", F.least("best", "won")).drop("won")
        narrowed = [("a_lo", "a_hi", "best.s", "s_lo", "s_hi")]
        if _narrows_width(done, passes):
            narrowed.append(("b_lo", "b_hi", "best.f", "f_lo", "f_hi"))
        for lo, hi, b, l1, l2 in narrowed:
            step = (F.col(hi) - F.col(lo)) / F.lit(float(max(points - 1, 1)))
            state = state.withColumn("_step", step).withColumns({
                lo: F.coalesce(F.greatest(F.col(b) - F.col("_step"), F.col(l1)), F.col(lo)),
                hi: F.coalesce(F.least(F.col(b) + F.col("_step"), F.col(l2)), F.col(hi))})
        state = cut_lineage(state.drop("_step"))
    return state.select(
        *keys, F.coalesce("best.s", "s_def").alias("shift"),
        F.coalesce("best.f", "f_def").alias("fwhm"), F.col("best.d").alias("diversity"),
        F.col("best").isNotNull().alias("converged"))


def fit_shift_fwhm(lines: DataFrame, reference: DataFrame, n: int = GRID,
                   keys: Sequence[str] = SPECTRUM, ref_keys: Sequence[str] = ("graph_type",),
                   shift=None, fwhm=None, points: int = 7, passes: int = 6,
                   limit: int = LINE_LIMIT) -> DataFrame:
    """(keys, shift, fwhm, diversity, converged): the pair within the bounds whose spectrum
    is least different from the measured curve over the whole grid. A bounded search on
    ``points``² pairs, zoomed in ``passes`` - 1 times; where no pair gives a spectrum, the
    defaults. ``shift`` and ``fwhm``: None, number, pair, or those by vibro / electro."""
    keys, ref_keys = list(keys), list(ref_keys)
    (s0, s1), (f0, f1) = _range(shift, "shift_range"), _range(fwhm, "fwhm_range")
    # sized, counted and fitted: three readings of what may be a costly join
    lines = cut_lineage(packed_lines(lines.where(F.col("w") != 0), keys))
    rows = lines.withColumns({
        "s_lo": s0, "s_hi": s1, "f_lo": f0, "f_hi": f1,
        "s_def": default_of("graph_type", "shift"), "f_def": default_of("graph_type", "fwhm")})
    reference = cut_lineage(reference.select(*ref_keys, "i", "y", "weight", "lo", "hi"))
    small, large = split_by_size(rows, keys, limit, F.sum("_n"))
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField(c, T.DoubleType()) for c in ("shift", "fwhm", "diversity")] + [
        T.StructField("converged", T.BooleanType())])
    # one copy of its curve for every spectrum: n rows each, whatever the number of lines
    wanted = small.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().toDF(*keys)
    wanted = lookup(wanted, reference, ref_keys, ready=True)
    fitted = (spread(small, keys).groupBy(*keys).cogroup(spread(wanted, keys).groupBy(*keys))
              .applyInPandas(_fit_in_task(keys, n, points, passes), schema))
    if large is not None:
        fitted = fitted.unionByName(
            _fit_by_passes(large, reference, keys, ref_keys, n, points, passes, limit))
    return fitted


# --- compositions -------------------------------------------------------------

def fitted_spectrum(lines: DataFrame, reference: DataFrame, n: int = GRID,
                    keys: Sequence[str] = SPECTRUM, ref_keys: Sequence[str] = ("graph_type",),
                    **kw) -> tuple[DataFrame, DataFrame]:
    """(parameters, spectrum normalised over the measured range) after fitting."""
    params = cut_lineage(fit_shift_fwhm(lines, reference, n, keys, ref_keys, **kw))
    chosen = params.select(*keys, F.col("shift").alias("_s"), F.col("fwhm").alias("_f"))
    with_params = attach(lines, chosen, keys, chosen.count()).where(F.col("_s").isNotNull())
    spec = convolve(with_params, n, keys, "_s", "_f")
    bounds = reference.where("i = 0").select(*ref_keys, "lo", "hi")
    spec = lookup(spec, bounds, ref_keys)
    return params, max_abs_normalise(spec, keys, "lo", "hi").drop("lo", "hi")


def spectra(peaks: DataFrame, records: DataFrame, reference: DataFrame | None = None,
            n: int = GRID, keys: Sequence[str] = SPECTRUM,
            ref_keys: Sequence[str] = ("graph_type",), invert: bool = False,
            population_from: int | DataFrame | None = None, shift=None, fwhm=None) -> DataFrame:
    """Spectra of every (ensemble, step, type) at once. Types with a measured curve are
    fitted to it, the others use the defaults."""
    group = [k for k in keys if k not in ("protocol", "graph_type")]
    lines = weighted_peaks(peaks, records, group, population_from, invert)
    if reference is None:
        return default_spectrum(lines, n, keys)
    reference = cut_lineage(reference)
    types = cut_lineage(reference.where("i = 0").select(*ref_keys))
    with_ref = lookup(lines, types, ref_keys, "left_semi", ready=True)
    without = lookup(lines, types, ref_keys, "left_anti", ready=True)
    _, fitted = fitted_spectrum(with_ref, reference, n, keys, ref_keys, shift=shift, fwhm=fwhm)
    plain = default_spectrum(without, n, keys)
    return fitted.unionByName(plain)


def respectra(peaks: DataFrame, records: DataFrame, protocols: Sequence[int],
              population_from: int | DataFrame | None = None, temperature: float = TEMPERATURE,
              **kw) -> DataFrame:
    """Spectra of the listed steps anew, with populations recomputed at ``temperature`` or
    borrowed from one step (0 is a step like any other)."""
    keys = kw.get("keys", SPECTRUM)
    group = [k for k in keys if k not in ("protocol", "graph_type")]
    steps = [int(p) for p in protocols]
    chosen = peaks.where(F.col("protocol").isin(steps))
    if population_from is None:
        active = records.where("active").where(F.col("protocol").isin(steps)).drop("pop", "erel")
        records = boltzmann(active, effective_energy("e", "g"), temperature,
                            [*group, "protocol"])
    return spectra(chosen, records, population_from=population_from, **kw)
