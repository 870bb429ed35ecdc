"""Energy windows, Boltzmann populations, averages and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rotamera.constants import (CAL_TO_J, GAS_CONSTANT, HARTREE_TO_KCAL, MIN_RETENTION,
                                TEMPERATURE)
from rotamera.functions.energy import boltzmann_weight, effective_energy, kcal, known
from rotamera.operators import KEYS
from rotamera.operators.grouping import attach_stats, attach_table, ranked

BASES = ("e", "ezpve", "h", "g")
SPAN = 200.0              # bins in which weights are first summed are at most so many kT wide


class RetentionError(RuntimeError):
    """A step with ``block_on_retention_rate`` lost too much of an ensemble."""


def energy_window(df: DataFrame, threshold: Column | float, keys: Sequence[str] = KEYS,
                  energy: Column | None = None, skip: Column | None = None) -> DataFrame:
    """Add ``rel_kcal`` over the active rows and clear ``active`` where it exceeds
    ``threshold`` (strictly). A row without energy stays. ``skip`` (the no_prune and graph
    flags) leaves a row as it was."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    eff = effective_energy("e", "g") if energy is None else energy
    df = df.withColumn("_eff", F.when(F.col("active"), eff))
    df = attach_stats(df, keys, _min=F.min("_eff"))
    df = df.withColumn("rel_kcal", kcal(F.col("_eff") - F.col("_min")))
    over = F.coalesce(F.col("rel_kcal") > thr, F.lit(False))
    if skip is not None:
        over = over & ~F.coalesce(skip, F.lit(False))
    return df.withColumn("active", F.col("active") & ~over).drop("_eff", "_min")


def relative_energy(df: DataFrame, keys: Sequence[str] = KEYS, energy: Column | None = None,
                    name: str = "erel") -> DataFrame:
    """kcal/mol above the group's lowest active row; inactive rows get NULL."""
    eff = effective_energy("e", "g") if energy is None else energy
    df = df.withColumn("_eff", F.when(F.col("active"), eff))
    df = attach_stats(df, keys, _min=F.min("_eff"))
    return df.withColumn(name, kcal(F.col("_eff") - F.col("_min"))).drop("_eff", "_min")


def _bin_width(temperature: Column, cal_to_j: float) -> Column:
    """A power of two, in hartree, so that floors of bins and distances from them are exact."""
    widest = F.lit(SPAN * GAS_CONSTANT / (1000.0 * cal_to_j * HARTREE_TO_KCAL)) * temperature
    return F.pow(F.lit(2.0), F.floor(F.log2(widest)))


def partition_functions(df: DataFrame, energies: Mapping[str, Column], temperature: Column | float = TEMPERATURE,
                        keys: Sequence[str] = KEYS, cal_to_j: float = CAL_TO_J) -> DataFrame:
    """One row per group: ``_group_rows``, and for each named energy its smallest value ``_m<name>``, how
    many are known ``_c<name>`` and the sum of weights relative to the smallest ``_z<name>``.

    Weights must be taken from the smallest energy, or they overflow, but that is known last. So they are summed
    from the floor of the energy's bin of up to ``SPAN`` kT, a mergeable state (floor, sum), and the bins
    of a group, one or two in an ordinary ensemble, are moved to the smallest energy when they meet.
    Everything comes from one reading of ``df``."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    rows = df.select(*keys, t.alias("_t"), *[known(c).alias(f"_e{n}") for n, c in energies.items()])
    width = _bin_width(F.col("_t"), cal_to_j)
    rows = rows.withColumns({f"_k{n}": F.floor(F.col(f"_e{n}") / width) * width for n in energies})
    parts = rows.groupBy(*keys, "_t", *[f"_k{n}" for n in energies]).agg(
        F.count(F.lit(1)).alias("_group_rows"), *[x for n in energies for x in (
            F.min(f"_e{n}").alias(f"_m{n}"), F.count(f"_e{n}").alias(f"_c{n}"),
            F.sum(boltzmann_weight(kcal(F.col(f"_e{n}") - F.col(f"_k{n}")), F.col("_t"), cal_to_j))
            .alias(f"_s{n}"))])
    whole = parts.groupBy(*keys).agg(
        F.sum("_group_rows").alias("_group_rows"), *[x for n in energies for x in (
            F.min(f"_m{n}").alias(f"_m{n}"), F.sum(f"_c{n}").alias(f"_c{n}"),
            F.collect_list(F.struct(F.col(f"_k{n}").alias("k"), F.col(f"_s{n}").alias("s"), F.col("_t").alias("t")))
            .alias(f"_b{n}"))])

    def moved(n: str) -> Column:
        return F.aggregate(F.filter(f"_b{n}", lambda b: b["s"].isNotNull()), F.lit(0.0), lambda z, b: z + b["s"]
                           * boltzmann_weight(kcal(b["k"] - F.col(f"_m{n}")), b["t"], cal_to_j))
    return whole.select(*keys, "_group_rows", *[x for n in energies for x in (
        f"_m{n}", f"_c{n}", moved(n).alias(f"_z{n}"))])


def boltzmann(df: DataFrame, energies: Mapping[str, Column] | Column | str,
              temperature: Column | float = TEMPERATURE, keys: Sequence[str] = KEYS,
              skip_missing: bool = False, cal_to_j: float = CAL_TO_J) -> DataFrame:
    """Populations in percent over every row of ``df`` (filter to the active ones first).

    One energy adds ``erel`` and ``pop``; a mapping of several adds ``erel_<name>`` and
    ``pop_<name>`` for each, still in one aggregation. By default one missing energy makes
    its whole group NULL; ``skip_missing`` distributes over the known ones."""
    named = ({f"_{k}": v for k, v in energies.items()} if isinstance(energies, Mapping)
             else {"": F.col(energies) if isinstance(energies, str) else energies})
    state = partition_functions(df, named, temperature, keys, cal_to_j)
    df = attach_table(df, state.withColumn("_rows", F.col("_group_rows")), keys)
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    width = _bin_width(t, cal_to_j)
    for n, c in named.items():
        # the weight in the two steps that the sum has taken, so that both round alike
        floor = F.floor(known(c) / width) * width
        weight = (boltzmann_weight(kcal(known(c) - floor), t, cal_to_j)
                  * boltzmann_weight(kcal(floor - F.col(f"_m{n}")), t, cal_to_j))
        whole = F.lit(True) if skip_missing else F.col(f"_c{n}") == F.col("_rows")
        df = df.withColumns({f"erel{n}": F.when(whole, kcal(known(c) - F.col(f"_m{n}"))),
                             f"pop{n}": F.when(whole, weight / F.col(f"_z{n}") * 100.0)})
    return df.drop("_rows", *[f"_{p}{n}" for n in named for p in "mcz"])


def weighted_average(df: DataFrame, energies: Mapping[str, tuple[str, str]],
                     keys: Sequence[str] = KEYS, **more: Column) -> DataFrame:
    """Σ e·pop/100 per group over rows having both; none gives NULL. ``more`` are further
    aggregates of the same pass."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.col(e) * F.col(p) / 100.0).alias(n) for n, (e, p) in energies.items()],
        F.count(F.lit(1)).alias("n_conf"), *[c.alias(n) for n, c in more.items()])


def window_summary(df: DataFrame, threshold: Column | float, temperature: Column | float = TEMPERATURE,
                   keys: Sequence[str] = KEYS, energy: Column | None = None, cal_to_j: float = CAL_TO_J
                   ) -> DataFrame:
    """(keys, n_conf, e_av, top_pop, max_erel) of the active rows in each group's energy window: what
    ``energy_window``, ``boltzmann`` and ``weighted_average`` give one after the other, in two readings of
    ``df``. The first finds the smallest energies; in the second all weights are relative to them, so every
    sum is a mergeable aggregate and populations need not go back to the rows. Groups without a row in the
    window are left out; a missing energy stays in the window and makes the other numbers NULL."""
    eff = effective_energy("e", "g") if energy is None else energy
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    rows = df.where("active").select(*keys, known(eff).alias("_e"), thr.alias("_thr"), t.alias("_t"))
    rows = attach_stats(rows, keys, _m=F.min("_e")).withColumn("_rel", kcal(F.col("_e") - F.col("_m")))
    rows = rows.where(~F.coalesce(F.col("_rel") > F.col("_thr"), F.lit(False)))
    rows = rows.withColumn("_w", boltzmann_weight(F.col("_rel"), F.col("_t"), cal_to_j))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_conf"), F.count("_e").alias("_c"), F.sum("_w").alias("_z"),
        F.sum(F.col("_e") * F.col("_w")).alias("_ew"), F.max("_w").alias("_top"), F.max("_rel").alias("_last"))
    whole = F.col("_c") == F.col("n_conf")
    return out.select(*keys, "n_conf", F.when(whole, F.col("_ew") / F.col("_z")).alias("e_av"),
                      F.when(whole, F.col("_top") / F.col("_z") * 100.0).alias("top_pop"),
                      F.when(whole, F.col("_last")).alias("max_erel"))


def with_bases(df: DataFrame) -> DataFrame:
    """The four energies of a report: E, E+ZPVE, E+H (h is a correction) and G."""
    return (df.withColumn("basis_e", known("e"))
            .withColumn("basis_ezpve", known("e") + known("zpve"))
            .withColumn("basis_h", known("e") + known("h"))
            .withColumn("basis_g", known("g")))


def energy_report(df: DataFrame, temperature: Column | float = TEMPERATURE,
                  keys: Sequence[str] = ("ensemble_id", "protocol"),
                  skip_missing: bool = False) -> DataFrame:
    """Per conformer the four energies, each with a population of its own."""
    df = with_bases(df)
    return boltzmann(df, {b: F.col(f"basis_{b}") for b in BASES}, temperature, keys,
                     skip_missing)


def ensemble_averages(report: DataFrame, keys: Sequence[str] = ("ensemble_id", "protocol")
                      ) -> DataFrame:
    """The report's four population-weighted averages per group."""
    return weighted_average(report, {f"{b}_av": (f"basis_{b}", f"pop_{b}") for b in BASES},
                            keys)


def protocol_arithmetic(averages: DataFrame, operations: Sequence[tuple[int, str, int]],
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """avg(P1) ± avg(P2) in kcal/mol for each of the four energies. A group lacking one of
    the steps gets NULLs and ``status = 'missing'``. The operands are picked by conditional
    aggregates, so any number of operations costs one shuffle and no join."""
    for _, op, _ in operations:
        if op not in "+-" or len(op) != 1:
            raise ValueError(f"operation must be + or -, got {op!r}")
    steps = sorted({p for a, _, b in operations for p in (a, b)})
    picked = averages.groupBy(*keys).agg(*[
        F.max(F.when(F.col("protocol") == p, F.col(f"{b}_av"))).alias(f"_{b}_{p}")
        for p in steps for b in BASES], *[
        F.max(F.when(F.col("protocol") == p, F.lit(1))).alias(f"_has_{p}") for p in steps])
    rows = []
    for p1, op, p2 in operations:
        fields = [F.lit(f"{p1} {op} {p2}").alias("operation")]
        for b in BASES:
            x, y = F.col(f"_{b}_{p1}"), F.col(f"_{b}_{p2}")
            fields.append(kcal(x - y if op == "-" else x + y).alias(f"{b}_kcal"))
        both = F.col(f"_has_{p1}").isNotNull() & F.col(f"_has_{p2}").isNotNull()
        fields.append(F.when(both, "ok").otherwise("missing").alias("status"))
        rows.append(F.struct(*fields))
    return picked.select(*keys, F.inline(F.array(*rows)))


def energy_rank(df: DataFrame, keys: Sequence[str] = KEYS, conf: str = "conf_id",
                energy: Column | None = None) -> DataFrame:
    """Position by effective energy, inactive rows last, ties by conformer id."""
    eff = effective_energy("e", "g") if energy is None else energy
    return ranked(df, keys, [F.col("active").desc(), eff.asc_nulls_last(), F.col(conf)],
                  "energy_rank")


def retention(df: DataFrame, before: Column, after: Column, keys: Sequence[str] = KEYS,
              minimum: float = MIN_RETENTION, explicit_clusters: bool = False) -> DataFrame:
    """Share of each ensemble's active members that survived a step, 1.0 when there were
    none. ``alert`` marks a share under ``minimum`` unless a set number of clusters was
    asked for."""
    rate = F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).otherwise(1.0)
    alert = (F.col("retention") < minimum) & F.lit(not explicit_clusters)
    return (df.groupBy(*keys).agg(F.count_if(before).alias("n_before"),
                                  F.count_if(after).alias("n_after"))
            .withColumn("retention", rate).withColumn("alert", alert))


def block_on_retention(report: DataFrame) -> DataFrame:
    """Raise if any ensemble's retention report carries an alert."""
    bad = report.where("alert").take(1)
    if bad:
        raise RetentionError(f"too few members left in at least one ensemble: {bad[0]}")
    return report


def step_summary(df: DataFrame, keys: Sequence[str] = ("ensemble_id", "protocol"),
                 active_before: Column | None = None) -> DataFrame:
    """Members before and after a step, and its elapsed time in total and per member."""
    before = F.lit(True) if active_before is None else active_before
    return df.groupBy(*keys).agg(
        F.count_if(before).alias("n_before"), F.count_if(F.col("active")).alias("n_after"),
        F.sum("elapsed_s").alias("elapsed_total_s"), F.avg("elapsed_s").alias("elapsed_mean_s"))
