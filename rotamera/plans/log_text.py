"""Output texts of both dialects, rendered from a table of numbers. Used to build corpora that
the log sources are then run on; the numbers themselves are what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rotamera.constants import GHZ_PER_WAVENUMBER, WAVENUMBERS_PER_EV
from rotamera.operators.grouping import spread
from rotamera.plans.views import table

STATES = 6


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a calculation of each conformer would have printed."""
    v = F.col("embedding")

    def part(first: int, count: int, f=lambda x: x):
        return F.transform(F.slice(v, first + 1, count), lambda x: f(x.cast("double")))
    atoms = F.transform(F.sequence(F.lit(0), F.lit(20)),
                        lambda i: F.when(i % 3 == 0, "H").otherwise("C"))
    geom = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(
        F.slice(v, i * 3 + 1, F.lit(3)), lambda x: x.cast("double")))
    # rendering is heavy per byte and the tables are single small files
    return spread(table(spark, sf_dir, "embeddings"), ["vec_id"]).select(
        F.col("label").cast("long").alias("ensemble_id"), F.col("vec_id").alias("conf_id"),
        F.lit(1).alias("protocol"), atoms.alias("atoms"), geom.alias("geom"),
        (v[63].cast("double") / 100 - 100).alias("e"),
        part(0, 24, lambda x: x * 1000).alias("freq"),
        part(24, 24, F.abs).alias("ir_y"), part(40, 24).alias("vcd_y"),
        part(24, 3, lambda x: F.abs(x) + 0.01).alias("b_vec"), part(27, 3).alias("m_vec"),
        part(30, STATES, lambda x: F.abs(x) * 5 + 2).alias("ev"),
        part(36, STATES, F.abs).alias("fosc"), part(42, STATES, lambda x: x * 10).alias("rot"),
        (F.col("vec_id") % 4 == 0).alias("old"), (F.col("vec_id") % 17 != 0).alias("finished"),
        (F.col("vec_id") % 5 != 0).alias("optimised"))


def _rows(arrays: list[str], line) -> Column:
    zipped = F.arrays_zip(*arrays)
    return F.array_join(F.transform(zipped, lambda z, i: line(i, *[z[a] for a in arrays])), "\n")


def _f(fmt: str, *cols: Column) -> Column:
    return F.format_string(fmt, *cols)


_RULE = "-" * 60


def orca_text() -> Column:
    geom = _rows(["atoms", "geom"], lambda i, a, g: _f("  %s   %.12f   %.12f   %.12f", a, g[0], g[1], g[2]))
    freq = _rows(["freq"], lambda i, x: _f("%6d:   %.10f cm**-1", i.cast("int") + 6, x))
    ir = _rows(["freq", "ir_y"], lambda i, x, y: _f(
        "%4d:   %.10f   0.000100   %.12f  0.000001  ( 0.0  0.0  0.0)", i.cast("int") + 6, x, y))
    vcd = _rows(["freq", "vcd_y"], lambda i, x, y: _f("%4d:   %.10f   %.12f", i.cast("int") + 6, x, y))

    def transitions(y: str) -> Column:
        return F.when(~F.col("old"), _rows(["ev", y], lambda i, x, s: _f(
            "  0-1A  ->  %d-1A    %.12f   %.6f   %.3f   %.12f   0.1   0.1   0.1   0.1",
            i.cast("int") + 1, x, x * WAVENUMBERS_PER_EV, 1239.8 / x, s))).otherwise(
            _rows(["ev", y], lambda i, x, s: _f("  %d   %.10f   %.3f   %.12f   0.1   0.1   0.1   0.1",
                                                i.cast("int") + 1, x * WAVENUMBERS_PER_EV, 1239.8 / x, s)))
    two = "     column titles\n     (units)\n"
    ecd_title = F.when(F.col("old"), F.lit("CD SPECTRUM\n")).otherwise(
        F.lit("CD SPECTRUM VIA TRANSITION ELECTRIC DIPOLE MOMENTS    \n"))
    head = f"CARTESIAN COORDINATES (ANGSTROEM)\n{'-' * 33}\n"
    return F.concat(
        _f("Program Version %d.0.1\n\n", F.when(F.col("old"), 5).otherwise(6)),
        F.lit(head + "  C   9.000000   9.000000   9.000000\n\nFINAL SINGLE POINT ENERGY      -1.500000\n\n" + head),
        geom, F.lit("\n\n"),
        _f("FINAL SINGLE POINT ENERGY      %.12f\n\n", F.col("e")),
        _f("Rotational constants in cm-1:   %.12f   %.12f   %.12f\n", *[F.col("b_vec")[i] for i in range(3)]),
        _f("Total Dipole Moment    :      %.12f   %.12f   %.12f\n\n", *[F.col("m_vec")[i] for i in range(3)]),
        F.lit(f"VIBRATIONAL FREQUENCIES\n{'-' * 23}\n\n     0:   0.00 cm**-1\n"), freq, F.lit("\n\n\n"),
        F.lit("IR SPECTRUM\n\n Mode   freq       eps      Int      T**2         TX        TY        TZ\n"
              f"       cm**-1   L/(mol*cm) km/mol    a.u.\n{_RULE}\n"), ir, F.lit("\n\n"),
        F.when(~F.col("old"), F.concat(F.lit(
            f"VCD SPECTRUM\n\n Mode   Freq    VCD-Intensity    \n       (1/cm) (1E-44*esu^2*cm^2) \n{_RULE}\n"),
            vcd, F.lit("\n\n"))).otherwise(""),
        F.lit(f"EXCITED STATE SPECTRA\n\nABSORPTION SPECTRUM VIA TRANSITION ELECTRIC DIPOLE MOMENTS    \n{_RULE}\n{two}{_RULE}\n"),
        transitions("fosc"), F.lit("\n\n"), ecd_title, F.lit(f"{_RULE}\n{two}{_RULE}\n"),
        transitions("rot"), F.lit("\n\n*** end ***\n"),
        F.when(F.col("optimised"), F.lit("THE OPTIMIZATION HAS CONVERGED\n")).otherwise(""),
        F.when(F.col("finished"), F.lit("ORCA TERMINATED NORMALLY\n")).otherwise("aborted\n"))


def gaussian_text() -> Column:
    geom = _rows(["atoms", "geom"], lambda i, a, g: _f(
        "   %d   %d   0   %.12f   %.12f   %.12f", i.cast("int") + 1, F.when(a == "H", 1).otherwise(6),
        g[0], g[1], g[2]))

    def triples(title: str, name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(
            F.lit(f" {title} --  "), F.array_join(F.transform(
                F.slice(name, k * 3 + 1, F.lit(3)), lambda x: _f("%.10f", x)), "   ")))
    modes = F.array_join(F.transform(F.arrays_zip(
        triples("Frequencies", "freq").alias("f"), triples("IR Inten   ", "ir_y").alias("i"),
        triples("Rot. str.  ", "vcd_y").alias("r")),
        lambda z: F.concat_ws("\n", z["f"], z["i"], z["r"])), "\n")
    uv = _rows(["ev", "fosc"], lambda i, x, y: _f(
        " Excited State %3d:      Singlet-A      %.10f eV  %.2f nm  f=%.10f  <S**2>=0.000",
        i.cast("int") + 1, x, 1239.8 / x, y))
    ecd = _rows(["rot"], lambda i, x: _f(" %6d   0.1000   0.1000   0.1000   %.10f", i.cast("int") + 1, x))
    rule = " " + "-" * 69
    return F.concat(
        F.lit(f" Input orientation:                          \n{rule}\n Center     Atomic      Atomic             Coordinates (Angstroms)\n"
              f" Number     Number       Type             X           Y           Z\n{rule}\n"),
        geom, F.lit(f"\n{rule}\n SCF Done:  E(RB3LYP) =  -1.500000     A.U. after    9 cycles\n"),
        _f(" SCF Done:  E(RB3LYP) =  %.12f     A.U. after    9 cycles\n", F.col("e")),
        _f(" Rotational constants (GHZ):   %.12f   %.12f   %.12f\n",
           *[F.col("b_vec")[i] * GHZ_PER_WAVENUMBER for i in range(3)]),
        _f(" Dipole moment (field-independent basis, Debye):\n    X=   %.12f    Y=   %.12f    Z=   %.12f  Tot=  1.0\n"
           " Quadrupole moment\n", *[F.col("m_vec")[i] for i in range(3)]),
        F.lit(" Harmonic frequencies (cm**-1), IR intensities (KM/Mole), Raman scattering\n"), modes,
        F.lit("\n\n\n Excited states from <AA,BB:AA,BB> singles matrix:\n"
              " <0|del|b> * <b|rxdel|0> + <0|del|b> * <b|delr+rdel|0>\n  state   XX   YY   ZZ   R(velocity)\n"),
        ecd, F.lit("\n 1/2[<0|r|b>*<b|rxdel|0> + (<0|rxdel|b>*<b|r|0>)*]\n"
                   " Excitation energies and oscillator strengths:\n\n"), uv, F.lit("\n ***\n"),
        F.when(F.col("optimised"), F.lit(" Optimization completed.\n")).otherwise(""),
        F.when(F.col("finished"), F.lit(" Normal termination of Gaussian 16\n")).otherwise(" Error\n"))


def corpus(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    text = orca_text() if dialect == "orca" else gaussian_text()
    return numbers(spark, sf_dir).select("ensemble_id", "conf_id", "protocol", text.alias("text"))
