"""Calculation outputs to columns.

A dialect is a set of functions from the text column to Columns, registered by name; reading and
parsing never leave the JVM.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rotamera.constants import GHZ_PER_WAVENUMBER, WAVENUMBERS_PER_EV
from rotamera.operators.grouping import spread
from rotamera.sources.numbers import NUMBER, REAL, labelled, row_of

# --- fixed values: what the two programs print --------------------------------
ORCA_VERSION = r"Program Version (\d)"
ORCA_ENERGY = "FINAL SINGLE POINT ENERGY"
ORCA_ROTATIONAL = "Rotational constants in cm-1:"
ORCA_DIPOLE = "Total Dipole Moment *:"
ORCA_GEOMETRY = r"CARTESIAN COORDINATES \(ANGSTROEM\) *\n-+"
ORCA_FREQUENCIES = "VIBRATIONAL FREQUENCIES"
ORCA_IR = r"Mode +freq +eps +Int +T\*\*2 +TX +TY +TZ *\n[^\n]*\n-+"
ORCA_VCD = r"Mode +Freq +VCD-Intensity *\n[^\n]*\n-+"
ORCA_UV = r"ABSORPTION SPECTRUM VIA TRANSITION ELECTRIC DIPOLE MOMENTS *\n-+\n[^\n]*\n[^\n]*\n-+"
ORCA_ECD = r"CD SPECTRUM(?: VIA TRANSITION ELECTRIC DIPOLE MOMENTS)? *\n-+\n[^\n]*\n[^\n]*\n-+"
ORCA_FINISHED = "ORCA TERMINATED NORMALLY"
ORCA_CONVERGED = "THE OPTIMIZATION HAS CONVERGED"
GAUSSIAN_ENERGY = "SCF Done:[^=\n]*="
GAUSSIAN_ROTATIONAL = r"Rotational constants \(GHZ\):"
GAUSSIAN_STATE = r"Excited State +\d+:"
GAUSSIAN_GEOMETRY = r"Input orientation: *\n -+\n[^\n]*\n[^\n]*\n -+"
GAUSSIAN_FREQUENCIES = "Harmonic frequencies (cm**-1), IR intensities (KM/Mole), Raman scattering"
GAUSSIAN_EXCITED = "Excited states from"
GAUSSIAN_UV = "Excitation energies and oscillator strengths"
GAUSSIAN_ECD = "<0|del|b> * <b|rxdel|0> + <0|del|b> * <b|delr+rdel|0>"
GAUSSIAN_ECD_END = "1/2[<0|r|b>*<b|rxdel|0> + (<0|rxdel|b>*<b|r|0>)*]"
GAUSSIAN_FINISHED = "Normal termination"
GAUSSIAN_CONVERGED = "Optimization completed"
# columns of the tables: (energy, strength), counted from 0
ORCA_IR_COLUMNS = (1, 3)
ORCA_VCD_COLUMNS = (1, 2)
ORCA_EXCITED_COLUMNS = {"6": (3, 6), "5": (1, 3)}

_VERSOR = (1.0, 0.0, 0.0)


def _placeholder() -> Column:
    """The single (0, 0) line of a spectrum that was not computed."""
    return F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def _all(text: Column, regex: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _last(text: Column, regex: str, group: int = 1) -> Column:
    return F.try_element_at(_all(text, regex, group), F.lit(-1))


def _triple(text: Column, regex: str, divisor: float = 1.0) -> Column:
    """Numbers of the last match of a three-number pattern, else the versor."""
    hit = _last(text, regex, 0)
    values = F.array(*[F.regexp_extract(hit, regex, i).cast("double") / divisor for i in (1, 2, 3)])
    return F.when(hit.isNotNull(), values).otherwise(F.array(*[F.lit(v) for v in _VERSOR]))


def _after(text: Column, regex: str) -> Column:
    """Text after the last match, NULL if there is none."""
    return F.when(text.rlike(regex), F.try_element_at(F.split(text, regex), F.lit(-1)))


def _points(text: Column, regex: str) -> Column:
    axes = [_all(text, regex, i) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(axes, "xyz")])
    return F.transform(zipped, lambda p: F.array(
        *[p[n].cast("double") for n in "xyz"]))


def _table(block: Column, columns: tuple[int, int]) -> Column:
    """(x, y) from two blank-separated columns of a table; rules and blank lines skipped."""
    lines = F.filter(F.split(block, "\n"),
                     lambda s: (F.trim(s) != "") & ~s.contains("---"))
    words = F.transform(lines, lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "))
    i, j = columns
    return F.transform(words, lambda w: F.struct(F.get(w, i).try_cast("double").alias("x"),
                                                 F.get(w, j).try_cast("double").alias("y")))


def _lines_or_placeholder(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, lines).otherwise(_placeholder())


def _count(text: Column, literal: str) -> Column:
    return F.regexp_count(text, F.lit(literal))


def _zip_xy(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def _orca(text: Column) -> dict[str, Column]:
    version = F.regexp_extract(text, ORCA_VERSION, 1)
    spectra = text.contains("SPECTRA")
    freq_text = F.substring_index(F.substring_index(text, ORCA_FREQUENCIES, -1), "\n\n\n", 1)
    freq = F.filter(F.transform(_all(freq_text, labelled(r"\d+:", 1, REAL)),
                                lambda v: v.cast("double")), lambda v: v != 0)
    has_freq = text.contains(ORCA_FREQUENCIES)

    def section(regex: str, columns: tuple[int, int]) -> Column:
        body = F.regexp_replace(_after(text, regex), r"^ *\n", "")
        return _table(F.substring_index(body, "\n\n", 1), columns)

    def excited(regex: str) -> Column:
        new = section(regex, ORCA_EXCITED_COLUMNS["6"])
        old = F.transform(section(regex, ORCA_EXCITED_COLUMNS["5"]), lambda p: F.struct(
            (p["x"] / F.lit(WAVENUMBERS_PER_EV)).alias("x"), p["y"].alias("y")))
        return F.when(spectra, F.when(version == "5", old).otherwise(new))
    geometry = F.substring_index(_after(text, ORCA_GEOMETRY), "\n\n", 1)
    return {
        "version": version,
        "e": _last(text, labelled(ORCA_ENERGY + r"[^\n]*?", 1)).try_cast("double"),
        "geom": _points(geometry, row_of(3)),
        "b_vec": _triple(text, labelled(ORCA_ROTATIONAL, 3)),
        "m_vec": _triple(text, labelled(ORCA_DIPOLE, 3)),
        "freq": F.when(has_freq, freq).otherwise(F.array().cast("array<double>")),
        "ir": _lines_or_placeholder(F.when(has_freq, section(ORCA_IR, ORCA_IR_COLUMNS))),
        "vcd": _lines_or_placeholder(F.when(has_freq & (version != "5"),
                                            section(ORCA_VCD, ORCA_VCD_COLUMNS))),
        "uv": _lines_or_placeholder(excited(ORCA_UV)),
        "ecd": _lines_or_placeholder(excited(ORCA_ECD)),
        "terminated": _count(text, ORCA_FINISHED) == 1,
        "converged": _count(text, ORCA_CONVERGED) == 1,
    }


def _gaussian(text: Column) -> dict[str, Column]:
    freq_text = F.substring_index(F.substring_index(text, GAUSSIAN_FREQUENCIES, -1), "\n\n\n", 1)
    has_freq = text.contains(GAUSSIAN_FREQUENCIES)

    def numbers(title: str) -> Column:
        rows = _all(freq_text, title + r" *--([^\n]*)")
        words = F.flatten(F.transform(rows, lambda s: F.regexp_extract_all(
            s, F.lit(REAL), F.lit(0))))
        return F.transform(words, lambda v: v.cast("double"))
    freq = numbers("Frequencies")
    uv_text = F.substring_index(F.substring_index(text, GAUSSIAN_UV, -1), "***", 1)
    state = GAUSSIAN_STATE + rf"[^\n]*?({REAL}) +eV\b[^\n]*?\bf= *({REAL})"
    energy = F.transform(_all(uv_text, state, 1), lambda v: v.cast("double"))
    strength = F.transform(_all(uv_text, state, 2), lambda v: v.cast("double"))
    ecd_text = F.substring_index(F.substring_index(text, GAUSSIAN_ECD, -1), GAUSSIAN_ECD_END, 1)
    rotatory = F.transform(_all(ecd_text, r"(?m)^ *\d+" + row_of(4), 4),
                           lambda v: v.cast("double"))
    excited = text.contains(GAUSSIAN_EXCITED)
    geometry = F.substring_index(_after(text, GAUSSIAN_GEOMETRY), "--", 1)
    dipole_text = F.substring_index(F.substring_index(text, "Dipole moment", -1), "Quadrupole", 1)
    return {
        "version": F.lit(""),
        "e": _last(text, labelled(GAUSSIAN_ENERGY, 1)).try_cast("double"),
        "geom": _points(geometry, r"(?m)^ *\d+ +\d+ +\d+" + row_of(3)),
        "b_vec": _triple(text, labelled(GAUSSIAN_ROTATIONAL, 3), GHZ_PER_WAVENUMBER),
        "m_vec": _triple(dipole_text, r"\s+".join(labelled(f"{a}=", 1) for a in "XYZ")),
        "freq": F.when(has_freq, freq).otherwise(F.array().cast("array<double>")),
        "ir": _lines_or_placeholder(F.when(has_freq, _zip_xy(freq, numbers("IR Inten")))),
        "vcd": _lines_or_placeholder(F.when(has_freq, _zip_xy(freq, numbers(r"Rot\. str\.")))),
        "uv": _lines_or_placeholder(F.when(excited, _zip_xy(energy, strength))),
        "ecd": _lines_or_placeholder(F.when(excited, _zip_xy(energy, rotatory))),
        "terminated": _count(text, GAUSSIAN_FINISHED) >= 1,
        "converged": _count(text, GAUSSIAN_CONVERGED) >= 1,
    }


DIALECTS: dict[str, Callable[[Column], dict[str, Column]]] = {}
EXTENSIONS = {"orca": "*.out", "gaussian": "*.log"}


def register_dialect(name: str, builder: Callable[[Column], dict[str, Column]]) -> None:
    """Make ``builder`` available to :func:`parse_logs` under ``name``."""
    DIALECTS[name.lower()] = builder


register_dialect("orca", _orca)
register_dialect("gaussian", _gaussian)


def _check_dialect(dialect: str) -> None:
    if dialect.lower() not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}, have {sorted(DIALECTS)}")


def parse_logs(df: DataFrame, dialect: str, text: str = "text",
               only: tuple[str, ...] | None = None) -> DataFrame:
    """Add version, e, geom, b_vec, m_vec, freq, the four line lists, terminated and converged
    from the text column, and drop it. ``only`` restricts what is extracted."""
    _check_dialect(dialect)
    columns = DIALECTS[dialect.lower()](F.col(text))
    if only is not None:
        columns = {k: columns[k] for k in only}
    return df.select(*[c for c in df.columns if c != text],
                     *[c.alias(n) for n, c in columns.items()])


# --- fixed value: where write_logs puts an output, in either of its two ways ---
SAFE = "/=:@!$&'()*+,;~"                           # left as they are in a file's URI
OUTPUT_KEYS = r"/([^/=]+)=([^/=]*)/([^/=]+)=([^/=]*?)(?:/|\.\d+\.)[^/]*$"


def write_logs(df: DataFrame, path: str, keys: tuple[str, str] = ("ensemble_id", "conf_id"),
               text: str = "text", suffix: str = ".out") -> None:
    """One file per output under a new folder ``path``, a URI. Keys are whole numbers or missing. Rows of
    a partition that share their keys share a file.

    Where the folder is mounted (``file:``), tasks write the files themselves into one folder per
    ensemble, so neither commit nor listing grows by a folder an output, which costs Spark's
    writer a directory and a rename and its reader a task each. Elsewhere Spark's writer makes a
    folder per output. :func:`read_written_logs` reads both."""
    group, member = keys
    rows = df.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(text).alias("value"))
    if not path.startswith("file:"):
        rows.sortWithinPartitions(*keys).write.partitionBy(*keys).text(path)
        return
    # each partition takes the ensembles in an order of its own: tasks in one folder wait for each other
    turn = F.xxhash64(F.col(group), F.spark_partition_id())
    rows = (rows.withColumns({"value": F.col("value").cast("binary"), "_turn": turn})
            .sortWithinPartitions("_turn", *keys).drop("_turn"))
    base = path.removeprefix("file:")

    def write(batches):
        from itertools import groupby

        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()

        def outputs():
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    for r in b.slice(lo, 256).to_pylist():
                        names = ["__HIVE_DEFAULT_PARTITION__" if r[k] is None else r[k] for k in keys]
                        yield names, r["value"]
        made, n = set(), 0
        for (g, m), same in groupby(outputs(), lambda x: x[0]):
            folder = f"{base}/{group}={g}"
            if g not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(g)
            name = f"{folder}/{member}={m}.{part}{suffix}"
            hidden = f"{folder}/.{member}={m}.{part}.{attempt}"      # a second attempt never cuts a file short
            with open(hidden, "wb") as f:
                for _, t in same:
                    f.write((t or b"") + b"\n")
            os.replace(hidden, name)
            n += 1
        yield pa.record_batch({"n": [n]})
    os.makedirs(base)
    rows.mapInArrow(write, "n long").agg(F.sum("n")).first()


FILES_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20       # of the files in a batch


def _hidden(name: str) -> bool:
    """Files that Spark's reader passes over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _mounted_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files one folder below a mounted folder. A task lists each folder, then the files are
    dealt out and read by as many tasks as there are partitions, where Spark's reader has one for each 32 files
    or so and opens each through several calls."""
    base = "/" + path.removeprefix("file:").lstrip("/")
    folders = sorted(f.path for f in os.scandir(base) if f.is_dir() and not _hidden(f.name))

    def listed(batches):
        import pyarrow as pa
        for b in batches:
            for folder in b.column(0).to_pylist():
                names = [f.path for f in os.scandir(folder) if not _hidden(f.name)]
                for lo in range(0, len(names), 10_000):
                    yield pa.record_batch({"file": names[lo:lo + 10_000]})

    def read(batches):
        import pyarrow as pa
        names, texts, size = [], [], 0
        schema = pa.schema([("file", pa.string()), ("text", pa.binary())])

        def uri(name):
            return "file:" + re.sub(r"[\x00-\x7f]+", lambda m: quote(m[0], safe=SAFE), name)

        def batch():
            return pa.record_batch([[uri(n) for n in names], texts], schema=schema)
        for b in batches:
            for name in b.column(0).to_pylist():
                with open(name, "rb") as f:
                    texts.append(f.read())
                names.append(name)
                size += len(texts[-1])
                if len(names) == FILES_AT_ONCE or size > BYTES_AT_ONCE:
                    yield batch()
                    names, texts, size = [], [], 0
        if names:
            yield batch()
    names = spark.createDataFrame([(f,) for f in folders], "folder string").mapInArrow(listed, "file string")
    return (spread(names, ["file"]).mapInArrow(read, "file string, text binary")
            .select("file", F.col("text").cast("string").alias("text")))


def read_written_logs(spark: SparkSession, path: str, dialect: str,
                      keys: tuple[str, str] = ("ensemble_id", "conf_id")) -> DataFrame:
    """(keys, file, text) of the outputs under a folder of :func:`write_logs`. Keys are texts, those
    that were missing are NULL."""
    _check_dialect(dialect)
    found = {k: F.regexp_extract("file", OUTPUT_KEYS, 2 * i) for i, k in enumerate(keys, start=1)}
    missing = F.lit("__HIVE_DEFAULT_PARTITION__")
    files = _mounted_files(spark, path) if path.startswith("file:") else read_logs(spark, path, dialect)
    return files.select(
        *[F.nullif(v, missing).alias(k) for k, v in found.items()], "file", "text")


def read_logs(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """(partition columns, file, text) of a corpus of outputs, one row per file, so one
    output must fit in memory, as it is one calculation. Many small files are better packed
    into a Parquet table of texts, which :func:`parse_logs` takes just as well."""
    _check_dialect(dialect)
    raw = spark.read.text(path, wholetext=True)
    extra = [c for c in raw.columns if c != "value"]
    return raw.select(*extra, F.col("_metadata.file_path").alias("file"),
                      F.col("value").alias("text"))


def peaks_of(parsed: DataFrame, keys=("ensemble_id", "conf_id", "protocol")) -> DataFrame:
    """The four line lists as one table of (keys, graph_type, line_no, x, y)."""
    lists = F.array(*[F.struct(F.lit(t).alias("graph_type"), F.col(c).alias("lines"))
                      for t, c in (("IR", "ir"), ("VCD", "vcd"), ("UV", "uv"), ("ECD", "ecd"))])
    rows = parsed.select(*keys, F.inline(lists))
    return rows.select(*keys, "graph_type", F.posexplode("lines").alias("line_no", "_l")).select(
        *keys, "graph_type", "line_no", "_l.x", "_l.y")
