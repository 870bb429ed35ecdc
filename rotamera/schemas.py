"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

_D, _L, _S, _B, _I = (T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType(),
                      T.IntegerType())
_DA = T.ArrayType(_D)


def _table(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CONFORMERS = _table(
    ("ensemble_id", _S), ("conf_id", _L), ("atoms", T.ArrayType(_S)),
    ("geom", T.ArrayType(_DA)), ("active", _B), ("deactivated_by", _L), ("cluster", _I))

RECORDS = _table(
    ("ensemble_id", _S), ("conf_id", _L), ("protocol", _I), ("e", _D), ("g", _D), ("h", _D),
    ("s", _D), ("g_e", _D), ("zpve", _D), ("b", _D), ("b_vec", _DA), ("m", _D),
    ("m_vec", _DA), ("freq", _DA), ("pop", _D), ("erel", _D), ("elapsed_s", _D))

PEAKS = _table(
    ("ensemble_id", _S), ("conf_id", _L), ("protocol", _I), ("graph_type", _S),
    ("line_no", _I), ("x", _D), ("y", _D))

SOLVENT = _table(("solvent", _S), ("smd", _B))

# One step of a protocol file; names are those of the JSON document.
PROTOCOL_STEP = _table(
    ("functional", _S), ("basis", _S), ("solvent", SOLVENT), ("calculator", _S),
    ("mult", _I), ("charge", _I), ("opt", _B), ("freq", _B), ("freq_fact", _D),
    ("constrains", T.ArrayType(_I)), ("read_orbitals", _S), ("add_input", _S),
    ("graph", _B), ("no_prune", _B), ("cluster", _S), ("thrG", _D), ("thrB", _D),
    ("thrGMAX", _D), ("monitor_internals", T.ArrayType(T.ArrayType(_I))), ("comment", _S),
    ("read_population", _S), ("skip_opt_fail", _B), ("block_on_retention_rate", _B))

# State documents: one JSON object per ensemble, keyed by conformer number.
STATE_RECORD = _table(
    ("E", _D), ("G", _D), ("H", _D), ("S", _D), ("G_E", _D), ("zpve", _D), ("B", _D),
    ("m", _D), ("Pop", _D), ("Erel", _D), ("time", _D), ("B_vec", _DA), ("m_vec", _DA),
    ("Freq", _DA))
STATE_CONFORMER = _table(
    ("number", _L), ("atoms", T.ArrayType(_S)), ("last_geometry", T.ArrayType(_DA)),
    ("active", _B), ("cluster", _I),
    ("energies", _table(("data", T.MapType(_S, STATE_RECORD)))),
    ("graphs_data", _table(("data", T.MapType(_S, T.MapType(_S, _table(("X", _DA), ("Y", _DA))))))))
