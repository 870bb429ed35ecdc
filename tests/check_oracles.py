"""Compare registered queries with their SQL on the test tables.

    python tests/check_oracles.py [sf] [name ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kind(t):
    """What of a column's type must be the same on both sides."""
    import pyarrow as pa
    return next((n for n, test in (("bool", pa.types.is_boolean), ("int", pa.types.is_integer),
                                   ("float", pa.types.is_floating)) if test(t)), "other")


def difference(con, names, got, want):
    """The same for many rows: differences as DuckDB finds them, values being equal bit for bit."""
    order = sorted(names)
    if [kind(got.schema.field(n).type) for n in order] != [kind(want.schema.field(n).type) for n in order]:
        return f"TYPES {got.schema} vs {want.schema}"
    con.register("_got", got.select(order))
    con.register("_want", want.select(order))
    n, example = con.sql("SELECT count(*), any_value(x) FROM (SELECT _got AS x FROM _got EXCEPT ALL "
                         "SELECT _want FROM _want)").fetchall()[0]
    con.unregister("_got")
    con.unregister("_want")
    return f"VALUES {n} differ, e.g. {example}" if n else "ok"


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    table = df.toArrow()
    took = time.time() - t0
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", took, table.num_rows
    if table.num_rows > 50_000:
        want = rel.to_arrow_table()
        if want.num_rows != table.num_rows:
            return f"ROWS {table.num_rows} vs {want.num_rows}", took, table.num_rows
        return difference(con, names, table, want), took, table.num_rows
    got = [tuple(r[c] for c in df.columns) for r in table.to_pylist()]
    want = rel.fetchall()
    a, b = canonical(got, df.columns), canonical(want, names)
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}", took, len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return (f"VALUES {len(bad)} differ, e.g. {bad[0]}" if bad else "ok"), took, len(got)


def main(argv):
    sf = argv[0] if argv else "0.01"
    from rotamera.session import build_session
    import __spark_entry__ as entry
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(q)
    failed = 0
    for n in names:
        try:
            if n in o:
                res, took, rows = compare(spark, con, q[n], o[n], sf_dir)
            else:
                t0 = time.time()
                rows = len(q[n](spark, sf_dir).collect())
                res, took = "rows only", time.time() - t0
        except Exception as exc:
            res, took, rows = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}", 0, 0
        failed += res not in ("ok", "rows only")
        print(f"{n:32s} {took:6.2f}s {rows:8d}  {res}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
