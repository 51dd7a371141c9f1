"""Run registered queries beside their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for file in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(file)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.12g}")
    return value


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    return [columns[i] for i in order], sorted(
        (tuple(_plain(r[i]) for i in order) for r in frame_rows), key=key)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, fn, sql: str, folder: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, folder)
    got_rows = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    want_rows = cur.fetchall()
    t2 = time.time()
    note = f"{len(got_rows)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    got = rows_of(got_rows, df.columns)
    want = rows_of(want_rows, names)
    if got[0] != want[0]:
        return False, f"{note}; columns {got[0]} != {want[0]}"
    off = [(n, k, kinds[n]) for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]]
    if off:
        note += f"; types {off}"
    if got[1] != want[1]:
        for a, b in zip(got[1], want[1]):
            if a != b:
                return False, f"{note} vs {len(want_rows)}; first difference {a} != {b}"
        return False, f"{note} vs {len(want_rows)} rows"
    return not off, note


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from ripplet.session import local_session

    folder = argv[0]
    names = argv[1:]
    spark = local_session("oracle", cores=8)
    spark.conf.set("spark.sql.crossJoin.enabled", "false")
    con = connect(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        try:
            if name in oracles:
                ok, note = compare(spark, con, fn, oracles[name], folder)
            else:
                t = time.time()
                ok, note = True, f"rows only: {fn(spark, folder).count()}, {time.time() - t:.1f}s"
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:1500]}"
        bad += not ok
        print(("ok  " if ok else "BAD ") + name + ": " + note[:1800], flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
