"""Run registered queries against their DuckDB equivalents: python tests/oracle.py [prefix] [sf] [-v]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dict):
        return tuple((k, _norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return repr(v)


def rows_of(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, sorted(tuple(_norm(v) for v in r) for r in zip(*data))


def types_of(table):
    out = {}
    for f in table.schema:
        t = str(f.type).replace("large_", "").replace("string_view", "string")
        t = t.replace("element: ", "").replace("item: ", "").replace("l: ", "").replace(" not null", "")
        out[f.name] = t
    return out


def compare(spark_table, duck_table) -> str:
    sc, sr = rows_of(spark_table)
    dc, dr = rows_of(duck_table)
    if sc != dc:
        return f"columns {sc} != {dc}"
    st, dt = types_of(spark_table), types_of(duck_table)
    note = ""
    if st != dt:
        note = " types " + str({k: (st[k], dt[k]) for k in st if st[k] != dt[k]})
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}" + note
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first {bad[0]}" + note
    return ("ok" + note) if not note else "TYPES" + note


def main(argv):
    from tests.conftest import make_session
    import __spark_entry__ as entry
    prefixes = argv[0].split(",") if argv else [""]
    sf_dir = f"/root/testdata/sf{argv[1] if len(argv) > 1 else '0.01'}"
    spark = make_session()
    con = duck(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for key, build in entry.queries().items():
        if not any(key.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            got = build(spark, sf_dir).toArrow()
            t1 = time.time() - t
            if key not in oracle:
                print(f"{key:10s} rows-only {got.num_rows} rows {t1:.1f}s", flush=True)
                continue
            t = time.time()
            res = con.sql(oracle[key]).to_arrow_table()
            verdict = compare(got, res)
            print(f"{key:10s} {verdict} {got.num_rows} rows spark {t1:.1f}s duck {time.time()-t:.1f}s", flush=True)
            if not verdict.startswith("ok"):
                failed.append(key)
        except Exception as e:
            failed.append(key)
            print(f"{key:10s} ERROR {type(e).__name__} {str(e)[:900]}", flush=True)
    print("FAILED", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
