"""Run registered queries in Spark and their SQL twins in DuckDB and compare.

Order-insensitive: both results are sorted on all columns after rounding
doubles; column names and row counts must match.  Usable as a script:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, places=9):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        if math.isinf(v):
            return (1, "inf" if v > 0 else "-inf")
        return (1, f"{round(v, places):.{places}f}")
    if hasattr(v, "item"):
        return _norm(v.item(), places)
    if isinstance(v, (list, tuple)):
        return (2, repr([_norm(x, places) for x in v]))
    if isinstance(v, bool):
        return (1, str(int(v)))
    if isinstance(v, int):
        return (1, f"{float(v):.{places}f}" if False else str(v))
    return (1, str(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort()
    return [columns[i] for i in order], out


def compare(spark, sf_dir: str, names=None, con=None, verbose=True):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = con or duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = f"rows-only ({len(s_rows)} rows)"
        else:
            try:
                rel = con.execute(sqls[name])
                d_cols = [d[0] for d in rel.description]
                d_rows = rel.fetchall()
            except Exception as e:  # noqa: BLE001
                results[name] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
                if verbose:
                    print(name, results[name], flush=True)
                continue
            sc, sr = rows_of(s_cols, s_rows)
            dc, dr = rows_of(d_cols, d_rows)
            if sc != dc:
                results[name] = f"COLUMNS differ spark={sc} duck={dc}"
            elif len(sr) != len(dr):
                results[name] = f"ROWCOUNT differ spark={len(sr)} duck={len(dr)}"
            elif sr != dr:
                bad = next(i for i in range(len(sr)) if sr[i] != dr[i])
                results[name] = f"VALUES differ at {bad}: spark={sr[bad]} duck={dr[bad]}"
            else:
                results[name] = f"ok ({len(sr)} rows)"
        if verbose:
            print(f"{name:32s} {t1 - t0:6.1f}s  {results[name]}", flush=True)
    return results


if __name__ == "__main__":
    from impressa.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "12g"})
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    sys.exit(1 if bad else 0)
