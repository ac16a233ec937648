"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's check: row count, column names, and an
order-insensitive hash of the values (columns sorted by name).
Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    import __spark_entry__ as E

    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in os_:
            out[name] = f"rows-only {len(sdf)}"
            print(f"{name}: {out[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            ddf = con.execute(os_[name]).df()
        except Exception as e:  # noqa: BLE001
            out[name] = f"ORACLE ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, out[name], flush=True)
            continue
        if sorted(sdf.columns) != sorted(ddf.columns):
            out[name] = f"COLUMNS {sorted(sdf.columns)} vs {sorted(ddf.columns)}"
        elif len(sdf) != len(ddf):
            out[name] = f"ROWS {len(sdf)} vs {len(ddf)}"
        else:
            a, b = canon(sdf), canon(ddf)
            if a == b:
                out[name] = f"OK {len(sdf)}"
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                out[name] = f"VALUES differ e.g. {diff}"
        print(f"{name}: {out[name]} ({ts:.1f}s)", flush=True)
    return out


if __name__ == "__main__":
    from keyfold.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print("FAILED:", bad if bad else "none")
