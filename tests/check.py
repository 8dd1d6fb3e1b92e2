"""Run registered queries against their SQL twins: ``python tests/check.py [sf] [name-part ...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tilewright.session import TABLES, local_session  # noqa: E402


def _cell(v):
    if v is None or v is pd.NaT:
        return "~"
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        v = float(v)
        if math.isnan(v):
            return "~"
        return f"f{round(v, 9) + 0.0!r}"
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind == "b":
        return f"b{int(v)}"
    if hasattr(v, "dtype") and v.dtype.kind in "iu" or isinstance(v, int):
        return f"i{int(v)}"
    return f"s{v}"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir):
    df = q.build(spark, sf_dir)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return f"rows-only {len(got)}", True
    rel = con.sql(q.sql)
    cols = rel.columns
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(cols)}", False
    want = canon(cols, rel.fetchall())
    if got == want:
        return f"ok {len(got)}", len(got) > 0
    diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"DIFF rows spark={len(got)} sql={len(want)} {sorted(cols)} first={diff}", False


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main():
    from tilewright.plans import all_queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0") else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(sf_dir)
    bad = []
    for name, q in all_queries().items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            msg, good = compare(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            msg, good = f"ERROR {type(e).__name__} {str(e)[:600]}", False
        if not good:
            bad.append(name)
        print(f"{'  ' if good else '!!'} {name:45s} {time.time() - t0:6.2f}s {msg}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
