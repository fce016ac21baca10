"""Run every query on Spark and its SQL on DuckDB and compare rows.

    python tools/check_oracles.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from quillweave.plans.oracles import ORACLES  # noqa: E402
from quillweave.plans.queries import QUERIES  # noqa: E402
from quillweave.session import local_session  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session()
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    bad = 0
    for name in names or QUERIES:
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            mine = as_rows(df.columns, [tuple(r) for r in df.collect()])
        except Exception as problem:
            bad += 1
            print(f"{name:22s} SPARK FAILED {str(problem)[:600]}")
            continue
        spent = time.time() - began
        if name not in ORACLES:
            print(f"{name:22s} rows={len(mine)} {spent:.1f}s (no SQL)")
            continue
        try:
            began = time.time()
            result = con.sql(ORACLES[name])
            theirs = as_rows(result.columns, result.fetchall())
            duck = time.time() - began
        except Exception as problem:
            bad += 1
            print(f"{name:22s} SQL FAILED {str(problem)[:900]}")
            continue
        same = sorted(df.columns) == sorted(result.columns) and mine == theirs
        print(f"{name:22s} {'ok' if same else 'DIFFERENT'} rows={len(mine)} {spent:.1f}s sql={duck:.1f}s", flush=True)
        if not same:
            bad += 1
            print("   columns", sorted(df.columns), sorted(result.columns), len(mine), len(theirs))
            for a, b in zip(mine, theirs):
                if a != b:
                    print("   spark ", repr(a)[:700])
                    print("   duckdb", repr(b)[:700])
                    break
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
