"""Run each query on Spark and its SQL twin on DuckDB; compare rows and values.

usage: python scripts/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from covary.plans import oracle_sql, queries  # noqa: E402
from covary.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sqls = queries(), oracle_sql()
    ok = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            rows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(rows)} rows ({ts:.1f}s, no SQL twin)")
            ok += 1
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            continue
        duck_types = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                      "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}
        st = dict(df.dtypes)
        dt_ = {c: duck_types.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
        bad = {c: (st.get(c), dt_.get(c)) for c in st if st.get(c) != dt_.get(c)}
        if bad:
            print(f"TYPE {name}: {bad}")
        a_cols, a = canon(scols, rows)
        b_cols, b = canon(dcols, drows)
        if a_cols != b_cols:
            print(f"FAIL {name}: columns {a_cols} vs {b_cols}")
            continue
        if len(a) != len(b):
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}")
            continue
        if a != b:
            diffs = [(x, y) for x, y in zip(a, b) if x != y]
            print(f"FAIL {name}: {len(diffs)} value diffs, e.g. {diffs[:2]}")
            continue
        ok += 1
        print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
    print(f"{ok}/{len(names or qs)} ok")


if __name__ == "__main__":
    main()
