"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
Mirrors the driver's check: row count, column names, order-insensitive values.
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from ferret.plans.catalog import REGISTRY  # noqa: E402
from ferret.session import build_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "timestamp": "TIMESTAMP"}


def type_diffs(sdtypes, rel):
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for c, t in sdtypes:
        d = duck.get(c)
        if d is not None and SPARK_TO_DUCK.get(t, t) != d:
            out.append(f"{c}:{t}/{d}")
    return out


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, (fn, sql) in sorted(REGISTRY.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            rel = con.sql(sql)
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        tdiff = type_diffs(df.dtypes, rel)
        if ok_cols and a == b:
            print(f"OK   {name}: {len(srows)} rows ({ts:.1f}s)" + (f" TYPES {tdiff}" if tdiff else ""))
        else:
            bad += 1
            print(f"DIFF {name}: cols {ok_cols} spark={scols} duck={dcols} rows {len(a)} vs {len(b)}")
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:3]:
                print("   spark only:", str(r)[:400])
            for r in list(sb - sa)[:3]:
                print("   duck  only:", str(r)[:400])
    print("mismatches:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
