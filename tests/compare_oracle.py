"""Run registered queries against their DuckDB oracle, like the driver does.

usage: python tests/compare_oracle.py [sf_dir] [query-name-substring ...]
Prints one line per query: rows (spark/oracle), schema match, value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from kharif.session import build_session  # noqa: E402
from kharif.sources.tables import TABLES  # noqa: E402


TYPE_NAMES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
              "DateType()": "DATE", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9)
    if hasattr(v, "tolist"):
        return tuple(norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    filters = sys.argv[2:]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if filters and not any(f in name for f in filters):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:40s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} ORACLE ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        schema_ok = sorted(scols) == sorted(ocols)
        smap = {f.name: TYPE_NAMES.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
        omap = {c: str(t) for c, t in zip(ocols, rel.types)}
        tdiff = {c: (smap[c], omap.get(c)) for c in smap if smap[c] != omap.get(c)}
        if tdiff:
            print(f"    type differences: {tdiff}")
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        same = a == b
        diff = ""
        if not same:
            bad += 1
            sa, sb = set(a), set(b)
            only_s = [r for r in a if r not in sb][:2]
            only_o = [r for r in b if r not in sa][:2]
            diff = f"\n    cols={sorted(scols)}\n    spark-only {len([r for r in a if r not in sb])}: {only_s}\n    oracle-only {len([r for r in b if r not in sa])}: {only_o}"
        print(f"{name:40s} rows={len(srows)}/{len(orows)} schema={'ok' if schema_ok else 'DIFF ' + str(sorted(set(scols) ^ set(ocols)))} values={'ok' if same else 'DIFF'} {ts:.1f}s{diff}")
    print(f"failures: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
