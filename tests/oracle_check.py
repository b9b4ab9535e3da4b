"""Compare every registered query with its DuckDB oracle SQL.

Mimics the driver's check: row count, column names, and an
order-insensitive hash of the values with columns sorted by name.
Usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


STRICT = os.environ.get("ORACLE_STRICT") == "1"   # hash floats exactly as returned


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v) if STRICT else repr(round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            s_cols = df.columns
            s_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                       for f in df.schema.fields}
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = f"spark error: {type(e).__name__}: {str(e)[:300]}"
            print(f"ERR  {name}: {results[name]}", flush=True)
            continue
        if name not in sql:
            results[name] = f"rows-only ({len(s_rows)})"
            print(f"ROWS {name}: {len(s_rows)}", flush=True)
            continue
        try:
            rel = con.execute(sql[name])
            d_cols = [c[0] for c in rel.description]
            d_types = {c[0]: str(c[1]) for c in rel.description}
            d_rows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = f"duckdb error: {str(e)[:400]}"
            print(f"ERR  {name}: {results[name]}", flush=True)
            continue
        problems = []
        if sorted(s_cols) != sorted(d_cols):
            problems.append(f"columns spark={s_cols} duck={d_cols}")
        type_diff = {c: (s_types.get(c), d_types.get(c)) for c in d_cols if s_types.get(c) != d_types.get(c)}
        if type_diff:
            problems.append(f"types {type_diff}")
        if len(s_rows) != len(d_rows):
            problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
        if not problems:
            hs, ls = digest(s_cols, s_rows)
            hd, ld = digest(d_cols, d_rows)
            if hs != hd:
                diff = [(a[:300], b[:300]) for a, b in zip(ls, ld) if a != b][:2]
                problems.append(f"values differ, e.g. {diff}")
        results[name] = "OK" if not problems else "; ".join(problems)
        print(f"{'OK  ' if not problems else 'DIFF'} {name:28s} {len(s_rows):7d} rows {time.time() - t0:6.1f}s"
              + ("" if not problems else "  " + results[name][:700]), flush=True)
    return results


if __name__ == "__main__":
    from codeeval.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v != "OK" and not v.startswith("rows-only")]
    print("NOT OK:", bad)
