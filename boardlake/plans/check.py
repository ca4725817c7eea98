"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

    python -m boardlake.plans.check [--sf DIR] [name ...]

Compares row counts, column names and the multiset of rows (doubles compared to 1e-9
relative, and reported separately when they differ only in the last bits).
"""

from __future__ import annotations

import argparse
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


ROUND = [None]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v if ROUND[0] is None else round(v, ROUND[0])
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, repr(x)) for x in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        problems.append(f"columns differ: spark-only {sorted(set(spark_cols) - set(duck_cols))} duck-only {sorted(set(duck_cols) - set(spark_cols))}")
        return problems
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        problems.append(f"row count spark={len(a)} duck={len(b)}")
    bad = 0
    for x, y in zip(a, b):
        if x != y:
            bad += 1
            if bad <= 3:
                diff = {order[i]: (x[i], y[i]) for i in range(len(order)) if x[i] != y[i]}
                problems.append(f"row differs: {diff}")
    if bad:
        problems.append(f"{bad} rows differ")
    return problems


def exact_types(spark_df, duck_rel_desc):
    """Map of column -> (spark type, duckdb type) for columns whose types do not correspond."""
    m = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
         "BooleanType()": "BOOLEAN", "DateType()": "DATE", "TimestampType()": "TIMESTAMP WITH TIME ZONE",
         "TimestampNTZType()": "TIMESTAMP"}
    out = {}
    st = {f.name: str(f.dataType) for f in spark_df.schema.fields}
    for name, dtype in duck_rel_desc:
        s = st.get(name)
        if s is None:
            continue
        if m.get(s, s) != dtype:
            out[name] = (s, dtype)
    return out


def main(argv=None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args(argv)
    from boardlake.plans.queries import all_queries
    from boardlake.session import local_session

    reg = all_queries()
    names = args.names or sorted(reg)
    spark = local_session()
    con = duck(args.sf)
    failed = []
    for n in names:
        q = reg[n]
        t0 = time.time()
        try:
            sdf = q.build(spark, args.sf)
            rows = [tuple(r) for r in sdf.collect()]
            cols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:600]}")
            failed.append(n)
            continue
        t1 = time.time()
        if q.sql is None:
            print(f"ROWS {n}: {len(rows)} rows (no oracle) spark {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(q.sql)
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
            ddesc = con.execute(f"describe {q.sql}").fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:600]}")
            failed.append(n)
            continue
        ROUND[0] = None
        probs = compare(rows, cols, drows, dcols)
        if probs:
            ROUND[0] = 9
            if not compare(rows, cols, drows, dcols):
                probs = ["doubles differ only in the last bits (exact hash would differ)"] + probs[:2]
        types = exact_types(sdf, [(r[0], r[1]) for r in ddesc])
        if types:
            probs.append(f"types differ: {types}")
        status = "OK  " if not probs else "FAIL"
        if probs:
            failed.append(n)
        print(f"{status} {n}: {len(rows)} rows spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s")
        for pr in probs:
            print("     ", pr)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
