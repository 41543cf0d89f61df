"""Compare registered queries with their SQL twins on one data folder.

usage: python tools/check_oracles.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from rasterspark.plans import ORACLES, QUERIES  # noqa: E402
from rasterspark.session import local_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, folder, name):
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got)} rows", spent, 0.0
    start = time.time()
    cur = con.execute(ORACLES[name])
    want = cur.fetchall()
    sql_spent = time.time() - start
    a_names, a = rows_of(df.columns, got)
    b_names, b = rows_of([d[0] for d in cur.description], want)
    if a_names != b_names:
        return f"FAIL columns {a_names} != {b_names}", spent, sql_spent
    if len(a) != len(b):
        return f"FAIL rows {len(a)} != {len(b)}: {a[:2]} / {b[:2]}", spent, sql_spent
    bad = [(p, q) for p, q in zip(a, b) if p != q]
    if bad:
        return f"FAIL {len(bad)}/{len(a)} values {a_names}: {bad[0][0]} != {bad[0][1]}", spent, sql_spent
    return f"ok {len(a)} rows", spent, sql_spent


def main(argv):
    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    failed = 0
    for name in sorted(QUERIES):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            result, spent, sql_spent = compare(spark, con, folder, name)
        except Exception as error:  # report and go on
            result, spent, sql_spent = f"FAIL {type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
        failed += result.startswith("FAIL")
        print(f"{name:38s} {spent:6.2f}s {sql_spent:6.2f}s {result}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
