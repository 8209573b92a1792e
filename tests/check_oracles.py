"""Run registered queries and their SQL twins side by side and report differences.

usage: python tests/check_oracles.py [name-substring ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(df, con, sql):
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if got_cols != want_cols:
        return [f"columns {got_cols} vs {want_cols}"]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    for r, (a, b) in enumerate(zip(got, want)):
        for name, x, y in zip(got_cols, a, b):
            if type(x) is not type(y) and not (x is None or y is None):
                problems.append(f"type {name}: {x!r} vs {y!r}")
            elif x != y or (isinstance(x, float) and math.copysign(1, x) != math.copysign(1, y)):
                problems.append(f"row {r} {name}: {x!r} vs {y!r}")
        if len(problems) > 5:
            break
    return problems[:6]


def main(names):
    from pyspark.sql import SparkSession

    from tabulant.plans.catalog import ORACLES, QUERIES

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLES:
                problems = compare(df, con, ORACLES[name])
                note = "ok"
            else:
                problems = []
                note = f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on
            problems, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:32s} {time.time() - t:6.2f}s {note}", flush=True)
        for p in problems:
            print("      ", p)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
