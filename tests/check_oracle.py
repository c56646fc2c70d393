"""Run the registered queries next to their SQL in DuckDB and compare the rows exactly.

    python tests/check_oracle.py [name-prefix ...] [--sf DIR]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g.\n    {bad[0][0]}\n    {bad[0][1]}" if bad else None


def main(argv):
    import __spark_entry__

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    from tabfeat.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        del argv[i:i + 2]
    spark = local_session(8, scratch=tempfile.mkdtemp(prefix="check-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name, fn in QUERIES.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                status = problem or "same"
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
                status = problem or f"{len(rows)} rows, e.g. {rows[0].asDict()}"
        except Exception as e:
            problem = status = f"{type(e).__name__}: {str(e)[:600]}"
            if len(argv):
                traceback.print_exc()
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.1f}s {name}: {status[:900]}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
