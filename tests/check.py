"""Runs reports beside their SQL and compares values; also a small command line tool.

    python tests/check.py [directory] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.10g}")
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, directory, report, sql):
    """(row count, exact types, differences) of a report against its SQL."""
    df = report(spark, directory)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} vs {len(theirs)} rows")
    if ours != theirs:
        extra = [r for r in ours if r not in theirs][:2], [r for r in theirs if r not in ours][:2]
        problems.append(f"values differ: {extra}")
    return len(ours), problems


if __name__ == "__main__":
    from paycadence.plans.oracles import ORACLES
    from paycadence.plans.reports import REPORTS
    from paycadence.session import session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or sorted(REPORTS)
    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(where)
    failed = 0
    for name in wanted:
        begin = time.time()
        try:
            n, problems = compare(spark, con, where, REPORTS[name], ORACLES[name])
        except Exception as error:  # noqa: BLE001 - a tool that reports every failure
            n, problems = 0, [f"{type(error).__name__}: {str(error)[:900]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {time.time() - begin:.1f}s", *problems, flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} agree")
    spark.stop()
