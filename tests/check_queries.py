"""Run the registered queries against their SQL in DuckDB: ``python tests/check_queries.py [folder] [name part ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (decimal.Decimal, float, int)):
        number = float(value)
        return None if math.isnan(number) else (int(number) if number.is_integer() else float(f"{number:.9g}"))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


def compare(df, sql, connection):
    names = sorted(df.columns)
    ours = sorted_rows([[row[c] for c in names] for row in df.collect()])
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns differ: {names} and {sorted(columns)}"
    order = [columns.index(c) for c in names]
    theirs = sorted_rows([[row[i] for i in order] for row in cursor.fetchall()])
    if ours == theirs:
        return None
    only_ours, only_theirs = list(set(ours) - set(theirs))[:2], list(set(theirs) - set(ours))[:2]
    return f"rows {len(ours)} and {len(theirs)}\n   ours   {only_ours!r:.900}\n   theirs {only_theirs!r:.900}"


def connect(folder):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def main(folder="/root/testdata/sf0.01", *parts):
    import __spark_entry__ as entry
    from forumloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    checks, failed = entry.oracle_sql(), []
    for name, function in entry.queries().items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            if name in checks:
                problem, kind = compare(df, checks[name], connection), "equal"
            else:
                problem, kind = None, f"{len(df.collect())} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, kind = f"{type(error).__name__}: {str(error)[:700]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name:45s} {time.time() - start:6.1f}s {problem or kind}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
