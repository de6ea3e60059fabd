"""Run registered queries in Spark and their SQL checks in DuckDB, compare whole results."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from urlguard.plans.inputs import GIVEN


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, list):
        return tuple(map(plain, value))
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    names = [columns[k] for k in order]
    body = [tuple(plain(row[k]) for k in order) for row in rows]
    return names, sorted(body, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(frame, con, sql):
    """Problem text, or None when both results are the same."""
    names, mine = ordered(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    other_names, other = ordered([d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns {names} / {other_names}", len(mine)
    if len(mine) != len(other):
        return f"rows {len(mine)} / {len(other)}", len(mine)
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0][0]} / {bad[0][1]}", len(mine)
    return None, len(mine)


def main():
    import __spark_entry__ as entry
    from urlguard.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--folder", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = local_session(8)
    con = duck(args.folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    wrong = 0
    for name, build in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in checks:
                problem, rows = compare(build(spark, args.folder), con, checks[name])
            else:
                rows = build(spark, args.folder).count()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001 - the report goes on
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        wrong += problem is not None
        kind = "sql " if name in checks else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name} {rows} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("wrong:", wrong)


if __name__ == "__main__":
    main()
