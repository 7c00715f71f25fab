"""Run queries beside their DuckDB twins: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from checks.registry import build
from leaksieve.session import local_session


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def main() -> None:
    sf_dir, *names = sys.argv[1:] or ["/root/testdata/sf0.01"]
    spark, con, failed = local_session(8), views(sf_dir), []
    for name, (query, twin) in build().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            ours = query(spark, sf_dir)
            mine = rows_of(ours.columns, ours.collect())
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        took = time.time() - started
        if twin is None:
            print(f"rows  {name}: {sum(mine.values())} rows, {took:.1f} s", flush=True)
            continue
        started = time.time()
        try:
            theirs = con.sql(twin)
            other = rows_of(theirs.columns, theirs.fetchall())
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"ERROR {name} (duckdb): {str(error)[:600]}", flush=True)
            continue
        same = sorted(ours.columns) == sorted(theirs.columns) and mine == other
        print(
            f"{'ok   ' if same else 'DIFF '} {name}: {sum(mine.values())} rows, {took:.1f} s "
            f"(duckdb {sum(other.values())} rows, {time.time() - started:.1f} s)",
            flush=True,
        )
        if not same:
            failed.append(name)
            print("   ", sorted(ours.columns), sorted(theirs.columns))
            print("    ours only:", list((mine - other).items())[:4])
            print("    duckdb only:", list((other - mine).items())[:4])
    print("failed:", failed)


if __name__ == "__main__":
    main()
