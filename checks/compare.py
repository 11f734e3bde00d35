"""Run queries and their SQL side by side: ``python -m checks.compare <sf_dir> [query …]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import all_sql
from checks.queries import all_queries


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return None if isinstance(value, float) and math.isnan(value) else float(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, db, sf_dir: str, name: str) -> str | None:
    """None if equal, else what differs."""
    df = all_queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    result = db.execute(all_sql()[name])
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows / {len(theirs)} rows"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(bad)} rows differ in {sorted(columns)}, first {bad[0][0]} / {bad[0][1]}"
    return None


def main() -> None:
    from staffmart.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(all_queries())
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, db, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:800]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'equal'}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")


if __name__ == "__main__":
    main()
