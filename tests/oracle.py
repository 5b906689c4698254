"""Runs registered queries beside their SQL in DuckDB; also usable as a script.

python -m tests.oracle SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def _sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    found = con.sql(sql)
    expected_names, expected = found.columns, found.fetchall()
    names, rows = df.columns, [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(expected_names):
        return f"columns {sorted(set(names) ^ set(expected_names))}"
    ours, theirs = _sorted_rows(names, rows), _sorted_rows(expected_names, expected)
    if ours == theirs:
        return None
    missing, extra = set(theirs) - set(ours), set(ours) - set(theirs)
    return (f"{len(ours)} rows for {len(theirs)}, {len(missing)} missing {sorted(missing)[:2]}, "
            f"{len(extra)} extra {sorted(extra)[:2]}")


def main(sf_dir: str, only: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from hourmart.session import build_session

    spark = build_session(
        "oracle", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            **dict(pair.split("=", 1) for pair in os.environ.get("ORACLE_CONF", "").split())})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                status = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                status = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            status = f"ERROR {type(e).__name__} {str(e)[:600]}"
        failed += status.startswith(("DIFFERS", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.1f}s {status}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
