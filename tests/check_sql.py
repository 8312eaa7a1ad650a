"""Compare every query with its SQL counterpart; run as a script with a folder and optional names."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def open_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark, con, sf_dir: str, name: str) -> str:
    """Empty when rows and columns agree, else what differs first."""
    got = entry.queries()[name](spark, sf_dir).toArrow()
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} / {sorted(want.column_names)}"
    columns = sorted(got.column_names)
    left = sorted(map(repr, zip(*[got[c].to_pylist() for c in columns])))
    right = sorted(map(repr, zip(*[want[c].to_pylist() for c in columns])))
    if left == right:
        return ""
    extra, missing = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    return (
        f"rows {len(left)} / {len(right)}, {len(extra)} extra, {len(missing)} missing"
        f"\n   only Spark: {extra[:1]}\n   only SQL:   {missing[:1]}"
    )


def main() -> int:
    from proofmill.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = open_views(sf_dir)
    bad = 0
    for name in names or entry.queries():
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as error:  # one broken query must not hide the rest
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name} {time.time() - start:.1f}s {found[:1500]}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
