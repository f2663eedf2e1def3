"""Run queries on Spark and their SQL on DuckDB and compare rows.

Usage: python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from veilscan.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(canonical(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in t),
    )


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return None
    left, right = set(got), set(want)
    return (
        f"rows {len(got)} / {len(want)}; only Spark {len(left - right)}: {str(sorted(left - right, key=str)[:2])[:600]}; "
        f"only SQL {len(right - left)}: {str(sorted(right - left, key=str)[:2])[:600]}"
    )


def main(sf_dir: str, *names: str) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or entry.queries():
        if name not in entry.oracle_sql():
            print(f"{name:28s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:500]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f} {'ok' if problem is None else problem}", flush=True)
    print("different:", bad, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
