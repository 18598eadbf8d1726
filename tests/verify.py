"""Compare registered queries with their SQL: ``python tests/verify.py [DIR] [NAME...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple("~" if x is None or x is pd.NA or x != x else (f"{x:.9g}" if isinstance(x, float) else str(x)) for x in row))
    return sorted(rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    left = query(spark, sf_dir)
    left = pd.DataFrame(left.collect(), columns=left.columns, dtype=object)
    cursor = con.execute(sql)
    right = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    a, b = canonical(left), canonical(right)
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(a)} and {len(b)} rows; only here {sorted(sa - sb)[:3]}, only in SQL {sorted(sb - sa)[:3]}"
    return ""


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    from tideline.session import build_session

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(entry.queries())
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = views(sf_dir), entry.oracle_sql(), 0
    for name in names:
        began = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, sf_dir, entry.queries()[name], sqls[name])
            else:
                n = len(entry.queries()[name](spark, sf_dir).collect())
                why = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(why)
        print(name, "ok" if not why else "DIFFERS " + why, "" if name in sqls else "(no SQL)", f"{time.time() - began:.1f} s", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1) if os.environ.get("STRICT", "1") else 0)
