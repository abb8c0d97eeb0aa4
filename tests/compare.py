"""Compare checked queries with their SQL: names, row counts and values, in any order.

``python tests/compare.py FOLDER [NAME ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, name: str, folder: str) -> str:
    """Empty when both sides agree, else what differs."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    sql = e.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not want:
        return "oracle has no rows"
    a, b = _bag(df.columns, got), _bag(names, want)
    if a == b:
        return ""
    extra, missing = list((a - b).elements())[:2], list((b - a).elements())[:2]
    return f"rows {len(got)} vs {len(want)}; columns {sorted(names)}\n   spark only {str(extra)[:700]}\n   sql only   {str(missing)[:700]}"


def main() -> int:
    from newsevidence.session import build_session

    import __spark_entry__ as e

    folder, names = sys.argv[1], sys.argv[2:] or list(e.queries())
    spark = build_session(
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            found = difference(spark, con, name, folder)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:900]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.2f}s {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
