"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "__float__") and not isinstance(value, (bool, int)):
        return float(f"{float(value):.9g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((v is None, type(v).__name__ if v is not None else "", v if v is not None else 0) for v in row)
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=key)


def differences(df, sql: str, con) -> str | None:
    """None when both sides give the same rows, else a short description."""
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    duck_columns, duck_rows = rows_of([c[0] for c in rel.description], rel.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows != {len(duck_rows)}; {_first(spark_rows, duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{str(a)[:600]} != {str(b)[:600]}"
    return None


def _first(a, b):
    left, right = set(a), set(b)
    return f"only spark {str(sorted(left - right, key=str)[:2])[:500]}; only sql {str(sorted(right - left, key=str)[:2])[:500]}"


def main(argv: list[str]) -> None:
    """``oracle.py FOLDER [NAME ...]``: run and compare, with times."""
    from __spark_entry__ import oracle_sql, queries
    from postloom.session import build_session

    folder, names = argv[0], argv[1:]
    spark = build_session("oracle", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, book, sqls = connect(folder), queries(), oracle_sql()
    bad = 0
    for name in names or book:
        start = time.time()
        try:
            if name in sqls:
                verdict = differences(book[name](spark, folder), sqls[name], con) or "ok"
            else:
                verdict = f"rows {len(book[name](spark, folder).collect())}"
        except Exception as e:  # noqa: BLE001
            verdict = "ERROR " + str(e)[:700]
        bad += not (verdict == "ok" or verdict.startswith("rows "))
        print(f"{name:32s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print("bad", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
