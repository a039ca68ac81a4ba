"""Run registered queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import math
import os
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# All-pairs joins, row-at-a-time Python, and whole results in one task.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "Exchange SinglePartition")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    return con


def _value(x):  # noqa: ANN001, ANN202
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(
        (tuple(_value(x) for x in row) for row in rows), key=lambda r: [(x is None, str(x)) for x in r]
    )


def spark_rows(spark: SparkSession, query, sf_dir: str) -> tuple[list[str], list[tuple]]:  # noqa: ANN001
    frame = query(spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for operator in UNWANTED:
        assert operator not in plan, f"{operator} in the plan"
    columns = sorted(frame.columns)
    return columns, _sorted([tuple(r) for r in frame.select(*columns).collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(row[i] for i in order) for row in result.fetchall()]
    return [names[i] for i in order], _sorted(rows)


def difference(spark: SparkSession, con, query, sql: str, sf_dir: str) -> str | None:  # noqa: ANN001
    columns, ours = spark_rows(spark, query, sf_dir)
    names, theirs = sql_rows(con, sql)
    if columns != names:
        return f"columns {columns} vs {names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{str(a)[:600]}\n   vs {str(b)[:600]}"
    return None


def main(argv: list[str]) -> int:
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tagweave.session import local_session

    sf_dir = argv[0]
    names = argv[1:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in entry.oracle_sql():
                problem = difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
                rows = ""
            else:
                problem, rows = None, f"{len(spark_rows(spark, entry.queries()[name], sf_dir)[1])} rows"
        except Exception as failure:  # noqa: BLE001
            problem, rows = f"{type(failure).__name__}: {str(failure)[:900]}", ""
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {rows} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
