"""Runs queries next to their SQL and compares rows, as the correctness gate does.

    python -m suite.compare FOLDER [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from rotaflow.plans.timeline import MAX_ROWS
from rotaflow.session import local_session
from suite.oracle import ORACLE
from suite.queries import QUERIES, Given


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return str(value)
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = sorted(tuple(normal(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], made


def difference(df, con, statement: str) -> str:
    """Empty if both sides give the same columns, types and rows; else what differs."""
    mine = rows_of(df.columns, df.collect())
    result = con.execute(statement)
    kinds = {d[0]: str(d[1]).lower() for d in result.description}
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    match = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
             "boolean": "boolean", "timestamp_ntz": "timestamp", "date": "date"}
    for name, kind in df.dtypes:
        if match.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


def main(folder: str, names: list[str], max_rows: int = MAX_ROWS) -> int:
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](Given(spark, folder, max_rows))
            if name in ORACLE:
                answer = difference(df, con, ORACLE[name])
                answer = answer or "ok"
            else:
                answer = f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            answer = f"{type(error).__name__}: {str(error)[:600]}"
        bad += answer != "ok" and not answer.startswith("rows only")
        print(f"{name:32s} {time.time() - started:6.2f}s {answer}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    limit = MAX_ROWS
    arguments = sys.argv[1:]
    if arguments[0].startswith("--max-rows="):
        limit = int(arguments.pop(0).split("=")[1])
    sys.exit(1 if main(arguments[0], arguments[1:], limit) else 0)
