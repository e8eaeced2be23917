"""Compare registered queries with their SQL: `python tests/parity.py DIR [name ...]`."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def duck(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def mismatch(spark, connection, sf_dir, build, sql) -> str | None:
    """None when both sides agree, else a description of the first difference."""
    frame = build(spark, sf_dir)
    left = normalise(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = connection.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    right = normalise([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    for name, dtype in frame.dtypes:
        if SQL_TYPES[dtype] != types[name]:
            return f"type of {name}: {dtype} != {types[name]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"{left[0]}\n  spark {a}\n  sql   {b}"
    return None


def main(argv):
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir, wanted = argv[0], argv[1:]
    spark, connection = make_session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name, build in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        if name in sql:
            result = mismatch(spark, connection, sf_dir, build, sql[name]) or "ok"
        else:
            result = f"no sql, {build(spark, sf_dir).count()} rows"
        print(f"{name:28s} {time.time() - start:6.2f}s  {result}", flush=True)
    print("sql without query:", sorted(set(sql) - set(queries)))


if __name__ == "__main__":
    main(sys.argv[1:])
