"""Compare a Spark result with the same query in DuckDB."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: names, types, or rows that only one side has."""
    relation = con.sql(sql)
    types = {n: KINDS.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    found = []
    if sorted(df.columns) != sorted(types):
        return [f"columns: {sorted(df.columns)} against {sorted(types)}"]
    found += [f"type of {n}: {t} against {types[n]}" for n, t in df.dtypes if t != types[n]]
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    if ours != theirs:
        found.append(f"rows: {ours.total()} against {theirs.total()}")
        found += [f"  only Spark:  {str(r)[:400]}" for r in list(ours - theirs)[:2]]
        found += [f"  only DuckDB: {str(r)[:400]}" for r in list(theirs - ours)[:2]]
    return found
