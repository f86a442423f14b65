"""Run registered queries on Spark and their SQL on DuckDB and compare them."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


SAME_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp",
}


def difference(spark, con, query, sql, folder) -> str | None:
    """None if both agree in columns, types and rows, else what differs."""
    df = query(spark, folder)
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: SAME_TYPE.get(str(d[1]), str(d[1])) for d in result.description}
    want_columns, want = canonical(names, result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if spark_types(df) != types:
        return f"types {spark_types(df)} != {types}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; only Spark {extra}; only SQL {missing}"
    return None
