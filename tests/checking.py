"""Run registered queries beside their checking SQL and compare rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SQL_KINDS = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"}, "date": {"DATE"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def check(spark, con, query, sql, sf_dir) -> tuple[str, float, str]:
    """Empty text when both sides agree, otherwise what differs; the Spark time; and the physical plan."""
    started = time.time()
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    took = time.time() - started
    if sql is None:
        return "", took, plan
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    rows = cursor.fetchall()
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", took, plan
    spark_kinds = dict(df.dtypes)
    odd = {c: (spark_kinds[c], kinds[c]) for c in columns if kinds[c] not in SQL_KINDS.get(spark_kinds[c], set())}
    if odd:
        return f"types {odd}", took, plan
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rows]
    a, b = sorted(map(repr, got)), sorted(map(repr, want))
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"{len(a)} vs {len(b)} rows; {columns}\n  spark {only_a[:3]}\n  sql   {only_b[:3]}", took, plan
    return "", took, plan
