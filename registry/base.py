"""Registration of queries and small helpers for the checking SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.fixtures import NODES, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
SECOND = "yyyy-MM-dd HH:mm:ss"


def register(name: str, sql: str | None = None, nodes: bool = False, extra: Sequence[str] = ()):
    """Register a query and the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *((NODES,) if nodes else ()), *extra)
        return fn

    return add


def seconds(*columns: str) -> list:
    """Times as text to the second, under their own names."""
    return [F.date_format(c, SECOND).alias(c) for c in columns]


def joined(column: str, name: str | None = None):
    return F.array_join(column, " | ").alias(name or column)


# --- SQL of the checking side ------------------------------------------------------


def sec(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def rnd(value: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def plain(value: str, digits: int) -> str:
    text = f"CAST(ROUND(CAST({value} AS DECIMAL(28,10)), {digits}) AS VARCHAR)"
    return f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '.0')"


def pretty(size: str) -> str:
    steps = [f"WHEN {size} IS NULL THEN NULL WHEN {size} < 10240 THEN concat({size}, ' bytes')"]
    for unit, factor in (("kB", 1024), ("MB", 1024**2), ("GB", 1024**3)):
        value = f"(({size} + {factor // 2}) // {factor})"
        steps.append(f"WHEN {value} < 10240 THEN concat({value}, ' {unit}')")
    last = f"(({size} + {1024**4 // 2}) // {1024**4})"
    return f"CASE {' '.join(steps)} ELSE concat({last}, ' TB') END"


def size_bytes(text: str) -> str:
    number = f"CAST(regexp_extract({text}, '([0-9]+([.][0-9]+)?)\\s*(kB|MB|GB|TB)', 1, 'i') AS DOUBLE)"
    unit = f"upper(regexp_extract({text}, '([0-9]+([.][0-9]+)?)\\s*(kB|MB|GB|TB)', 3, 'i'))"
    return (
        f"CASE {unit} WHEN 'KB' THEN {number} * 1024 WHEN 'MB' THEN {number} * 1048576 WHEN 'GB' THEN {number} * 1073741824"
        f" WHEN 'TB' THEN {number} * 1099511627776"
        f" ELSE CASE WHEN regexp_full_match({text}, '[0-9]+([.][0-9]+)?') THEN CAST({text} AS DOUBLE) END END"
    )
