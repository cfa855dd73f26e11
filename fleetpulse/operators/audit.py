"""Audit of SQL statements in a log, and the guarded ad-hoc query."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.constants import MAX_ROWS
from fleetpulse.functions.text import KEYWORD_PATTERN, append_limit, has_limit, is_read_only, normalize_sql, read_only_reason
from fleetpulse.limits import within
from fleetpulse.session import shared_folder


def read_only_audit(log: DataFrame, column: str = "sql_text") -> DataFrame:
    """Statements per refusal reason; allowed ones have reason ``allowed``."""
    sql = F.col(column)
    return (
        log.select(F.coalesce(read_only_reason(sql), F.lit("allowed")).alias("reason"), is_read_only(sql).alias("read_only"))
        .groupBy("reason", "read_only")
        .agg(F.count("*").alias("statements"))
    )


def normalise_log(log: DataFrame, column: str = "sql_text") -> DataFrame:
    """Each distinct normalised statement with its count, whether it has a limit, and its capped text."""
    return (
        log.groupBy(normalize_sql(F.col(column)).alias("statement"))
        .agg(F.count("*").alias("runs"))
        .withColumn("has_limit", has_limit(F.col("statement")))
        .withColumn("capped", append_limit(F.col("statement")))
    )


def _is_query(spark: SparkSession, body: str) -> bool:
    """Whether the parser reads ``body`` as a query: no node of its plan is a command or a statement that writes."""
    jvm = spark._jvm
    package = "org.apache.spark.sql.catalyst.plans.logical"
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    refused = [jvm.java.lang.Class.forName(f"{package}.{name}", True, loader) for name in ("Command", "ParsedStatement")]
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"\{(\w+)\}", r"\1", body))
    except Py4JJavaError:
        return False
    except PySparkException:
        return False
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        if any(kind.isInstance(node) for kind in refused):
            return False
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    return True


def run_select(
    spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, seconds: float | None = None, **inputs: DataFrame
) -> DataFrame:
    """Run one SELECT and keep at most ``max_rows`` rows; anything else is refused before it runs.

    With ``seconds`` the query runs now, into a table of those rows, and
    ``TimeLimitExceeded`` is raised if it takes longer; without, it runs when the
    result is used.
    """
    body = sql.strip()
    allowed = body.lower().startswith("select") and ";" not in body and not re.search(KEYWORD_PATTERN, body)
    if not allowed or not _is_query(spark, body):
        raise ValueError("Only single SELECT statements are allowed")
    rows = spark.sql(body, **inputs).limit(max_rows)
    if seconds is None:
        return rows
    path = shared_folder(spark, "select")
    within(spark, seconds, lambda: rows.write.parquet(path))
    return spark.read.schema(rows.schema).parquet(path)
