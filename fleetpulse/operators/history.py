"""Execution log: lifecycle, flags, history and the catalogue of saved queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.ladders import performance_class
from fleetpulse.functions.numbers import duration_ms, format_cost, format_duration
from fleetpulse.functions.text import normalize_sql, strip, truncate_text
from fleetpulse.operators.skew import newest
from fleetpulse.sources.commits import CommittedTable


def analyzable_executions(executions: DataFrame) -> DataFrame:
    """Completed, analysed executions that have a plan; a log without plan texts tells by its keys."""
    plan = "execution_plan" if "execution_plan" in executions.columns else "plan_key"
    return executions.filter(
        (F.col("status") == "completed") & F.col("execution_type").isin("analyze", "both") & F.col(plan).isNotNull()
    )


def _filled(value: Column) -> Column:
    return F.coalesce(strip(value) != "", F.lit(False))


def has_plan_data(executions: DataFrame) -> Column:
    """A plan text that is not empty; an empty JSON list or object holds no plan.

    A log without plan texts tells by the state of its plans.
    """
    if "execution_plan" not in executions.columns:
        return F.col("plan_state").isin("ok", "malformed", "too_deep", "unread")
    return _filled(F.col("execution_plan")) & ~strip(F.col("execution_plan")).isin("[]", "{}", "null")


def execution_flags(executions: DataFrame) -> DataFrame:
    status, kind = F.col("status"), F.col("execution_type")
    completed = status == "completed"
    return executions.select(
        "*",
        (status == "pending").alias("is_pending"),
        (status == "running").alias("is_running"),
        completed.alias("is_completed"),
        (status == "failed").alias("is_failed"),
        (completed & ~_filled(F.col("error_message"))).alias("is_success"),
        kind.isin("execute", "both").alias("includes_execution"),
        kind.isin("analyze", "both").alias("includes_analysis"),
        (F.col("planning_time_ms").isNotNull() | F.col("execution_time_ms").isNotNull()).alias("has_timing_data"),
        has_plan_data(executions).alias("has_plan_data"),
        F.col("result_rows_count").isNotNull().alias("has_result_data"),
    )


def display_title() -> Column:
    return F.when(_filled(F.col("sql_text")), truncate_text(F.col("sql_text"), 50)).otherwise(
        F.concat(F.lit("Query #"), F.col("exec_id").cast("string"))
    )


def display_summary() -> Column:
    """Time, cost and rows, those that are known, joined by bullets."""
    return F.concat_ws(
        " • ",
        format_duration(F.col("total_time_ms")),
        F.concat(F.lit("Cost: "), format_cost(F.col("query_cost"))),
        F.concat(F.col("result_rows_count").cast("string"), F.lit(" rows")),
    )


def result_summary() -> Column:
    def counted(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    return F.concat(
        counted(F.col("result_rows_count"), "row"), F.lit(" • "), counted(F.col("result_columns_count"), "column")
    )


def query_history(executions: DataFrame, limit: int = 10) -> DataFrame:
    """The newest analysable executions; only ``limit`` rows are formatted."""
    return (
        analyzable_executions(executions)
        .orderBy(F.col("created_at").desc_nulls_first(), F.col("exec_id").desc())
        .limit(limit)
        .select(
            "exec_id",
            display_title().alias("title"),
            display_summary().alias("summary"),
            performance_class(F.col("total_time_ms")).alias("performance_class"),
            F.date_format("created_at", "MM/dd HH:mm").alias("created_at"),
            "total_time_ms",
            "query_cost",
            "sql_text",
        )
    )


def execution_query_join(executions: DataFrame, queries: DataFrame) -> DataFrame:
    """Executions with the saved query they belong to, if any.

    Most executions may belong to no query.  Those rows would all hash to the
    NULL key, so they get a key of their own that no query has, spread over tasks.
    """
    saved = queries.select(
        F.col("id").alias("_id"), F.lit(0).alias("_spread"), F.col("name").alias("query_name"), F.col("category").alias("query_category")
    )
    apart = F.when(F.col("query_id").isNull(), 1 + F.pmod(F.xxhash64("exec_id"), F.lit(1 << 20))).otherwise(0)
    linked = executions.withColumn("_key", F.coalesce("query_id", F.lit(0))).withColumn("_apart", apart)
    same = (F.col("_key") == F.col("_id")) & (F.col("_apart") == F.col("_spread"))
    return linked.join(saved, same, "left").drop("_key", "_apart", "_id", "_spread")


def execution_state(events: DataFrame) -> DataFrame:
    """Current state of each execution from append-only lifecycle events.

    ``events`` has ``exec_id, status, at, error_message``.
    """
    step = (
        F.when(F.col("status") == "pending", 0).when(F.col("status") == "running", 1).otherwise(2)
    )
    ended = F.col("status").isin("completed", "failed")
    grouped = events.groupBy("exec_id").agg(
        newest(F.struct("status", "error_message"), step, F.col("at")).alias("_last"),
        F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("completed_at"),
    )
    return grouped.select(
        "exec_id",
        F.col("_last.status").alias("status"),
        F.col("_last.error_message").alias("error_message"),
        "started_at",
        "completed_at",
        duration_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"),
    )


EVENT_SCHEMA = "exec_id bigint, status string, at timestamp_ntz, error_message string"


def execution_log(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, path, ["happened_in"])


def append_execution(events: DataFrame, path: str, run: str | None = None) -> bool:
    """Append lifecycle events, partitioned by the month they happened in; False if ``run`` was appended before."""
    month = F.trunc(F.to_date("at"), "month")
    return execution_log(events.sparkSession, path).append(events.withColumn("happened_in", month), run)


def read_executions(spark: SparkSession, path: str) -> DataFrame:
    """All lifecycle events of a log."""
    return execution_log(spark, path).read(EVENT_SCHEMA + ", happened_in date").drop("happened_in")


def lifecycle_event(executions: DataFrame, status: str, at: datetime, error: str | None = None) -> DataFrame:
    """Rows that move ``executions`` to ``status``."""
    return executions.select(
        "exec_id",
        F.lit(status).alias("status"),
        F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("at"),
        F.lit(error).cast("string").alias("error_message"),
    )


# --- catalogue of saved queries -------------------------------------------------


def query_catalog(built_in: DataFrame, saved: DataFrame) -> DataFrame:
    """Built-in queries followed by saved ones; a missing category reads ``saved``."""
    columns = ["id", "name", "sql", "description", "category"]
    text_id = F.col("id").cast("string").alias("id")
    own = saved.select(text_id, "name", "sql", "description", F.coalesce("category", F.lit("saved")).alias("category"))
    return built_in.select(text_id, *columns[1:]).unionByName(own)


def saved_queries_ordered(queries: DataFrame) -> DataFrame:
    return queries.orderBy(F.col("updated_at").desc_nulls_first(), "id")


def name_dedup(queries: DataFrame) -> DataFrame:
    """One query per name regardless of case; the last update wins."""
    row = F.struct(*[F.col(c) for c in queries.columns])
    return (
        queries.groupBy(F.lower("name").alias("name_key"))
        .agg(newest(row, F.col("updated_at"), F.col("id")).alias("_row"), F.count("*").alias("copies"))
        .select("name_key", "copies", "_row.*")
    )


def saved_query_validation(queries: DataFrame, max_description: int = 500) -> DataFrame:
    """Saved queries that break a rule, with the reasons."""
    reasons = F.array_compact(
        F.array(
            F.when(~_filled(F.col("name")), "name can't be blank"),
            F.when(~_filled(F.col("sql")), "sql can't be blank"),
            F.when(F.length("description") > max_description, f"description is too long (maximum is {max_description} characters)"),
            F.when(~_filled(F.col("category")), "category can't be blank"),
        )
    )
    return queries.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def statement_key() -> Column:
    """The text executions are compared under."""
    return normalize_sql(F.col("sql_text"))
