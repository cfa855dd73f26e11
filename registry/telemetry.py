"""Telemetry tables written as a collector would, read through their schemas, reduced to the newest capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators.reports import latest_capture
from fleetpulse.session import shared_folder
from fleetpulse.sources import telemetry
from registry.base import register, sec, seconds
from registry.fixtures import newest, view

OLD, NEW = "TIMESTAMP '2024-01-30 12:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"


def scanned(spark, sf, name, relation, read):
    """Write a history as Parquet, a file of the schema's columns, and give its newest capture as the reader sees it."""
    rows = view(spark, sf, name)
    if "captured_at" not in rows.columns:
        captures = F.array(*[F.expr(t).cast("timestamp_ntz") for t in (OLD, NEW)])
        rows = rows.withColumn("captured_at", F.explode(captures))
    known = [c.split()[0] for c in telemetry.SCHEMAS[relation].split(",")]
    path = shared_folder(spark, f"scan-{relation}")
    rows.select(*[c for c in known if c in rows.columns]).write.parquet(path)
    return latest_capture(read(spark, path))


@register(
    "scan_table_stats",
    f"""SELECT database_id, schemaname, relname, relid, seq_scan, idx_scan, n_live_tup, n_dead_tup, total_bytes,
      {sec('last_vacuum')} AS last_vacuum FROM v_tables_now""",
)
def scan_table_stats(spark, sf):
    rows = newest(spark, sf, "v_table_history", "table_stats")
    return rows.select(
        "database_id", "schemaname", "relname", "relid", "seq_scan", "idx_scan", "n_live_tup", "n_dead_tup", "total_bytes",
        *seconds("last_vacuum"),
    )


@register(
    "scan_index_stats",
    "SELECT database_id, schemaname, relname, indexrelname, indexrelid, idx_scan, idx_tup_read, index_bytes FROM v_indexes_now",
)
def scan_index_stats(spark, sf):
    return newest(spark, sf, "v_index_history", "index_stats").drop("captured_at")


@register(
    "scan_statement_stats",
    'SELECT database_id, query, calls, total_exec_time, mean_exec_time, "rows" FROM v_statements_now',
)
def scan_statement_stats(spark, sf):
    return newest(spark, sf, "v_statement_history", "statement_stats").drop("captured_at")


@register(
    "scan_settings",
    """SELECT database_id, name, setting, unit, short_desc, CAST(NULL AS VARCHAR) AS context, CAST(NULL AS VARCHAR) AS vartype
    FROM v_settings""",
)
def scan_settings(spark, sf):
    """Columns that a collector did not write are NULL."""
    return scanned(spark, sf, "v_settings", "settings", telemetry.scan_settings).drop("captured_at")


@register("scan_activity", "SELECT database_id, pid, state FROM v_activity")
def scan_activity(spark, sf):
    return scanned(spark, sf, "v_activity", "activity", telemetry.scan_activity).drop("captured_at")


@register(
    "scan_io_stats",
    """SELECT database_id, COUNT(*) AS tables, CAST(SUM(heap_blks_hit) AS BIGINT) AS hits, CAST(SUM(heap_blks_read) AS BIGINT) AS reads
    FROM v_tables_now GROUP BY database_id""",
)
def scan_io_stats(spark, sf):
    rows = newest(spark, sf, "v_table_history", "io_stats")
    return rows.groupBy("database_id").agg(
        F.count("*").alias("tables"), F.sum("heap_blks_hit").alias("hits"), F.sum("heap_blks_read").alias("reads")
    )
