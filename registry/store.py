"""Result store: latest results, freshness, retention, refresh."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetpulse.constants import CHECK_TYPES
from fleetpulse.operators import metrics, reports
from fleetpulse.session import shared_folder
from fleetpulse.sources import store
from registry import health
from registry.base import AS_OF_SQL, register, sec, seconds
from registry.fixtures import view

NOW = datetime(2024, 1, 29)
NOW_SQL = "TIMESTAMP '2024-01-29 00:00:00'"
LATEST = """latest AS (SELECT * FROM v_check_results WHERE status = 'success'
  QUALIFY row_number() OVER (PARTITION BY database_id, check_type ORDER BY executed_at DESC, id DESC) = 1)"""
TYPES = "types AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in CHECK_TYPES) + "]) AS check_type)"
GRID = "(SELECT database_id, check_type FROM (SELECT DISTINCT database_id FROM v_check_results) d, types)"
EXPIRY = "90 minutes"
FRESH = "COALESCE(executed_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 HOUR, false)"
AS_OF = datetime(2024, 1, 31)


@register(
    "latest_per_check",
    f"SELECT database_id, check_type, id, result_data, {sec('executed_at')} AS executed_at, execution_time_ms FROM latest",
    extra=(LATEST,),
)
def latest_per_check(spark, sf):
    return store.latest_per_check(view(spark, sf, "v_check_results")).select(
        "database_id", "check_type", "id", "result_data", *seconds("executed_at"), "execution_time_ms"
    )


@register(
    "freshness",
    f"SELECT check_type, {FRESH} AS fresh, COUNT(*) AS results FROM v_check_results GROUP BY 1, 2",
)
def freshness(spark, sf):
    fresh = store.freshness(AS_OF, "30 hours").alias("fresh")
    return view(spark, sf, "v_check_results").groupBy("check_type", fresh).agg(F.count("*").alias("results"))


@register(
    "check_status_payload",
    f"""SELECT database_id, check_type, COALESCE(result_data, '[]') AS data, COALESCE(status, 'pending') AS status,
      {sec('executed_at')} AS executed_at, {FRESH} AS fresh
    FROM {GRID} g LEFT JOIN latest USING (database_id, check_type)""",
    extra=(LATEST, TYPES),
)
def check_status_payload(spark, sf):
    out = store.check_status_payload(view(spark, sf, "v_check_results"), AS_OF, "30 hours")
    return out.select("database_id", "check_type", "data", "status", *seconds("executed_at"), "fresh")


@register(
    "stale_checks",
    f"""SELECT database_id, check_type, {sec('executed_at')} AS last_success
    FROM {GRID} g LEFT JOIN latest USING (database_id, check_type) WHERE NOT {FRESH}""",
    extra=(LATEST, TYPES),
)
def stale_checks(spark, sf):
    return store.stale_checks(view(spark, sf, "v_check_results"), AS_OF, "30 hours").select(
        "database_id", "check_type", *seconds("last_success")
    )


@register(
    "store_counts",
    f"""SELECT check_type, COALESCE(n, 0) AS results, COALESCE(recent, 0) AS recent_24h,
      CASE WHEN executed_at IS NOT NULL THEN 'success' END AS latest_status,
      CASE WHEN executed_at IS NULL THEN 'no data' WHEN {FRESH} THEN 'fresh' ELSE 'stale' END AS freshness
    FROM types LEFT JOIN (SELECT check_type, COUNT(*) AS n,
      COUNT(*) FILTER (WHERE executed_at > {AS_OF_SQL} - INTERVAL 24 HOUR) AS recent,
      MAX(executed_at) FILTER (WHERE status = 'success') AS executed_at FROM v_check_results GROUP BY 1) c USING (check_type)""",
    extra=(TYPES,),
)
def store_counts(spark, sf):
    return store.store_counts(view(spark, sf, "v_check_results"), AS_OF, "30 hours")


@register(
    "store_min_max",
    f"""SELECT database_id, {sec('MIN(executed_at)')} AS first_at, {sec('MAX(executed_at)')} AS last_at
    FROM v_check_results WHERE check_type = 'database_snapshot' GROUP BY database_id""",
)
def store_min_max(spark, sf):
    rows = store.select_results(view(spark, sf, "v_check_results"), "database_snapshot")
    out = rows.groupBy("database_id").agg(F.min("executed_at").alias("first_at"), F.max("executed_at").alias("last_at"))
    return out.select("database_id", *seconds("first_at", "last_at"))


@register(
    "check_violations",
    """SELECT check_type, status, COUNT(*) AS "rows", check_type = 'other_check' AS bad_type, status = 'late' AS bad_status
    FROM (SELECT CASE WHEN id % 11 = 0 THEN 'other_check' ELSE check_type END AS check_type,
      CASE WHEN id % 13 = 0 THEN 'late' ELSE status END AS status FROM v_check_results) r
    WHERE check_type = 'other_check' OR status = 'late' GROUP BY 1, 2""",
)
def check_violations(spark, sf):
    return store.check_violations(_spoiled(spark, sf))


def _spoiled(spark, sf):
    """Results of which some have a type or a status that does not exist."""
    rows = view(spark, sf, "v_check_results")
    return rows.withColumn(
        "check_type", F.when(F.col("id") % 11 == 0, "other_check").otherwise(F.col("check_type"))
    ).withColumn("status", F.when(F.col("id") % 13 == 0, "late").otherwise(F.col("status")))


@register(
    "check_type_filter",
    """SELECT database_id, check_type, status, COUNT(*) AS results FROM v_check_results
    WHERE id % 11 <> 0 AND id % 13 <> 0 GROUP BY 1, 2, 3""",
)
def check_type_filter(spark, sf):
    return store.check_type_filter(_spoiled(spark, sf)).groupBy("database_id", "check_type", "status").agg(F.count("*").alias("results"))


@register(
    "retention_cleanup",
    f"""SELECT id, check_type, {sec('executed_at')} AS executed_at FROM v_check_results
    WHERE NOT (check_type = 'database_snapshot' AND executed_at < {NOW_SQL} - INTERVAL 9 DAY)""",
)
def retention_cleanup(spark, sf):
    """Store all results, delete old snapshots, and read what is left."""
    path = shared_folder(spark, "retention")
    store.append_check_result(view(spark, sf, "v_check_results"), path)
    store.retention_cleanup(spark, path, NOW, 9)
    return store.read_check_results(spark, path).select("id", "check_type", *seconds("executed_at"))


@register(
    "result_cleanup",
    f"""SELECT id, check_type, {sec('executed_at')} AS executed_at FROM v_check_results
    WHERE executed_at >= {NOW_SQL} - INTERVAL 5 DAY - INTERVAL 7 HOUR""",
)
def result_cleanup(spark, sf):
    """Store all results, delete the old ones of every type, part of a day among them, and read what is left."""
    path = shared_folder(spark, "cleanup")
    store.append_check_result(view(spark, sf, "v_check_results"), path)
    store.result_cleanup(spark, path, NOW - timedelta(hours=7), 5)
    return store.read_check_results(spark, path).select("id", "check_type", *seconds("executed_at"))


@register(
    "retention_split",
    f"""SELECT check_type, COUNT(*) FILTER (WHERE NOT gone) AS kept, COUNT(*) FILTER (WHERE gone) AS deleted
    FROM (SELECT check_type, executed_at < {NOW_SQL} - INTERVAL 5 DAY AS gone FROM v_check_results) r GROUP BY check_type""",
)
def retention_split(spark, sf):
    return store.retention_split(view(spark, sf, "v_check_results"), store.expired(NOW, 5))


@register(
    "append_check_result",
    f"""SELECT id, database_id, result_data, {sec('executed_at')} AS executed_at FROM v_check_results
    WHERE check_type = 'table_bloat' AND status = 'success'""",
)
def append_check_result(spark, sf):
    """Store all results, then read one type and status back from its partitions."""
    path = shared_folder(spark, "result-store")
    store.append_check_result(view(spark, sf, "v_check_results"), path)
    rows = store.read_check_results(spark, path, "table_bloat", "success")
    return rows.select("id", "database_id", "result_data", *seconds("executed_at"))


def _stored(check_type: str, item: str, source: str) -> str:
    """Items of a report as the store has them, and an empty row for a database without any."""
    return f"""SELECT d.database_id, '{check_type}' AS check_type, 'success' AS status, item
      FROM every d LEFT JOIN (SELECT database_id, {item} AS item FROM {source}) r USING (database_id)"""


EVERY = """every AS (SELECT DISTINCT database_id FROM v_table_stats UNION SELECT DISTINCT database_id FROM v_activity)"""
SETTINGS_NOW = f"v_settings WHERE name IN {health.REVIEWED} AND database_id IN (SELECT database_id FROM every)"


@register(
    "refresh_all",
    " UNION ALL ".join(
        [
            _stored("unused_indexes", "indexrelname", f"(SELECT * FROM {health.UNUSED}) u {health._top(10, 'index_bytes DESC NULLS FIRST, schemaname, indexrelname')}"),
            _stored("missing_indexes", "concat(schemaname, '.', relname)", f"v_tables_now WHERE {health.PUBLIC} AND seq_scan > 180 AND idx_scan = 0 {health._top(10, 'seq_scan DESC NULLS FIRST, schemaname, relname')}"),
            _stored("sequential_scans", "concat(schemaname, '.', relname)", f"v_tables_now WHERE {health.PUBLIC} AND seq_scan > 100 {health._top(10, 'seq_scan DESC NULLS FIRST, schemaname, relname')}"),
            _stored("slow_queries", "query", f"v_statements_now {health._top(10, 'total_exec_time DESC NULLS FIRST, query')}"),
            _stored("table_bloat", "concat(schemaname, '.', relname)", f"{health.DEAD} {health._top(10, health.PCT + ' DESC NULLS FIRST, n_dead_tup DESC NULLS FIRST, schemaname, relname')}"),
            _stored("parameter_settings", "concat(name, '=', setting)", SETTINGS_NOW),
            _stored("database_snapshot", "CAST(n AS VARCHAR)", "(SELECT database_id, COUNT(*) AS n FROM v_activity GROUP BY 1) a"),
        ]
    ),
    extra=(EVERY,),
)
def refresh_all(spark, sf):
    """Run all seven checks into a new store and read the items of what was stored."""
    path = shared_folder(spark, "refresh")
    tables, indexes, statements = health._tables(spark, sf), health._indexes(spark, sf), health._statements(spark, sf)
    activity = view(spark, sf, "v_activity")
    every = tables.select("database_id").unionByName(activity.select("database_id")).distinct()
    settings = view(spark, sf, "v_settings").join(every, "database_id", "left_semi")
    snapshot = metrics.snapshot_metrics(tables, statements, activity, health._io(spark, sf), ["database_id"])
    checks = {
        "unused_indexes": reports.unused_indexes(indexes, view(spark, sf, "v_constraints")),
        "missing_indexes": reports.missing_indexes(tables, min_seq=180),
        "sequential_scans": reports.sequential_scans(tables),
        "slow_queries": reports.slow_queries(statements),
        "table_bloat": reports.table_bloat(tables),
        "parameter_settings": reports.parameter_settings(settings),
        "database_snapshot": snapshot,
    }
    store.refresh_all(spark, checks, path, AS_OF - timedelta(hours=1), every)
    rows = store.read_check_results(spark, path)
    item = F.from_json("result_data", "array<map<string,string>>")
    named = rows.withColumn("i", F.explode_outer(item)).withColumn(
        "item",
        F.coalesce(
            F.concat(F.col("i")["name"], F.lit("="), F.col("i")["setting"]),
            *[F.col("i")[name] for name in ("index", "table", "table_name", "query", "total_connections")],
        ),
    )
    return named.select("database_id", "check_type", "status", "item")
