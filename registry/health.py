"""Index, table, statement and settings reports; snapshot metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import metrics, reports
from fleetpulse.sources.telemetry import list_extensions
from registry.base import pretty, register, rnd, sec, seconds
from registry.fixtures import newest, view

DB = ["database_id"]
PUBLIC = "schemaname = 'public'"
PCT = rnd("n_dead_tup * 100.0 / (n_live_tup + n_dead_tup)", 2)
ADVICE = """CASE name WHEN 'shared_buffers' THEN 'Recommended: 25% of total system RAM.'
  WHEN 'work_mem' THEN 'Recommended: Based on RAM, connections, and query complexity. Default is often too low.'
  WHEN 'effective_cache_size' THEN 'Recommended: 75% of total system RAM.'
  WHEN 'max_connections' THEN 'Varies. Check your connection pooler settings.'
  WHEN 'maintenance_work_mem' THEN 'Recommended: 10% of RAM (up to 2GB).'
  WHEN 'checkpoint_completion_target' THEN 'Recommended: 0.9' END"""
REVIEWED = "('shared_buffers', 'work_mem', 'effective_cache_size', 'max_connections', 'maintenance_work_mem', 'checkpoint_completion_target')"


def _tables(spark, sf):
    return newest(spark, sf, "v_table_history", "table_stats")


def _io(spark, sf):
    return newest(spark, sf, "v_table_history", "io_stats")


def _indexes(spark, sf):
    return newest(spark, sf, "v_index_history", "index_stats")


def _statements(spark, sf):
    return newest(spark, sf, "v_statement_history", "statement_stats")


def _top(rows: int, order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY database_id ORDER BY {order}) <= {rows}"


FREE = "indexrelid NOT IN (SELECT conindid FROM v_constraints c WHERE c.database_id = i.database_id)"
UNUSED = f"v_indexes_now i WHERE {PUBLIC} AND idx_scan < 50 AND {FREE}"
DEAD = f"""v_tables_now WHERE {PUBLIC} AND n_live_tup + n_dead_tup > 0
  AND (n_dead_tup * 10 > n_live_tup + n_dead_tup OR n_dead_tup > 1000) AND total_bytes > 1048576"""


@register(
    "unused_indexes",
    f"""SELECT database_id, concat(schemaname, '.', relname) AS "table", indexrelname AS "index",
      {pretty('index_bytes')} AS index_size, idx_scan AS index_scans
    FROM (SELECT * FROM {UNUSED}) u {_top(10, "index_bytes DESC NULLS FIRST, schemaname, indexrelname")}""",
)
def unused_indexes(spark, sf, limit=10):
    return reports.unused_indexes(_indexes(spark, sf), view(spark, sf, "v_constraints"), limit=limit)


@register(
    "unused_index_antijoin",
    f"SELECT database_id, indexrelid, indexrelname, idx_scan FROM v_indexes_now i WHERE {FREE}",
)
def unused_index_antijoin(spark, sf):
    kept = reports.without_constraint(_indexes(spark, sf), view(spark, sf, "v_constraints"))
    return kept.select("database_id", "indexrelid", "indexrelname", "idx_scan")


@register(
    "missing_indexes",
    f"""SELECT database_id, concat(schemaname, '.', relname) AS "table", seq_scan, idx_scan, {pretty('total_bytes')} AS table_size
    FROM v_tables_now WHERE {PUBLIC} AND seq_scan > 180 AND idx_scan = 0 {_top(10, "seq_scan DESC NULLS FIRST, schemaname, relname")}""",
)
def missing_indexes(spark, sf):
    return reports.missing_indexes(_tables(spark, sf), min_seq=180)


@register(
    "sequential_scans",
    f"""SELECT database_id, concat(schemaname, '.', relname) AS "table", seq_scan, seq_tup_read, {pretty('total_bytes')} AS table_size
    FROM v_tables_now WHERE {PUBLIC} AND seq_scan > 100 {_top(10, "seq_scan DESC NULLS FIRST, schemaname, relname")}""",
)
def sequential_scans(spark, sf):
    return reports.sequential_scans(_tables(spark, sf))


@register(
    "slow_queries",
    f"""SELECT database_id, query, calls, total_exec_time, mean_exec_time, "rows" FROM v_statements_now
    {_top(10, "total_exec_time DESC NULLS FIRST, query")}""",
)
def slow_queries(spark, sf, limit=10):
    return reports.slow_queries(_statements(spark, sf), limit)


@register(
    "table_bloat",
    f"""SELECT database_id, concat(schemaname, '.', relname) AS table_name, {pretty('total_bytes')} AS table_size, n_dead_tup,
      n_live_tup, {PCT} AS dead_tuple_pct, total_bytes // 1048576 AS table_mb,
      CASE WHEN {PCT} > 50 THEN 'danger' ELSE 'warning' END AS severity,
      {sec('last_vacuum')} AS last_vacuum, {sec('last_autovacuum')} AS last_autovacuum,
      {sec('last_analyze')} AS last_analyze, {sec('last_autoanalyze')} AS last_autoanalyze
    FROM {DEAD} {_top(10, f"{PCT} DESC NULLS FIRST, n_dead_tup DESC NULLS FIRST, schemaname, relname")}""",
)
def table_bloat(spark, sf):
    out = reports.table_bloat(_tables(spark, sf))
    times = ["last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze"]
    return out.select(*[c for c in out.columns if c not in times], *seconds(*times))


@register(
    "fleet_table_sizes",
    f"""SELECT relname AS table_name, total_bytes AS size_bytes FROM v_tables_now WHERE {PUBLIC}
    ORDER BY total_bytes DESC NULLS FIRST, relname LIMIT 10""",
)
def fleet_table_sizes(spark, sf):
    """One ranking over all databases: each task keeps ten rows."""
    return reports.table_sizes(_tables(spark, sf), keys=())


@register(
    "table_sizes",
    f"""SELECT database_id, relname AS table_name, total_bytes AS size_bytes FROM v_tables_now WHERE {PUBLIC}
    {_top(10, "total_bytes DESC NULLS FIRST, relname")}""",
)
def table_sizes(spark, sf):
    return reports.table_sizes(_tables(spark, sf))


@register(
    "table_activity",
    f"""SELECT database_id, concat(schemaname, '.', relname) AS "table", n_tup_ins AS inserts, n_tup_upd AS updates,
      n_tup_del AS deletes FROM v_tables_now WHERE {PUBLIC}
    {_top(8, "n_tup_ins + n_tup_upd + n_tup_del DESC NULLS FIRST, schemaname, relname")}""",
)
def table_activity(spark, sf):
    return reports.table_activity(_tables(spark, sf))


@register(
    "index_usage",
    f"""SELECT database_id, concat(schemaname, '.', indexrelname) AS "index", idx_scan AS scans, idx_tup_read AS tuples_read
    FROM v_indexes_now WHERE {PUBLIC} AND idx_scan > 0 {_top(10, "idx_scan DESC NULLS FIRST, schemaname, indexrelname")}""",
)
def index_usage(spark, sf):
    return reports.index_usage(_indexes(spark, sf))


@register(
    "never_used_indexes",
    f"""SELECT database_id, concat(schemaname, '.', indexrelname) AS "index", idx_scan AS scans, {pretty('index_bytes')} AS index_size
    FROM v_indexes_now WHERE {PUBLIC} AND idx_scan = 0 {_top(12, "index_bytes DESC NULLS FIRST, schemaname, indexrelname")}""",
)
def never_used_indexes(spark, sf):
    return reports.never_used_indexes(_indexes(spark, sf))


@register(
    "slowest_queries",
    f"""SELECT database_id, query, calls, {rnd('mean_exec_time', 2)} AS mean_time_ms, {rnd('total_exec_time', 2)} AS total_time_ms
    FROM v_statements_now {_top(10, "mean_exec_time DESC NULLS FIRST, query")}""",
)
def slowest_queries(spark, sf):
    return reports.slowest_queries(_statements(spark, sf))


@register(
    "dead_rows_report",
    f"""SELECT database_id, relname AS "table", n_live_tup AS live_rows, n_dead_tup AS dead_rows, {pretty('total_bytes')} AS table_size
    FROM v_tables_now WHERE {PUBLIC} AND n_dead_tup > 0 {_top(10, "n_dead_tup DESC NULLS FIRST, relname")}""",
)
def dead_rows_report(spark, sf):
    return reports.dead_rows_report(_tables(spark, sf))


@register(
    "parameter_settings",
    f"""SELECT database_id, name, setting, unit, short_desc, {ADVICE} AS recommendation,
      CAST(setting AS DOUBLE) * CASE unit WHEN '8kB' THEN 8192 WHEN 'kB' THEN 1024 END AS bytes
    FROM v_settings WHERE name IN {REVIEWED}""",
)
def parameter_settings(spark, sf):
    return reports.parameter_settings(view(spark, sf, "v_settings"))


@register(
    "settings_recommendation_join",
    f"SELECT database_id, name, setting, unit, short_desc, {ADVICE} AS recommendation FROM v_settings",
)
def settings_recommendation_join(spark, sf):
    settings = view(spark, sf, "v_settings")
    out = reports.settings_with_advice(settings, reports.advice_table(settings))
    return out.select("database_id", "name", "setting", "unit", "short_desc", "recommendation")


@register(
    "health_card_counts",
    f"""SELECT database_id, 'settings' AS report, COUNT(*) AS items FROM v_settings WHERE name IN {REVIEWED} GROUP BY 1
    UNION ALL SELECT database_id, 'unused_indexes', COUNT(*) FROM {UNUSED} GROUP BY 1
    UNION ALL SELECT database_id, 'slow_queries', COUNT(*) FROM v_statements_now GROUP BY 1
    UNION ALL SELECT database_id, 'table_bloat', COUNT(*) FROM {DEAD} GROUP BY 1""",
)
def health_card_counts(spark, sf):
    return reports.health_card_counts(
        {
            "settings": reports.parameter_settings(view(spark, sf, "v_settings")),
            "unused_indexes": unused_indexes(spark, sf, limit=None),
            "slow_queries": slow_queries(spark, sf, limit=None),
            "table_bloat": reports.table_bloat(_tables(spark, sf), limit=None),
        }
    )


HIT = rnd("CASE WHEN SUM(heap_blks_hit) + SUM(heap_blks_read) = 0 THEN 0 ELSE SUM(heap_blks_hit) * 100.0 / (SUM(heap_blks_hit) + SUM(heap_blks_read)) END", 2)
BLOATED = "n_live_tup + n_dead_tup > 0 AND n_dead_tup * 10 > n_live_tup + n_dead_tup AND schemaname = 'public'"
AVG_BLOAT = rnd("COALESCE(AVG(n_dead_tup * 100.0 / (n_live_tup + n_dead_tup)), 0)", 2)
STATEMENTS = f"""{rnd('AVG(mean_exec_time)', 2)} AS avg_query_time, {rnd('quantile_cont(mean_exec_time, 0.95)', 2)} AS p95_query_time,
  COUNT(*) AS total_queries, CAST(SUM(calls) AS BIGINT) AS total_calls"""
CONNECTIONS = """COUNT(*) AS total_connections, COUNT(*) FILTER (WHERE state = 'active') AS active_connections,
  COUNT(*) FILTER (WHERE state = 'idle') AS idle_connections"""
SEQ = "COUNT(*) FILTER (WHERE seq_scan > 100) AS high_seq_scan_tables"


@register("cache_hit_rate", f"SELECT database_id, {HIT} AS cache_hit_rate FROM v_table_stats GROUP BY database_id")
def cache_hit_rate(spark, sf):
    return metrics.cache_hit_rate(view(spark, sf, "v_table_stats"), DB)


@register(
    "statement_summary",
    f"SELECT database_id, {STATEMENTS} FROM v_statements WHERE mean_exec_time > 0 GROUP BY database_id",
)
def statement_summary(spark, sf):
    return metrics.statement_summary(view(spark, sf, "v_statements"), DB)


@register(
    "bloat_summary",
    f"""SELECT database_id, COUNT(*) AS bloated_tables, {AVG_BLOAT} AS avg_bloat_pct FROM v_table_stats
    WHERE {BLOATED} GROUP BY database_id""",
)
def bloat_summary(spark, sf):
    return metrics.bloat_summary(view(spark, sf, "v_table_stats"), DB)


@register("connection_counts", f"SELECT database_id, {CONNECTIONS} FROM v_activity GROUP BY database_id")
def connection_counts(spark, sf):
    return metrics.connection_counts(view(spark, sf, "v_activity"), DB)


@register("high_seq_scan_count", f"SELECT database_id, {SEQ} FROM v_table_stats WHERE {PUBLIC} GROUP BY database_id")
def high_seq_scan_count(spark, sf):
    return metrics.high_seq_scan_count(view(spark, sf, "v_table_stats"), DB)


@register(
    "snapshot_metrics",
    f"""SELECT (SELECT {HIT} FROM v_table_stats) AS cache_hit_rate, s.*, b.*, c.*,
      (SELECT {SEQ} FROM v_table_stats WHERE {PUBLIC}) AS high_seq_scan_tables
    FROM (SELECT {STATEMENTS} FROM v_statements WHERE mean_exec_time > 0) s,
      (SELECT COUNT(*) AS bloated_tables, {AVG_BLOAT} AS avg_bloat_pct FROM v_table_stats WHERE {BLOATED}) b,
      (SELECT {CONNECTIONS} FROM v_activity) c""",
)
def snapshot_metrics(spark, sf):
    tables = view(spark, sf, "v_table_stats")
    return metrics.snapshot_metrics(tables, view(spark, sf, "v_statements"), view(spark, sf, "v_activity"), tables)


BY_DATABASE = f"""SELECT d.database_id, cache_hit_rate, avg_query_time, p95_query_time, total_queries, total_calls,
      COALESCE(bloated_tables, 0) AS bloated_tables, COALESCE(avg_bloat_pct, 0) AS avg_bloat_pct,
      total_connections, active_connections, idle_connections, COALESCE(high_seq_scan_tables, 0) AS high_seq_scan_tables
    FROM (SELECT database_id, {HIT} AS cache_hit_rate FROM v_table_stats GROUP BY 1) d
    JOIN (SELECT database_id, {STATEMENTS} FROM v_statements WHERE mean_exec_time > 0 GROUP BY 1) s USING (database_id)
    JOIN (SELECT database_id, {CONNECTIONS} FROM v_activity GROUP BY 1) c USING (database_id)
    LEFT JOIN (SELECT database_id, COUNT(*) AS bloated_tables, {AVG_BLOAT} AS avg_bloat_pct FROM v_table_stats
      WHERE {BLOATED} GROUP BY 1) b USING (database_id)
    LEFT JOIN (SELECT database_id, {SEQ} FROM v_table_stats WHERE {PUBLIC} GROUP BY 1) q USING (database_id)"""


@register("snapshot_metrics_by_database", BY_DATABASE)
def snapshot_metrics_by_database(spark, sf):
    tables = view(spark, sf, "v_table_stats")
    return metrics.snapshot_metrics(tables, view(spark, sf, "v_statements"), view(spark, sf, "v_activity"), tables, DB)


@register("list_extensions", "SELECT DISTINCT extname FROM v_extensions ORDER BY extname")
def extensions(spark, sf):
    return list_extensions(view(spark, sf, "v_extensions"))


@register(
    "database_size",
    f"SELECT database_id, size_bytes, {pretty('size_bytes')} AS database_size FROM"
    " (SELECT database_id, CAST(SUM(total_bytes) AS BIGINT) AS size_bytes FROM v_table_stats GROUP BY 1) t",
)
def database_size(spark, sf):
    return metrics.database_size(view(spark, sf, "v_table_stats"), DB)


def _metadata(spark, sf):
    return metrics.collect_metadata(
        view(spark, sf, "v_table_stats"), view(spark, sf, "v_index_stats"), view(spark, sf, "v_extensions"),
        "PostgreSQL 16.1", DB,
    )


METADATA = f"""SELECT d.database_id, 'PostgreSQL 16.1' AS version, size_bytes, {pretty('size_bytes')} AS database_size,
      COALESCE(table_count, 0) AS table_count, COALESCE(index_count, 0) AS index_count, COALESCE(names, '') AS extensions
    FROM (SELECT database_id FROM v_table_stats UNION SELECT database_id FROM v_index_stats
      UNION SELECT database_id FROM v_extensions) d
    LEFT JOIN (SELECT database_id, CAST(SUM(total_bytes) AS BIGINT) AS size_bytes, COUNT(*) AS table_count
      FROM v_table_stats GROUP BY 1) t USING (database_id)
    LEFT JOIN (SELECT database_id, COUNT(*) AS index_count FROM v_index_stats GROUP BY 1) i USING (database_id)
    LEFT JOIN (SELECT database_id, string_agg(DISTINCT extname, ',' ORDER BY extname) AS names
      FROM v_extensions GROUP BY 1) x USING (database_id)"""


@register("collect_metadata", METADATA)
def collect_metadata(spark, sf):
    return _metadata(spark, sf).withColumn("extensions", F.array_join("extensions", ","))


METRICS = (
    "cache_hit_rate", "avg_query_time", "p95_query_time", "total_queries", "total_calls", "bloated_tables", "avg_bloat_pct",
    "total_connections", "active_connections", "idle_connections", "high_seq_scan_tables",
)


@register(
    "collect_snapshot",
    f"""SELECT database_id, names AS parameters, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in METRICS)},
      version, size_bytes, database_size, table_count, index_count, extensions
    FROM ({BY_DATABASE}) m FULL JOIN (SELECT database_id,
      string_agg(concat(name, '=', setting, COALESCE(unit, '')), ',' ORDER BY name) AS names
      FROM v_settings WHERE name <> 'autovacuum_naptime' GROUP BY 1) n USING (database_id)
    FULL JOIN ({METADATA}) x USING (database_id)""",
)
def collect_snapshot(spark, sf):
    """The whole document of every database, each value in a column."""
    tables = view(spark, sf, "v_table_stats")
    measured = metrics.snapshot_metrics(
        tables, view(spark, sf, "v_statements"), view(spark, sf, "v_activity"), tables, DB
    )
    snap = metrics.collect_snapshot(
        measured, metrics.settings_to_map(view(spark, sf, "v_settings"), DB), _metadata(spark, sf), DB
    )
    pairs = F.transform(F.map_entries("parameters"), lambda e: F.concat(e.key, F.lit("="), e.value))
    return snap.select(
        "database_id",
        F.array_join(pairs, ",").alias("parameters"),
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in METRICS],
        *[F.col(f"metadata.{c}") for c in ("version", "size_bytes", "database_size", "table_count", "index_count")],
        F.array_join("metadata.extensions", ",").alias("extensions"),
    )
