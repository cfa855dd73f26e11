"""Telemetry views over the given tables.

Each view is one SQL text that runs unchanged on Spark and on the checking
engine, so both sides start from the same telemetry.  Views aggregate with
map-side combining or are plain projections; none gathers a key's rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.plans.store import PlanStore, keyed
from fleetpulse.plans.tree import ALL_FIELDS
from fleetpulse.session import shared_folder
from fleetpulse.sources import telemetry

TABLES = ("orders", "lineitem", "part", "events", "nation", "customer", "supplier", "documents")

VIEWS = {
    "v_table_stats": """
SELECT concat('db_', CAST(l_suppkey % 5 AS STRING)) AS database_id,
  CASE WHEN l_suppkey % 10 = 0 THEN 'archive' ELSE 'public' END AS schemaname,
  concat('rel_', CAST(l_suppkey AS STRING)) AS relname, l_suppkey AS relid,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS seq_scan,
  CAST(CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 0
       ELSE SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) END AS BIGINT) AS idx_scan,
  CAST(SUM(l_linenumber) AS BIGINT) AS seq_tup_read,
  CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_tup_ins,
  CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_tup_upd,
  CAST(SUM(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_tup_del,
  CAST(COUNT(*) AS BIGINT) AS n_live_tup,
  CAST(SUM(CASE WHEN l_suppkey % 4 = 0 AND l_linenumber <= 1 + l_suppkey % 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_dead_tup,
  CAST(SUM(l_linenumber) * 65536 AS BIGINT) AS total_bytes,
  CAST(SUM(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END) AS BIGINT) AS heap_blks_hit,
  CAST(SUM(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS heap_blks_read,
  MAX(l_shipdate) AS last_vacuum, MIN(l_shipdate) AS last_autovacuum,
  MAX(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS last_analyze,
  MAX(CASE WHEN l_suppkey % 2 = 0 THEN l_shipdate END) AS last_autoanalyze
FROM lineitem GROUP BY l_suppkey""",
    "v_index_stats": """
SELECT concat('db_', CAST(l_partkey % 5 AS STRING)) AS database_id,
  CASE WHEN l_partkey % 10 = 0 THEN 'archive' ELSE 'public' END AS schemaname,
  concat('rel_', CAST(l_partkey % 100 AS STRING)) AS relname,
  concat('idx_', CAST(l_partkey AS STRING)) AS indexrelname, CAST(FLOOR(l_partkey / 5) AS BIGINT) AS indexrelid,
  CAST(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE COUNT(*) END AS BIGINT) AS idx_scan,
  CAST(SUM(l_linenumber) AS BIGINT) AS idx_tup_read,
  CAST(SUM(l_linenumber) * 8192 AS BIGINT) AS index_bytes
FROM lineitem GROUP BY l_partkey""",
    # Object ids repeat across databases, and one database has constraints without an index.
    "v_constraints": """
SELECT concat('db_', CAST(p_partkey % 5 AS STRING)) AS database_id,
  CASE WHEN p_partkey % 5 = 3 AND p_partkey % 3 = 0 THEN NULL ELSE CAST(FLOOR(p_partkey / 5) AS BIGINT) END AS conindid
FROM part WHERE p_size <= 10""",
    "v_statements": """
SELECT concat('db_', CAST(user_id % 5 AS STRING)) AS database_id,
  concat('SELECT * FROM ', event_type, ' WHERE user_id = ', CAST(user_id AS STRING)) AS query,
  CAST(COUNT(*) AS BIGINT) AS calls,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_exec_time,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) / 100 / COUNT(*) AS mean_exec_time,
  CAST(SUM(event_id % 50) AS BIGINT) AS rows
FROM events GROUP BY event_type, user_id""",
    "v_activity": """
SELECT concat('db_', CAST(o_custkey % 5 AS STRING)) AS database_id, o_orderkey AS pid,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'idle' ELSE 'idle in transaction' END AS state
FROM orders""",
    # Telemetry as the collector leaves it: several captures, of which the last lacks dropped objects.
    "v_table_history": """
SELECT *, CASE WHEN database_id = 'db_1' THEN TIMESTAMP '2024-01-30 22:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS captured_at
FROM v_table_stats WHERE relid % 17 <> 5
UNION ALL SELECT *, TIMESTAMP '2024-01-30 12:00:00' AS captured_at FROM v_table_stats
UNION ALL SELECT *, TIMESTAMP '2024-01-29 12:00:00' AS captured_at FROM v_table_stats WHERE relid % 3 <> 0""",
    "v_index_history": """
SELECT *, CASE WHEN database_id = 'db_1' THEN TIMESTAMP '2024-01-30 22:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS captured_at
FROM v_index_stats WHERE indexrelid % 17 <> 5
UNION ALL SELECT *, TIMESTAMP '2024-01-30 12:00:00' AS captured_at FROM v_index_stats
UNION ALL SELECT *, TIMESTAMP '2024-01-29 12:00:00' AS captured_at FROM v_index_stats WHERE indexrelid % 3 <> 0""",
    "v_statement_history": """
SELECT *, CASE WHEN database_id = 'db_1' THEN TIMESTAMP '2024-01-30 22:00:00' ELSE TIMESTAMP '2024-01-31 00:00:00' END AS captured_at
FROM v_statements WHERE calls % 7 <> 5
UNION ALL SELECT *, TIMESTAMP '2024-01-30 12:00:00' AS captured_at FROM v_statements""",
    # What the last captures hold.
    "v_tables_now": "SELECT * FROM v_table_stats WHERE relid % 17 <> 5",
    "v_indexes_now": "SELECT * FROM v_index_stats WHERE indexrelid % 17 <> 5",
    "v_statements_now": "SELECT * FROM v_statements WHERE calls % 7 <> 5",
    # One row per database and setting name; the value follows the database's activity.
    "v_settings": """
SELECT concat('db_', CAST(CAST(FLOOR(user_id / 10) AS BIGINT) AS STRING)) AS database_id,
  CASE event_type WHEN 'view' THEN 'shared_buffers' WHEN 'click' THEN 'work_mem'
    WHEN 'purchase' THEN 'max_connections' WHEN 'error' THEN 'checkpoint_completion_target'
    ELSE 'autovacuum_naptime' END AS name,
  CAST(CASE event_type WHEN 'error' THEN 0 ELSE COUNT(*) END AS STRING) AS setting,
  CASE event_type WHEN 'view' THEN '8kB' WHEN 'click' THEN 'kB' WHEN 'signup' THEN 's' END AS unit,
  concat('Sets ', event_type) AS short_desc
FROM events GROUP BY CAST(FLOOR(user_id / 10) AS BIGINT), event_type""",
    "v_extensions": """
SELECT DISTINCT concat('db_', CAST(CAST(FLOOR(user_id / 10) AS BIGINT) AS STRING)) AS database_id,
  concat('ext_', event_type) AS extname FROM events WHERE event_id % 3 = 0""",
    # One snapshot per database and day, wide; a NULL setting is absent from the snapshot.
    "v_snapshot_days": """
SELECT CAST(FLOOR(user_id / 10) AS BIGINT) AS b, CAST(date_trunc('day', ts) AS DATE) AS snap_date,
  CAST(EXTRACT(DAY FROM MIN(ts)) AS BIGINT) AS d,
  MIN(event_id) AS snapshot_id, MAX(ts) AS executed_at,
  CAST(COUNT(DISTINCT user_id) AS BIGINT) AS total_connections,
  CAST(COUNT(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS BIGINT) AS active_connections,
  CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS misses,
  CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
  CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(COUNT(*) AS BIGINT) AS n_events,
  CAST(MAX(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS top_cents
FROM events GROUP BY CAST(FLOOR(user_id / 10) AS BIGINT), CAST(date_trunc('day', ts) AS DATE)""",
    "v_snapshots": """
SELECT snapshot_id, concat('db_', CAST(b AS STRING)) AS database_id, snap_date, executed_at,
  CAST(hits + misses AS BIGINT) AS execution_time_ms,
  CASE WHEN hits + misses > 0 THEN CAST(CAST(ROUND(hits * 10000.0 / (hits + misses)) AS BIGINT) AS DOUBLE) / 100 END AS cache_hit_rate,
  CAST(CAST(ROUND(CAST(cents AS DOUBLE) / n_events) AS BIGINT) AS DOUBLE) / 100 AS avg_query_time,
  CASE WHEN d % 5 <> 0 THEN CAST(top_cents AS DOUBLE) / 100 END AS p95_query_time,
  CAST(purchases AS DOUBLE) AS bloated_tables, CAST(total_connections AS DOUBLE) AS total_connections,
  CAST(active_connections AS DOUBLE) AS active_connections, CAST(clicks AS DOUBLE) AS high_seq_scan_tables,
  CASE WHEN d % 13 = 0 THEN '' ELSE concat(CAST(4 * (1 + CAST(FLOOR((d + b) / 10) AS BIGINT)) AS STRING), 'MB') END AS p_work_mem,
  concat(CAST(128 * (1 + CAST(FLOOR((d + 2 * b) / 12) AS BIGINT)) AS STRING), 'MB') AS p_shared_buffers,
  CAST(100 + 50 * CAST(FLOOR(d / 15) AS BIGINT) - 75 * CAST(FLOOR(d / 25) AS BIGINT) AS STRING) AS p_max_connections,
  CASE WHEN (d + b) % 7 = 0 THEN 'off' ELSE 'on' END AS p_autovacuum,
  CASE WHEN d % 6 < 3 THEN '4GB' ELSE '4096MB' END AS p_effective_cache_size,
  CASE WHEN d >= 20 THEN '1.1' ELSE '4.0' END AS p_random_page_cost,
  CASE WHEN d < 8 THEN NULL WHEN d % 9 = 0 THEN '-1' ELSE '16MB' END AS p_wal_buffers,
  CASE WHEN d > 22 THEN NULL ELSE '64MB' END AS p_maintenance_work_mem,
  CASE WHEN d >= 15 THEN 'PostgreSQL 16.1' ELSE 'PostgreSQL 15.4' END AS version,
  CAST(cents * 1024 AS BIGINT) AS size_bytes,
  CAST(n_events AS BIGINT) AS table_count, CAST(clicks AS BIGINT) AS index_count,
  CASE WHEN d % 2 = 0 THEN 'amcheck' END AS x_amcheck, CASE WHEN d > 10 THEN 'hstore' END AS x_hstore,
  CASE WHEN b % 3 <> 0 OR d < 12 THEN 'pg_trgm' END AS x_pg_trgm
FROM v_snapshot_days""",
    "v_check_results": """
SELECT event_id AS id, concat('db_', CAST(user_id % 5 AS STRING)) AS database_id,
  CASE WHEN user_id % 5 = 4 AND event_id % 7 = 6 THEN 'unused_indexes'
    ELSE CASE event_id % 7 WHEN 0 THEN 'unused_indexes' WHEN 1 THEN 'missing_indexes' WHEN 2 THEN 'sequential_scans'
      WHEN 3 THEN 'slow_queries' WHEN 4 THEN 'table_bloat' WHEN 5 THEN 'parameter_settings'
      ELSE 'database_snapshot' END END AS check_type,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'success' END AS status,
  props AS result_data, CASE WHEN event_type = 'error' THEN concat('failed with ', props) END AS error_message,
  ts AS executed_at, CAST(FLOOR(value) AS INT) AS execution_time_ms
FROM events""",
    "v_saved_queries": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS name,
  CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat('SELECT * FROM ', lower(p_type)) END AS sql,
  repeat('x', CAST(p_partkey % 600 AS INT)) AS description,
  CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'business' ELSE 'saved' END AS category,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST((p_partkey * 37) % 1000003 AS INT) AS updated_at
FROM part""",
    # One execution per order; q, w and m are the numbers its plan is built from.
    "v_executions": """
SELECT o_orderkey AS exec_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS query_id,
  concat('db_', CAST(CAST(FLOOR(o_custkey / 100) AS BIGINT) AS STRING)) AS database_id,
  concat('  SELECT *  FROM rel_', CAST(o_custkey AS STRING), '   WHERE status = 1 ') AS sql_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'execute' WHEN 1 THEN 'both' ELSE 'analyze' END AS execution_type,
  CASE WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_orderkey % 3 = 0 THEN 'failed'
    WHEN o_orderkey % 3 = 1 THEN 'running' ELSE 'pending' END AS status,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'canceling statement' END AS error_message,
  o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS INT) AS created_at,
  o_orderkey AS q, o_custkey AS w, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS m,
  CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey % 50 AS BIGINT) END AS result_rows_count,
  CASE WHEN o_orderkey % 4 < 2 THEN CAST(1 + o_orderkey % 6 AS BIGINT) END AS result_columns_count,
  CAST((o_orderkey * 7) % 20000 AS DOUBLE) / 1000 AS planning_part,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN CAST(ROUND(o_totalprice * 100) AS BIGINT) % 12000000
    WHEN 1 THEN CAST(FLOOR(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 12000000 / 10) AS BIGINT)
    ELSE CAST(FLOOR(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 12000000 / 100) AS BIGINT) END AS DOUBLE) / 1000 AS execution_part,
  CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 8 = 1 THEN 4 ELSE 1 END AS DOUBLE) / 100 AS cost_part,
  CASE WHEN o_orderkey % 4 = 0 THEN 'absent' WHEN o_orderkey % 97 = 0 THEN 'malformed'
    WHEN o_orderkey % 101 = 0 THEN 'empty' ELSE 'plan' END AS plan_state
FROM orders""",
}

# The nodes of each plan in pre-order, straight from the execution numbers.
# Only the checking side reads this; Spark flattens the JSON built by ``executions``.
NODES = """
nodes AS (
  SELECT exec_id, 0 AS ord, 0 AS level, CASE WHEN q % 5 = 0 THEN 'Seq Scan' ELSE CASE q % 4 WHEN 1 THEN 'Limit' WHEN 2 THEN 'Aggregate' WHEN 3 THEN CASE WHEN q % 3 = 0 THEN 'Sort' ELSE 'Gather' END END END AS node_type,
    CASE WHEN q % 5 = 0 THEN concat('rel_', CAST(w AS STRING)) END AS relation_name,
    cost_part AS total_cost, execution_part AS actual_time,
    CASE WHEN q % 5 = 0 THEN m % 3000 ELSE 1 + w % 100 END AS actual_rows,
    CAST(NULL AS STRING) AS join_type, CAST(NULL AS STRING) AS index_name,
    CASE WHEN q % 5 <> 0 AND q % 4 = 3 AND q % 3 = 0 THEN CASE WHEN w % 3 = 0 THEN 'external merge' ELSE 'quicksort' END END AS sort_method,
    CAST(NULL AS BIGINT) AS temp_written, CAST(NULL AS BIGINT) AS peak_memory,
    CASE WHEN q % 5 <> 0 AND q % 4 = 3 AND q % 3 <> 0 THEN 2 + w % 3 END AS workers_planned,
    CASE WHEN q % 5 <> 0 AND q % 4 = 3 AND q % 3 <> 0 THEN LEAST(w % 4, 2 + w % 3) END AS workers_launched
  FROM v_executions WHERE plan_state = 'plan'
  UNION ALL
  SELECT exec_id, 1, 1, CASE w % 3 WHEN 0 THEN 'Hash Join' WHEN 1 THEN 'Nested Loop' ELSE 'Merge Join' END, NULL,
    cost_part / 2, CAST(q % 1000 AS DOUBLE) / 10, 10 + w % 1000,
    CASE w % 3 WHEN 0 THEN 'Inner' WHEN 1 THEN 'Left' END, NULL, NULL,
    CASE WHEN w % 3 = 0 THEN CASE q % 7 WHEN 0 THEN 8 WHEN 1 THEN 0 END END,
    CASE WHEN w % 3 = 0 THEN m % 250000 END, NULL, NULL
  FROM v_executions WHERE plan_state = 'plan' AND q % 5 <> 0
  UNION ALL
  SELECT exec_id, 2, 2, 'Materialize', NULL, NULL, NULL, m % 3000 * 100, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM v_executions WHERE plan_state = 'plan' AND q % 5 <> 0 AND q % 11 = 0
  UNION ALL
  SELECT exec_id, 3 + i, CASE WHEN i = 0 AND q % 11 = 0 THEN 3 ELSE 2 END,
    CASE (q + w + i) % 3 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'Index Scan' ELSE 'Index Only Scan' END,
    concat('rel_', CAST((w + i) % 50 AS STRING)), NULL, NULL,
    CAST(FLOOR(m / (i + 1)) AS BIGINT) % 3000 * CASE WHEN q % 11 = 0 THEN 100 ELSE 1 END, NULL,
    CASE WHEN (q + w + i) % 3 <> 0 THEN concat('idx_', CAST((w + i) % 50 AS STRING)) END, NULL, NULL, NULL, NULL, NULL
  FROM v_executions, (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) n
  WHERE plan_state = 'plan' AND q % 5 <> 0 AND i <= q % 3
)"""


def _names(text: str) -> list[str]:
    known = set(VIEWS) | set(TABLES)
    return [w for w in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)) if w in known]


def with_views(sql: str, *extra: str) -> str:
    """Prefix a checking query with the views it names, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    for text in (*extra, sql):
        visit(text)
    parts = [f"{name} AS ({VIEWS[name]})" for name in ordered] + [e.strip() for e in extra]
    return ("WITH " + ",\n".join(parts) + "\n" + sql.strip()) if parts else sql.strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry view as a DataFrame; its inputs are bound by name, not as temp views."""
    text = VIEWS[name]
    inputs = {
        n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in _names(text)
    }
    bound = reduce(lambda t, n: re.sub(rf"\b{n}\b", "{" + n + "}", t), inputs, text)
    return spark.sql(bound, **inputs)


_stores: dict[tuple[str, ...], str] = {}


def captures(spark: SparkSession, sf_dir: str, name: str, relation: str) -> str:
    """Path of the store that holds a history's captures: written by its first reader in a session, as a
    collector would before any report runs, and anew where it is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name, relation)
    path = _stores.get(key)
    if path is None or not telemetry.has_captures(spark, path):
        path = _stores[key] = shared_folder(spark, f"captures-{relation}")
        rows = view(spark, sf_dir, name)
        known = [c.split()[0] for c in telemetry.SCHEMAS[relation].split(",")]
        telemetry.append_captures(rows.select(*[c for c in known if c in rows.columns]), path)
    return path


def newest(spark: SparkSession, sf_dir: str, name: str, relation: str) -> DataFrame:
    """The newest capture of each database."""
    return telemetry.scan_newest(spark, relation, captures(spark, sf_dir, name, relation))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot documents: parameters and metrics as maps, metadata as a struct."""
    wide = view(spark, sf_dir, "v_snapshots")
    settings = [c for c in wide.columns if c.startswith("p_")]
    metrics = [
        "cache_hit_rate", "avg_query_time", "p95_query_time", "bloated_tables",
        "total_connections", "active_connections", "high_seq_scan_tables",
    ]

    def present(names: list[str], cut: int) -> object:
        pairs = F.array(*[F.struct(F.lit(n[cut:]).alias("k"), F.col(n).alias("v")) for n in names])
        return F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull()))

    return wide.select(
        F.col("snapshot_id").alias("id"),
        "database_id",
        "executed_at",
        "execution_time_ms",
        present(settings, 2).alias("parameters"),
        present(metrics, 0).alias("metrics"),
        F.struct(
            "version",
            "size_bytes",
            "table_count",
            "index_count",
            F.array_compact(F.array("x_amcheck", "x_hstore", "x_pg_trgm")).alias("extensions"),
        ).alias("metadata"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution log rows whose ``execution_plan`` is EXPLAIN-style JSON text."""
    # The table is a file of one row group, which one task would turn into plans; its rows are
    # dealt out while they are still a few numbers each.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ex = view(spark, sf_dir, "v_executions").repartition(parts)

    quoted = ("Relation_Name", "Index_Name", "Join_Type", "Sort_Method")

    def node(children: str | None, Node_Type: str, **fields: str) -> str:
        """SQL text of a JSON object; a NULL field is left out."""
        parts = ["'{\"Node Type\":\"'", Node_Type, "'\"'"]
        for name, value in fields.items():
            key = name.replace("_", " ")
            mark = '"' if name in quoted else ""
            parts.append(f"coalesce(concat(',\"{key}\":{mark}', {value}, '{mark}'), '')")
        if children is not None:
            parts += ["',\"Plans\":['", children, "']'"]
        return f"concat({', '.join(parts)}, '}}')"

    scan = node(
        None,
        Node_Type="CASE (q + w + i) % 3 WHEN 0 THEN 'Seq Scan' WHEN 1 THEN 'Index Scan' ELSE 'Index Only Scan' END",
        Relation_Name="concat('rel_', (w + i) % 50)",
        Actual_Rows="(m div (i + 1)) % 3000 * CASE WHEN q % 11 = 0 THEN 100 ELSE 1 END",
        Index_Name="CASE WHEN (q + w + i) % 3 <> 0 THEN concat('idx_', (w + i) % 50) END",
    )
    wrapped = node("x.s", Node_Type="'Materialize'", Actual_Rows="m % 3000 * 100")
    scans = (
        f"array_join(transform(transform(sequence(0L, q % 3), i -> struct(i, {scan} AS s)),"
        f" x -> CASE WHEN x.i = 0 AND q % 11 = 0 THEN {wrapped} ELSE x.s END), ',')"
    )
    join = node(
        scans,
        Node_Type="CASE w % 3 WHEN 0 THEN 'Hash Join' WHEN 1 THEN 'Nested Loop' ELSE 'Merge Join' END",
        Total_Cost="cost_part / 2",
        Actual_Total_Time="CAST(q % 1000 AS DOUBLE) / 10",
        Actual_Rows="10 + w % 1000",
        Join_Type="CASE w % 3 WHEN 0 THEN 'Inner' WHEN 1 THEN 'Left' END",
        Temp_Written_Blocks="CASE WHEN w % 3 = 0 THEN CASE q % 7 WHEN 0 THEN 8 WHEN 1 THEN 0 END END",
        Peak_Memory_Usage="CASE WHEN w % 3 = 0 THEN m % 250000 END",
    )
    buffers = dict(
        Shared_Hit_Blocks="q % 100",
        Shared_Read_Blocks="w % 10",
        Shared_Dirtied_Blocks="q % 3",
        Temp_Read_Blocks="CASE WHEN q % 4 = 1 THEN w % 7 END",
    )
    top = dict(Total_Cost="cost_part", Actual_Total_Time="execution_part", **buffers)
    leaf = node(
        None, Node_Type="'Seq Scan'", Relation_Name="concat('rel_', w)", Actual_Rows="m % 3000", **top
    )
    is_sort, is_gather = "q % 4 = 3 AND q % 3 = 0", "q % 4 = 3 AND q % 3 <> 0"
    root = node(
        "join_json",
        Node_Type=f"CASE WHEN {is_sort} THEN 'Sort' WHEN {is_gather} THEN 'Gather' WHEN q % 4 = 1 THEN 'Limit' ELSE 'Aggregate' END",
        Actual_Rows="1 + w % 100",
        Sort_Method=f"CASE WHEN {is_sort} THEN CASE WHEN w % 3 = 0 THEN 'external merge' ELSE 'quicksort' END END",
        Workers_Planned=f"CASE WHEN {is_gather} THEN 2 + w % 3 END",
        Workers_Launched=f"CASE WHEN {is_gather} THEN LEAST(w % 4, 2 + w % 3) END",
        **top,
    )
    document = (
        "concat('{\"Plan\":', plan_json, ',\"Planning Time\":', planning_part, ',\"Execution Time\":', execution_part, '}')"
    )
    shaped = (
        ex.withColumn("join_json", F.expr(join))
        .withColumn("plan_json", F.expr(f"CASE WHEN q % 5 = 0 THEN {leaf} ELSE {root} END"))
        .withColumn("doc", F.expr(document))
    )
    text = F.expr(
        """CASE plan_state WHEN 'absent' THEN NULL WHEN 'malformed' THEN substring(doc, 1, 20) WHEN 'empty' THEN '[]'
           ELSE CASE WHEN q % 6 = 1 THEN doc ELSE concat('[', doc, ']') END END"""
    )
    return shaped.select(
        "exec_id",
        "query_id",
        "database_id",
        "sql_text",
        "execution_type",
        "status",
        "error_message",
        "created_at",
        "result_rows_count",
        "result_columns_count",
        F.when(F.col("plan_state") == "absent", F.col("execution_part")).alias("measured_ms"),
        text.alias("execution_plan"),
    )


def parsed_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PlanStore]:
    """The execution log without plan texts, and the store of its parsed plans: both written by the first
    reader in a session, as an import would, and anew where they are gone."""
    key = (spark.sparkContext.applicationId, sf_dir, "executions", "plans")
    path = _stores.get(key)
    if path is None or not PlanStore(spark, path).table.manifest().folders:
        path = _stores[key] = shared_folder(spark, "plans")
        log = executions(spark, sf_dir)
        log.write.parquet(f"{path}/log")
        PlanStore(spark, path).add(spark.read.schema(log.schema).parquet(f"{path}/log"))
    return keyed(spark.read.parquet(f"{path}/log")), PlanStore(spark, path)


def with_parsed_nodes(spark: SparkSession, sf_dir: str, fields: Sequence[str] = ALL_FIELDS) -> DataFrame:
    log, store = parsed_log(spark, sf_dir)
    return store.with_nodes(log, fields)
