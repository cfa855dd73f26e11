"""Streaming jobs over the event files, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.session import shared_folder
from fleetpulse.streaming import changes, sinks, snapshots, windows
from registry.base import register, sec, seconds
from registry.fixtures import VIEWS, table

DB = "concat('db_', CAST(CAST(FLOOR(user_id / 10) AS BIGINT) AS STRING))"
READINGS = f"""readings AS (SELECT {DB} AS database_id, CASE event_type WHEN 'view' THEN 'work_mem' WHEN 'click' THEN 'shared_buffers'
  WHEN 'purchase' THEN 'max_connections' ELSE 'autovacuum' END AS parameter, ts AS executed_at, event_id AS id,
  CASE event_type WHEN 'view' THEN concat(CAST(4 * (1 + CAST(FLOOR(value / 50) AS BIGINT)) AS STRING), 'MB')
    WHEN 'click' THEN concat(CAST(1 + CAST(FLOOR(value / 80) AS BIGINT) AS STRING), 'GB')
    WHEN 'purchase' THEN CAST(100 + 50 * CAST(FLOOR(value / 60) AS BIGINT) AS STRING)
    ELSE CASE WHEN value > 40 THEN 'on' WHEN value < 5 THEN '' ELSE 'off' END END AS setting FROM events)"""


FILES = 5


def events(spark, sf):
    """The events as a stream of files in no order of time, a batch each."""
    folder = shared_folder(spark, "stream-input")
    mixed = table(spark, sf, "events").repartition(FILES, F.hash("event_id"))
    mixed.write.option("maxRecordsPerFile", 0).parquet(folder)
    return sinks.file_stream(spark, folder, files_per_batch=1)


def over_stream(spark, sf, select: str):
    """A SELECT over ``events`` with the event stream in its place."""
    return spark.sql(select.replace("FROM events", "FROM {events}"), events=events(spark, sf))


def readings(spark, sf):
    return over_stream(spark, sf, READINGS[READINGS.index("(") + 1 : -1])


@register(
    "stream_snapshot_windows",
    f"""SELECT {DB} AS database_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period_start,
      strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS period_end, COUNT(*) AS events,
      COUNT(*) FILTER (WHERE event_type = 'view') AS hits, COUNT(*) FILTER (WHERE event_type = 'error') AS misses,
      CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""",
)
def stream_snapshot_windows(spark, sf):
    """Files come in no order of time, so most rows are later than the watermark of an hour."""
    source = events(spark, sf).withColumn("database_id", F.expr(DB))
    aggregates = {
        "events": F.count("*"),
        "hits": F.count_if(F.col("event_type") == "view"),
        "misses": F.count_if(F.col("event_type") == "error"),
        "cents": F.sum(F.round(F.col("value") * 100).cast("bigint")),
    }
    out = shared_folder(spark, "stream-windows")
    windows.stream_window_metrics(source, out, f"{out}/checkpoint", aggregates).awaitTermination()
    rows = windows.read_windows(spark, out, dict.fromkeys(aggregates, "sum"))
    return rows.select("database_id", *seconds("period_start", "period_end"), *aggregates)


@register(
    "stream_latest_per_check",
    f"""SELECT database_id, check_type, id, {sec('executed_at')} AS executed_at, execution_time_ms FROM v_check_results
    WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY database_id, check_type ORDER BY executed_at DESC, id DESC) = 1""",
)
def stream_latest_per_check(spark, sf):
    latest = snapshots.stream_latest_per_check(over_stream(spark, sf, VIEWS["v_check_results"]))
    out = sinks.run_upserts(latest, ["database_id", "check_type"], "stream-latest")
    return out.select("database_id", "check_type", "id", *seconds("executed_at"), "execution_time_ms")


@register(
    "stream_parameter_changes",
    f"""SELECT database_id, parameter, {sec('executed_at')} AS detected_at, id, old AS "from", setting AS "to" FROM (
      SELECT *, lag(setting) OVER w AS old, lag(id) OVER w AS old_id FROM readings
      WINDOW w AS (PARTITION BY database_id, parameter ORDER BY executed_at, id)) r
    WHERE old_id IS NOT NULL AND old <> setting""",
    extra=(READINGS,),
)
def stream_parameter_changes(spark, sf):
    out = shared_folder(spark, "stream-changes")
    changes.stream_parameter_changes(readings(spark, sf), out, f"{out}/checkpoint").awaitTermination()
    return changes.read_changes(spark, out).select(
        "database_id", "parameter", *seconds("detected_at"), "id", "from", "to"
    )


@register(
    "stream_retention",
    f"""SELECT database_id, parameter, id, {sec('executed_at')} AS executed_at, setting FROM (SELECT *,
      row_number() OVER (PARTITION BY database_id, parameter ORDER BY executed_at DESC, id DESC) AS n FROM readings) r
    WHERE n = 1 AND executed_at >= (SELECT MAX(executed_at) FROM readings) - INTERVAL 6 HOUR""",
    extra=(READINGS,),
)
def stream_retention(spark, sf):
    """Last values that survive when a parameter unread for six hours is forgotten."""
    out = shared_folder(spark, "stream-retention")
    query = changes.stream_parameter_changes(readings(spark, sf), out, f"{out}/checkpoint", retention="6 hours", lateness="6 hours")
    query.awaitTermination()
    rows = changes.read_state(spark, out, retention="6 hours")
    return rows.select("database_id", "parameter", "id", *seconds("executed_at"), "setting")
