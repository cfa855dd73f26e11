"""Snapshot history: changes, comparisons, timeline and exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from fleetpulse.constants import COMPARED_METRICS
from fleetpulse.operators import snapshots as snap
from fleetpulse.session import shared_folder
from fleetpulse.sources import exports
from registry.base import AS_OF, AS_OF_SQL, joined, pretty, register, rnd, sec, seconds, size_bytes
from registry.fixtures import snapshots

D1, D2 = date(2024, 1, 6), date(2024, 1, 27)
SETTINGS = (
    "work_mem", "shared_buffers", "max_connections", "autovacuum", "effective_cache_size", "random_page_cost",
    "wal_buffers", "maintenance_work_mem",
)
NUMERIC = "('shared_buffers','work_mem','effective_cache_size','max_connections','maintenance_work_mem','wal_buffers')"


def _long(source: str, columns: str, names, prefix: str = "") -> str:
    """UNION ALL of one SELECT per name."""
    return " UNION ALL ".join(
        f"SELECT {columns}, '{n}' AS name, {prefix}{n} AS value FROM {source}" for n in names
    )


CHANGE_TYPE = f"""CASE WHEN old IS NULL OR new IS NULL THEN 'change'
  WHEN name IN {NUMERIC} THEN CASE WHEN {size_bytes('old')} IS NULL OR {size_bytes('new')} IS NULL THEN 'change'
    WHEN {size_bytes('new')} > {size_bytes('old')} THEN 'increase'
    WHEN {size_bytes('new')} < {size_bytes('old')} THEN 'decrease' ELSE 'stable' END
  ELSE 'change' END"""


def _changes(days: int) -> tuple[str, str]:
    """CTEs with every parameter change of the last ``days`` days (an absent old snapshot gives none)."""
    return (
        f"""readings AS (SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY executed_at, snapshot_id) AS n
          FROM v_snapshots WHERE executed_at >= {AS_OF_SQL} - INTERVAL {days} DAY)""",
        f"""changes AS (SELECT database_id, executed_at, name, old, new, {CHANGE_TYPE} AS change_type FROM (
          {' UNION ALL '.join(f"SELECT b.database_id, b.executed_at, '{s}' AS name, a.p_{s} AS old, b.p_{s} AS new FROM readings a JOIN readings b ON a.database_id = b.database_id AND b.n = a.n + 1" for s in SETTINGS)}
          ) pairs WHERE new IS NOT NULL AND old IS DISTINCT FROM new AND NOT (COALESCE(old, '') = '' AND new = ''))""",
    )


CHANGES30, CHANGES7 = _changes(30), _changes(7)


@register(
    "parameter_changes",
    f"""SELECT database_id, {sec('executed_at')} AS detected_at, name AS parameter, old AS "from", new AS "to", change_type
    FROM changes""",
    extra=CHANGES30,
)
def parameter_changes(spark, sf):
    return snap.parameter_changes(snapshots(spark, sf), AS_OF, 30).select(
        "database_id", *seconds("detected_at"), "parameter", "from", "to", "change_type"
    )


@register(
    "change_events",
    f"""SELECT database_id, {sec('executed_at')} AS detected_at,
      string_agg(concat(name, ':', change_type), ',' ORDER BY name) AS changes FROM changes GROUP BY database_id, executed_at""",
    extra=CHANGES30,
)
def change_events(spark, sf):
    events = snap.change_events(snap.parameter_changes(snapshots(spark, sf), AS_OF, 30))
    pairs = F.transform(F.map_entries("changes"), lambda e: F.concat(e.key, F.lit(":"), e.value.change_type))
    return events.select("database_id", *seconds("detected_at"), F.array_join(pairs, ",").alias("changes"))


@register(
    "parameter_change_count",
    "SELECT database_id, COUNT(*) AS parameter_changes FROM changes GROUP BY database_id",
    extra=CHANGES7,
)
def parameter_change_count(spark, sf):
    return snap.parameter_change_count(snap.parameter_changes(snapshots(spark, sf), AS_OF, 7))


@register(
    "previous_snapshot",
    """SELECT database_id, snapshot_id AS id,
      lag(snapshot_id) OVER (PARTITION BY database_id ORDER BY executed_at, snapshot_id) AS previous_id FROM v_snapshots""",
)
def previous_snapshot(spark, sf):
    rows = snapshots(spark, sf).select("id", "database_id", "executed_at")
    return snap.previous_snapshot(rows).select("database_id", "id", F.col("previous.id").alias("previous_id"))


def _metric_rows(pairs: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT database_id, id, '{m}' AS metric, a_{m} AS x, b_{m} AS y FROM {pairs}" for m in COMPARED_METRICS
    )
    return f"""SELECT database_id, id, metric, x AS before, y AS after, {rnd('y - x', 2)} AS change,
      CASE WHEN x <> 0 THEN {rnd('(y - x) / x * 100', 2)} ELSE 0 END AS change_percent,
      CASE WHEN y > x THEN 'increase' WHEN y < x THEN 'decrease' ELSE 'stable' END AS direction
    FROM ({rows}) m WHERE x IS NOT NULL AND y IS NOT NULL"""


@register(
    "consecutive_metric_changes",
    _metric_rows("pairs"),
    extra=(
        "pairs AS (SELECT database_id, snapshot_id AS id, "
        + ", ".join(
            f"{m} AS b_{m}, lag({m}) OVER (PARTITION BY database_id ORDER BY executed_at, snapshot_id) AS a_{m}"
            for m in COMPARED_METRICS
        )
        + " FROM v_snapshots)",
    ),
)
def consecutive_metric_changes(spark, sf):
    pairs = snap.as_pairs(snap.previous_snapshot(snapshots(spark, sf)))
    return snap.compare_metrics(pairs.withColumn("id", F.col("b.id")), ["database_id", "id"])


def _day(n: str, day: date) -> str:
    return f"""{n} AS (SELECT * FROM v_snapshots WHERE snap_date = DATE '{day}' AND snapshot_id IN
      (SELECT MIN(snapshot_id) FROM v_snapshots WHERE snap_date = DATE '{day}' GROUP BY database_id))"""


DAYS = (_day("first_day", D1), _day("second_day", D2))
BOTH_DAYS = "first_day a JOIN second_day b USING (database_id)"


@register(
    "snapshot_pair_by_date",
    f"SELECT database_id, a.snapshot_id AS a_id, b.snapshot_id AS b_id FROM {BOTH_DAYS}",
    extra=DAYS,
)
def snapshot_pair_by_date(spark, sf):
    pairs = snap.snapshot_pair_by_date(snapshots(spark, sf), D1, D2)
    return pairs.select("database_id", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@register(
    "compare_params_join",
    f"""SELECT database_id, {sec('executed_at')} AS detected_at, name AS parameter, old AS "from", new AS "to",
      {CHANGE_TYPE} AS change_type FROM (
      {' UNION ALL '.join(f"SELECT database_id, b.executed_at, '{s}' AS name, a.p_{s} AS old, b.p_{s} AS new FROM {BOTH_DAYS}" for s in SETTINGS)}) p
    WHERE new IS NOT NULL AND old IS DISTINCT FROM new AND NOT (COALESCE(old, '') = '' AND new = '')""",
    extra=DAYS,
)
def compare_params_join(spark, sf):
    out = snap.compare_params(snap.snapshot_pair_by_date(snapshots(spark, sf), D1, D2))
    return out.select("database_id", *seconds("detected_at"), "parameter", "from", "to", "change_type")


@register(
    "compare_metrics_join",
    _metric_rows("day_pairs").replace("database_id, id, ", "database_id, "),
    extra=(
        *DAYS,
        "day_pairs AS (SELECT database_id, "
        + ", ".join(f"a.{m} AS a_{m}, b.{m} AS b_{m}" for m in COMPARED_METRICS)
        + f" FROM {BOTH_DAYS})",
    ),
)
def compare_metrics_join(spark, sf):
    return snap.compare_metrics(snap.snapshot_pair_by_date(snapshots(spark, sf), D1, D2))


def _except(x: str, y: str) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN {x}.{e} IS NOT NULL AND {y}.{e} IS NULL THEN {x}.{e} END" for e in ("x_amcheck", "x_hstore", "x_pg_trgm")
    ) + ")"


@register(
    "metadata_compare",
    f"""SELECT database_id, a.version <> b.version AS version_changed, a.version AS version_before, b.version AS version_after,
      {_except('b', 'a')} AS extensions_added, {_except('a', 'b')} AS extensions_removed,
      a.size_bytes AS size_bytes_before, b.size_bytes AS size_bytes_after, a.table_count AS table_count_before,
      b.table_count AS table_count_after, a.index_count AS index_count_before, b.index_count AS index_count_after
    FROM {BOTH_DAYS}""",
    extra=DAYS,
)
def metadata_compare(spark, sf):
    out = snap.compare_metadata(snap.snapshot_pair_by_date(snapshots(spark, sf), D1, D2))
    return out.withColumn("extensions_added", F.array_join("extensions_added", ",")).withColumn(
        "extensions_removed", F.array_join("extensions_removed", ",")
    )


@register(
    "timeline_series",
    f"""SELECT database_id, snapshot_id AS id, strftime(executed_at, '%Y-%m-%d %H:%M') AS date,
      COALESCE(cache_hit_rate, 0) AS cache_hit_rate, COALESCE(avg_query_time, 0) AS avg_query_time,
      CAST(COALESCE(bloated_tables, 0) AS BIGINT) AS bloated_tables,
      CAST(COALESCE(total_connections, 0) AS BIGINT) AS total_connections
    FROM v_snapshots WHERE executed_at >= {AS_OF_SQL} - INTERVAL 30 DAY""",
)
def timeline_series(spark, sf):
    return snap.timeline_series(snapshots(spark, sf), AS_OF, 30)


@register(
    "timeline_stats",
    f"""SELECT database_id, COUNT(*) AS total_snapshots, strftime(MIN(executed_at), '%Y-%m-%d') AS date_from,
      strftime(MAX(executed_at), '%Y-%m-%d') AS date_to,
      MAX(CASE WHEN n = 1 THEN cache_hit_rate END) AS latest_cache_hit_rate,
      COALESCE(MAX(c.parameter_changes), 0) AS parameter_changes
    FROM (SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY executed_at DESC, snapshot_id DESC) AS n FROM v_snapshots) s
    LEFT JOIN (SELECT database_id, COUNT(*) AS parameter_changes FROM changes GROUP BY 1) c USING (database_id)
    GROUP BY database_id""",
    extra=CHANGES30,
)
def timeline_stats(spark, sf):
    rows = snapshots(spark, sf)
    stats = snap.timeline_stats(rows, snap.parameter_changes(rows, AS_OF, 30))
    return stats.select(
        "database_id",
        "total_snapshots",
        F.date_format("first_at", "yyyy-MM-dd").alias("date_from"),
        F.date_format("last_at", "yyyy-MM-dd").alias("date_to"),
        "latest_cache_hit_rate",
        "parameter_changes",
    )


@register(
    "snapshots_between",
    f"""SELECT database_id, snapshot_id AS id, {sec('executed_at')} AS executed_at FROM v_snapshots
    WHERE snap_date BETWEEN DATE '{D1}' AND DATE '{D2}' ORDER BY executed_at, id""",
)
def snapshots_between(spark, sf):
    rows = snap.between_dates(snapshots(spark, sf), D1, D2).orderBy("executed_at", "id")
    return rows.select("database_id", "id", *seconds("executed_at"))


@register(
    "snapshots_recent",
    """SELECT database_id, id FROM (SELECT database_id, snapshot_id AS id,
      row_number() OVER (PARTITION BY database_id ORDER BY executed_at DESC, snapshot_id DESC) AS n FROM v_snapshots) t WHERE n <= 5""",
)
def snapshots_recent(spark, sf):
    return snap.newest_snapshots(snapshots(spark, sf), 5).select("database_id", "id")


@register(
    "latest_snapshot",
    f"""SELECT database_id, snapshot_id AS id, {sec('executed_at')} AS executed_at FROM v_snapshots
    QUALIFY row_number() OVER (PARTITION BY database_id ORDER BY executed_at DESC, snapshot_id DESC) = 1""",
)
def latest_snapshot(spark, sf):
    return snap.latest_snapshot(snapshots(spark, sf)).select("database_id", "id", *seconds("executed_at"))


@register(
    "snapshot_of_day",
    "SELECT database_id, strftime(snap_date, '%Y-%m-%d') AS snap_date, MIN(snapshot_id) AS id FROM v_snapshots GROUP BY 1, 2",
)
def snapshot_of_day(spark, sf):
    days = snap.snapshot_of_day(snapshots(spark, sf))
    return days.select("database_id", F.col("snap_date").cast("string").alias("snap_date"), "id")


@register(
    "snapshot_summary",
    "SELECT database_id, snapshot_id AS id, "
    + " + ".join(f"CASE WHEN p_{s} IS NULL THEN 0 ELSE 1 END" for s in SETTINGS)
    + " AS parameters_tracked, "
    + " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in COMPARED_METRICS)
    + " AS metrics_collected FROM v_snapshots",
)
def snapshot_summary(spark, sf):
    return snap.snapshot_summary(snapshots(spark, sf)).drop("executed_at")


@register(
    "snapshot_status",
    f"""SELECT database_id, COUNT(*) AS total_snapshots, {sec('MAX(executed_at)')} AS latest_at,
      string_agg(CASE WHEN n <= 5 THEN strftime(executed_at, '%Y-%m-%d %H:%M') END, ' | ' ORDER BY n) AS recent,
      COALESCE(MAX(c.events), 0) AS change_events
    FROM (SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY executed_at DESC, snapshot_id DESC) AS n FROM v_snapshots) s
    LEFT JOIN (SELECT database_id, COUNT(DISTINCT executed_at) AS events FROM changes GROUP BY 1) c USING (database_id)
    GROUP BY database_id""",
    extra=CHANGES7,
)
def snapshot_status(spark, sf):
    rows = snapshots(spark, sf)
    status = snap.snapshot_status(rows, snap.parameter_changes(rows, AS_OF, 7))
    return status.select("database_id", "total_snapshots", *seconds("latest_at"), joined("recent"), "change_events")


CATEGORY = """CASE WHEN regexp_matches(name, 'cache|hit') THEN 'Memory' WHEN regexp_matches(name, 'query|time') THEN 'Performance'
  WHEN contains(name, 'connection') THEN 'Concurrency' WHEN regexp_matches(name, 'bloat|table') THEN 'Storage' ELSE 'Database' END"""
STATUS = """CASE WHEN regexp_matches(name, 'rate|hit') THEN CASE WHEN value > 95 THEN 'excellent' WHEN value > 85 THEN 'good'
    WHEN value > 70 THEN 'ok' ELSE 'attention' END
  WHEN contains(name, 'time') THEN CASE WHEN value < 10 THEN 'excellent' WHEN value < 50 THEN 'good' WHEN value < 100 THEN 'ok'
    ELSE 'attention' END ELSE 'neutral' END"""


@register(
    "metric_board",
    f"""SELECT database_id, id, name AS metric, value, {CATEGORY} AS category, {STATUS} AS status
    FROM ({_long('v_snapshots', 'database_id, snapshot_id AS id', COMPARED_METRICS)}) m WHERE value IS NOT NULL""",
)
def metric_board(spark, sf):
    return snap.metric_board(snapshots(spark, sf))


@register(
    "export_timeline_csv",
    f"""SELECT database_id, strftime(executed_at, '%Y-%m-%d') AS "Date", strftime(executed_at, '%H:%M:%S') AS "Time",
      cache_hit_rate AS "Cache Hit Rate %", avg_query_time AS "Avg Query Time (ms)", p95_query_time AS "P95 Query Time (ms)",
      CAST(bloated_tables AS BIGINT) AS "Bloated Tables", CAST(total_connections AS BIGINT) AS "Total Connections",
      CAST(active_connections AS BIGINT) AS "Active Connections", CAST(high_seq_scan_tables AS BIGINT) AS "High Seq Scan Tables",
      {pretty('size_bytes')} AS "Database Size", 'PostgreSQL' AS "Version"
    FROM v_snapshots""",
)
def export_timeline_csv(spark, sf):
    """Write the CSV export and give back what its reader sees."""
    rows = snapshots(spark, sf)
    path = shared_folder(spark, "timeline-csv")
    exports.export_timeline_csv(rows, path)
    return spark.read.schema(snap.timeline_rows(rows).schema).option("header", True).csv(path)


ISO_SQL = "'%Y-%m-%dT%H:%M:%SZ'"


@register(
    "export_timeline_json",
    f"""SELECT database_id, 'snapshot' AS part, concat_ws('|', snapshot_id, strftime(executed_at, {ISO_SQL}), execution_time_ms,
        p_shared_buffers, CAST(ROUND(avg_query_time * 100) AS BIGINT), version, size_bytes) AS item FROM v_snapshots
    UNION ALL SELECT database_id, 'info', concat_ws('|', '2024-01-31T00:00:00Z', COUNT(*), strftime(MIN(executed_at), {ISO_SQL}),
        strftime(MAX(executed_at), {ISO_SQL}), '1 day', 90) FROM v_snapshots GROUP BY database_id
    UNION ALL SELECT database_id, 'change', concat_ws('|', strftime(executed_at, {ISO_SQL}), name, old, new, change_type) FROM changes""",
    extra=CHANGES30,
)
def export_timeline_json(spark, sf):
    """Write the JSON export and give back what a reader of its three parts sees."""
    rows = snapshots(spark, sf)
    path = shared_folder(spark, "timeline-json")
    exports.export_timeline_json(rows, snap.parameter_changes(rows, AS_OF, 30), path, AS_OF)

    def part(folder, schema, name, *columns):
        back = spark.read.schema(f"database_id string, {schema}").json(f"{path}/{folder}")
        return back.select("database_id", F.lit(name).alias("part"), F.concat_ws("|", *columns).alias("item"))

    stored = part(
        "snapshots",
        """id bigint, collected_at string, execution_time_ms bigint, parameters map<string,string>, metrics map<string,double>,
        metadata struct<version:string,size_bytes:bigint>""",
        "snapshot",
        "id", "collected_at", "execution_time_ms",
        F.try_element_at("parameters", F.lit("shared_buffers")),
        F.round(F.try_element_at("metrics", F.lit("avg_query_time")) * 100).cast("bigint"),
        "metadata.version", "metadata.size_bytes",
    )
    info = part(
        "info",
        "exported_at string, snapshot_count bigint, date_range struct<`from`:string,`to`:string>, frequency string, retention_days int",
        "info",
        "exported_at", "snapshot_count", "date_range.from", "date_range.to", "frequency", "retention_days",
    )
    changes = part(
        "parameter_changes",
        "detected_at string, parameter string, `from` string, `to` string, change_type string",
        "change",
        "detected_at", "parameter", "from", "to", "change_type",
    )
    return stored.unionByName(info).unionByName(changes)


@register(
    "export_documents",
    f"""SELECT database_id, '2024-01-31T00:00:00Z' AS exported_at, ANY_VALUE(n_all) AS snapshot_count,
      COUNT(*) AS listed, strftime(MAX(executed_at), {ISO_SQL}) AS first_listed, CAST(SUM(snapshot_id) AS BIGINT) AS ids,
      CAST(SUM(CAST(ROUND(avg_query_time * 100) AS BIGINT)) AS BIGINT) AS cents, COALESCE(ANY_VALUE(n_changes), 0) AS changes
    FROM newest s LEFT JOIN (SELECT c.database_id, COUNT(*) AS n_changes FROM changes c JOIN newest n
      ON n.database_id = c.database_id AND n.executed_at = c.executed_at GROUP BY 1) k USING (database_id) GROUP BY database_id""",
    extra=(*CHANGES30, """newest AS (SELECT *, COUNT(*) OVER (PARTITION BY database_id) AS n_all FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY database_id ORDER BY executed_at DESC, snapshot_id DESC) <= 7)"""),
)
def export_documents(spark, sf):
    """Export, put each database's document of seven snapshots together again, and read it as a client would."""
    rows = snapshots(spark, sf)
    path = shared_folder(spark, "timeline-documents")
    exports.export_timeline_json(rows, snap.parameter_changes(rows, AS_OF, 30), path, AS_OF)
    parts = {
        "export_info": "struct<exported_at:string,snapshot_count:bigint>",
        "parameter_changes": "array<struct<id:bigint>>",
        "snapshots": "array<struct<id:bigint,collected_at:string,metrics:map<string,double>>>",
    }
    schema = "struct<" + ",".join(f"{n}:{t}" for n, t in parts.items()) + ">"
    read = exports.export_documents(spark, path, limit=7).select("database_id", F.from_json("document", schema).alias("d"))
    cents = F.transform("d.snapshots", lambda x: F.round(F.try_element_at(x["metrics"], F.lit("avg_query_time")) * 100).cast("bigint"))

    def total(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))

    return read.select(
        "database_id",
        "d.export_info.exported_at",
        "d.export_info.snapshot_count",
        F.size("d.snapshots").cast("bigint").alias("listed"),
        F.col("d.snapshots")[0]["collected_at"].alias("first_listed"),
        total(F.col("d.snapshots.id")).alias("ids"),
        total(cents).alias("cents"),
        F.size("d.parameter_changes").cast("bigint").alias("changes"),
    )


@register(
    "export_info",
    """SELECT database_id, '2024-01-31T00:00:00Z' AS exported_at, COUNT(*) AS snapshot_count,
      strftime(MIN(executed_at), '%Y-%m-%dT%H:%M:%SZ') AS date_from, strftime(MAX(executed_at), '%Y-%m-%dT%H:%M:%SZ') AS date_to,
      '1 day' AS frequency, 90 AS retention_days FROM v_snapshots GROUP BY database_id""",
)
def export_info(spark, sf):
    info = exports.export_info(snapshots(spark, sf), AS_OF)
    return info.select(
        "database_id", "exported_at", "snapshot_count", F.col("date_range.from").alias("date_from"),
        F.col("date_range.to").alias("date_to"), "frequency", "retention_days",
    )
