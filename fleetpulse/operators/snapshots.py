"""Snapshot history: selection, change detection, comparison and timeline.

A snapshot row has ``id, executed_at, execution_time_ms``, the maps
``parameters`` and ``metrics``, and the struct ``metadata``; ``keys`` names the
database columns (``["database_id"]`` by default).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.constants import (
    COMPARED_METRICS,
    NUMERIC_SETTINGS,
)
from fleetpulse.functions.ladders import metric_category, metric_status
from fleetpulse.functions.numbers import metric_change
from fleetpulse.functions.sizes import parse_size_bytes, size_pretty
from fleetpulse.functions.text import version_token
from fleetpulse.operators.skew import newest, newest_rows, oldest, split_lag

DATABASE = ("database_id",)


def _moment(value: datetime | date) -> Column:
    return F.lit(value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()).cast("timestamp_ntz")


def since(df: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Rows of the ``days`` days before ``as_of``; the bound is a literal the scan can use."""
    return df.filter(F.col("executed_at") >= _moment(as_of - timedelta(days=days)))


def between_dates(df: DataFrame, first: date, last: date) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``last``."""
    return df.filter(
        (F.col("executed_at") >= _moment(first)) & (F.col("executed_at") < _moment(last + timedelta(days=1)))
    )


def newest_snapshots(snapshots: DataFrame, rows: int, keys: Sequence[str] = DATABASE) -> DataFrame:
    return newest_rows(snapshots, keys, ["executed_at", "id"], rows)


def latest_snapshot(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    return _whole_row(snapshots, keys, newest)


def snapshot_of_day(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """The first stored snapshot (lowest id) of every day."""
    dated = snapshots.withColumn("snap_date", F.to_date("executed_at"))
    groups = [*keys, "snap_date"]
    row = F.struct(*[F.col(c) for c in dated.columns if c not in groups])
    return dated.groupBy(*groups).agg(oldest(row, F.col("id")).alias("_row")).select(*groups, "_row.*")


def _whole_row(df: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(pick(row, F.col("executed_at"), F.col("id")).alias("_row")).select(*keys, "_row.*")


def previous_snapshot(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """Each snapshot with the one before it in ``previous``."""
    carried = [c for c in snapshots.columns if c not in keys]
    return split_lag(snapshots, keys, ["executed_at", "id"], carried)


def change_type(name: Column, old: Column, new: Column) -> Column:
    old_size, new_size = parse_size_bytes(old), parse_size_bytes(new)
    numeric = (
        F.when(old_size.isNull() | new_size.isNull(), "change")
        .when(new_size > old_size, "increase")
        .when(new_size < old_size, "decrease")
        .otherwise("stable")
    )
    return (
        F.when(old.isNull() | new.isNull(), "change")
        .when(name.isin(*NUMERIC_SETTINGS), numeric)
        .when(old == new, "stable")
        .otherwise("change")
    )


def both_empty(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) == "") & (F.coalesce(b, F.lit("")) == "")


def changed_parameters(old: Column, new: Column, include_removed: bool = False) -> Column:
    """array<struct(parameter, from, to, change_type)> between two parameter maps.

    Names only in the old map are ignored unless ``include_removed``.
    """
    names = F.map_keys(new)
    if include_removed:
        names = F.array_union(F.map_keys(new), F.map_keys(old))

    def entry(name: Column) -> Column:
        before, after = F.try_element_at(old, name), F.try_element_at(new, name)
        return F.struct(
            name.alias("parameter"),
            before.alias("from"),
            after.alias("to"),
            change_type(name, before, after).alias("change_type"),
        )

    def differs(name: Column) -> Column:
        before, after = F.try_element_at(old, name), F.try_element_at(new, name)
        return ~before.eqNullSafe(after) & ~both_empty(before, after)

    return F.transform(F.filter(names, differs), entry)


def parameter_changes(
    snapshots: DataFrame,
    as_of: datetime,
    days: int = 7,
    keys: Sequence[str] = DATABASE,
    include_removed: bool = False,
) -> DataFrame:
    """One row per changed parameter between consecutive snapshots of the last ``days`` days.

    ``id`` is the newer snapshot's.
    """
    recent = since(snapshots, as_of, days).select(*keys, "id", "executed_at", "parameters")
    paired = split_lag(recent, keys, ["executed_at", "id"], ["parameters"])
    return (
        paired.filter(F.col("previous.parameters").isNotNull() & F.col("parameters").isNotNull())
        .select(
            *keys,
            "id",
            F.col("executed_at").alias("detected_at"),
            F.inline_outer(changed_parameters(F.col("previous.parameters"), F.col("parameters"), include_removed)),
        )
        .filter(F.col("parameter").isNotNull())
    )


def change_events(changes: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """Changes nested per newer snapshot; a snapshot tracks few settings, so the map stays small."""
    value = F.struct("from", "to", "change_type", "detected_at")
    return changes.groupBy(*keys, "detected_at", "id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", value.alias("change"))))).alias("changes")
    )


def parameter_change_count(changes: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count("*").alias("parameter_changes"))


def snapshot_pair_by_date(
    snapshots: DataFrame, first: date, second: date, keys: Sequence[str] = DATABASE
) -> DataFrame:
    """Per database the snapshots ``a`` and ``b`` of two dates, where both exist.

    One aggregate picks both rows, so no join is needed, and the date bounds
    reach the scan.
    """

    def on(day: date) -> Column:
        return (F.col("executed_at") >= _moment(day)) & (F.col("executed_at") < _moment(day + timedelta(days=1)))

    row = F.struct(*[F.col(c) for c in snapshots.columns if c not in keys])
    return (
        snapshots.filter(on(first) | on(second))
        .groupBy(*keys)
        .agg(
            F.min_by(F.when(on(first), row), F.when(on(first), F.col("id"))).alias("a"),
            F.min_by(F.when(on(second), row), F.when(on(second), F.col("id"))).alias("b"),
        )
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def compare_params(pairs: DataFrame, keys: Sequence[str] = DATABASE, include_removed: bool = False) -> DataFrame:
    changed = changed_parameters(F.col("a.parameters"), F.col("b.parameters"), include_removed)
    each = pairs.select(*keys, F.col("b.executed_at").alias("detected_at"), F.inline_outer(changed))
    return each.filter(F.col("parameter").isNotNull())


def compare_metrics(
    pairs: DataFrame, keys: Sequence[str] = DATABASE, names: Sequence[str] = COMPARED_METRICS
) -> DataFrame:
    """Per metric present on both sides: before, after, change, change in percent and direction."""
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                metric_change(F.try_element_at("a.metrics", F.lit(n)), F.try_element_at("b.metrics", F.lit(n))).alias("m"),
            )
            for n in names
        ]
    )
    both = F.filter(rows, lambda r: r.m.before.isNotNull() & r.m.after.isNotNull())
    each = pairs.select(*keys, F.explode_outer(both).alias("r")).filter(F.col("r").isNotNull())
    return each.select(*keys, "r.metric", "r.m.*")


def compare_metadata(pairs: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    a, b = "a.metadata", "b.metadata"
    return pairs.select(
        *keys,
        (~F.col(f"{a}.version").eqNullSafe(F.col(f"{b}.version"))).alias("version_changed"),
        F.col(f"{a}.version").alias("version_before"),
        F.col(f"{b}.version").alias("version_after"),
        F.array_except(f"{b}.extensions", f"{a}.extensions").alias("extensions_added"),
        F.array_except(f"{a}.extensions", f"{b}.extensions").alias("extensions_removed"),
        *[
            F.col(f"{side}.{field}").alias(f"{field}_{word}")
            for field in ("size_bytes", "table_count", "index_count")
            for side, word in ((a, "before"), (b, "after"))
        ],
    )


def as_pairs(with_previous: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """Consecutive snapshots in the pair form the comparisons take."""
    row = F.struct(*[F.col(c) for c in with_previous.columns if c not in (*keys, "previous")])
    return with_previous.filter(F.col("previous").isNotNull()).select(*keys, F.col("previous").alias("a"), row.alias("b"))


def dig_metric(name: str, default: float | None = 0.0) -> Column:
    value = F.try_element_at(F.col("metrics"), F.lit(name))
    return value if default is None else F.coalesce(value, F.lit(default))


def timeline_series(snapshots: DataFrame, as_of: datetime, days: int = 30, keys: Sequence[str] = DATABASE) -> DataFrame:
    return since(snapshots, as_of, days).select(
        *keys,
        "id",
        F.date_format("executed_at", "yyyy-MM-dd HH:mm").alias("date"),
        dig_metric("cache_hit_rate").alias("cache_hit_rate"),
        dig_metric("avg_query_time").alias("avg_query_time"),
        dig_metric("bloated_tables").cast("long").alias("bloated_tables"),
        dig_metric("total_connections").cast("long").alias("total_connections"),
    )


def timeline_stats(snapshots: DataFrame, changes: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """Snapshots, date range, newest hit rate and parameter changes per database.

    Both inputs are reduced to one row per database before they meet.
    """
    stats = snapshots.groupBy(*keys).agg(
        F.count("*").alias("total_snapshots"),
        F.min("executed_at").alias("first_at"),
        F.max("executed_at").alias("last_at"),
        newest(dig_metric("cache_hit_rate", None), F.col("executed_at"), F.col("id")).alias("latest_cache_hit_rate"),
    )
    joined = stats.join(parameter_change_count(changes, keys), list(keys), "left")
    return joined.fillna(0, subset=["parameter_changes"])


def snapshot_summary(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    return snapshots.select(
        *keys,
        "id",
        "executed_at",
        F.size("parameters").alias("parameters_tracked"),
        F.size("metrics").alias("metrics_collected"),
    )


def snapshot_status(
    snapshots: DataFrame, changes: DataFrame, keys: Sequence[str] = DATABASE, recent: int = 5
) -> DataFrame:
    """Count, newest snapshot, the ``recent`` newest times and the change events per database."""
    totals = snapshots.groupBy(*keys).agg(F.count("*").alias("total_snapshots"), F.max("executed_at").alias("latest_at"))
    times = (
        newest_snapshots(snapshots, recent, keys)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.date_format("executed_at", "yyyy-MM-dd HH:mm")), asc=False).alias("recent"))
    )
    events = changes.groupBy(*keys).agg(F.count_distinct("detected_at", "id").alias("change_events"))
    out = totals.join(times, list(keys), "left").join(events, list(keys), "left")
    return out.fillna(0, subset=["change_events"])


def metric_board(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """Every metric of every snapshot with its category and status."""
    return snapshots.select(*keys, "id", F.explode("metrics").alias("metric", "value")).select(
        "*",
        metric_category(F.col("metric")).alias("category"),
        metric_status(F.col("metric"), F.col("value")).alias("status"),
    )


def timeline_rows(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    """The flat export columns of each snapshot."""
    # The export's column titles, here and below.
    whole = {
        "bloated_tables": "Bloated Tables",
        "total_connections": "Total Connections",
        "active_connections": "Active Connections",
        "high_seq_scan_tables": "High Seq Scan Tables",
    }
    return snapshots.select(
        *keys,
        F.date_format("executed_at", "yyyy-MM-dd").alias("Date"),
        F.date_format("executed_at", "HH:mm:ss").alias("Time"),
        dig_metric("cache_hit_rate", None).alias("Cache Hit Rate %"),
        dig_metric("avg_query_time", None).alias("Avg Query Time (ms)"),
        dig_metric("p95_query_time", None).alias("P95 Query Time (ms)"),
        *[dig_metric(n, None).cast("long").alias(title) for n, title in whole.items()],
        size_pretty(F.col("metadata.size_bytes")).alias("Database Size"),
        version_token(F.col("metadata.version")).alias("Version"),
    )
