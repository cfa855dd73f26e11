"""Snapshot metrics: aggregates of telemetry per database, or over everything.

``keys`` names the grouping columns (``["database_id", "captured_at"]`` for a
fleet's history, ``[]`` for one database).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.constants import SNAPSHOT_SETTINGS
from fleetpulse.functions.numbers import round_half_up
from fleetpulse.functions.sizes import size_pretty
from fleetpulse.operators.histogram import value_counts, with_totals
from fleetpulse.operators.reports import dead_share, schema_filter
from fleetpulse.operators.skew import merge_parts


def cache_hit_rate(io_stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    hit, read = F.sum("heap_blks_hit"), F.sum("heap_blks_read")
    share = F.try_divide(hit.cast("decimal(20,0)"), (hit + read).cast("decimal(20,0)"))
    rate = F.when(hit + read == 0, F.lit(0.0)).otherwise(F.round(share * 100, 2).cast("double"))
    return io_stats.groupBy(*keys).agg(rate.alias("cache_hit_rate"))


def statement_histogram(statements: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The written histogram of the positive mean times, with the calls; reads ``statements`` once."""
    return value_counts(statements.filter(F.col("mean_exec_time") > 0), keys, "mean_exec_time", ["calls"])


def summary_of_histogram(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average and 95th percentile of the mean time, statements and calls.

    Histograms of several periods, put together by ``merge_histograms``, give the
    summary of all of them.
    """
    time = F.sum(F.col("value").cast("decimal(28,10)") * F.col("copies").cast("decimal(18,0)")).cast("decimal(38,10)")
    average = F.try_divide(time, F.sum("copies").cast("decimal(18,0)"))
    totals = {
        "avg_query_time": F.round(average, 2).cast("double"),
        "total_queries": F.coalesce(F.sum("copies"), F.lit(0)),
        "total_calls": F.sum("calls"),
    }
    found = with_totals(histogram, keys, totals, {"p95_query_time": 0.95})
    return found.withColumn("p95_query_time", round_half_up(F.col("p95_query_time"), 2))


def statement_summary(statements: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average and 95th percentile of the mean time, statements and calls, where the mean is positive."""
    return summary_of_histogram(statement_histogram(statements, keys), keys)


def _is_bloated() -> Column:
    return ((F.col("n_live_tup") + F.col("n_dead_tup")) > 0) & (dead_share() > 0.1)


def _bloat_aggregates(where: Column | None = None) -> list[Column]:
    share = dead_share() * 100 if where is None else F.when(where, dead_share() * 100)
    count = F.count("*") if where is None else F.count_if(where)
    return [
        count.alias("bloated_tables"),
        F.coalesce(F.round(F.avg(share), 2).cast("double"), F.lit(0.0)).alias("avg_bloat_pct"),
    ]


def bloat_summary(tables: DataFrame, keys: Sequence[str] = (), schema: str | None = "public") -> DataFrame:
    return schema_filter(tables, schema).filter(_is_bloated()).groupBy(*keys).agg(*_bloat_aggregates())


def table_summary(
    tables: DataFrame, keys: Sequence[str] = (), schema: str | None = "public", min_seq: int = 100
) -> DataFrame:
    """``bloat_summary`` and ``high_seq_scan_count`` from one scan."""
    return (
        schema_filter(tables, schema)
        .groupBy(*keys)
        .agg(*_bloat_aggregates(_is_bloated()), F.count_if(F.col("seq_scan") > min_seq).alias("high_seq_scan_tables"))
    )


def connection_counts(activity: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return activity.groupBy(*keys).agg(
        F.count("*").alias("total_connections"),
        F.count_if(F.col("state") == "active").alias("active_connections"),
        F.count_if(F.col("state") == "idle").alias("idle_connections"),
    )


def high_seq_scan_count(
    tables: DataFrame, keys: Sequence[str] = (), schema: str | None = "public", min_seq: int = 100
) -> DataFrame:
    return (
        schema_filter(tables, schema)
        .groupBy(*keys)
        .agg(F.count_if(F.col("seq_scan") > min_seq).alias("high_seq_scan_tables"))
    )


def snapshot_metrics(
    tables: DataFrame,
    statements: DataFrame,
    activity: DataFrame,
    io_stats: DataFrame,
    keys: Sequence[str] = (),
    schema: str | None = "public",
    min_seq: int = 100,
) -> DataFrame:
    """All snapshot metrics side by side, one row per key."""
    merged = merge_parts(
        [
            cache_hit_rate(io_stats, keys),
            statement_summary(statements, keys),
            table_summary(tables, keys, schema, min_seq),
            connection_counts(activity, keys),
        ],
        keys,
    )
    zero = ["cache_hit_rate", "bloated_tables", "avg_bloat_pct", "high_seq_scan_tables"]
    return merged.fillna(0, subset=zero)


def settings_to_map(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One map of snapshot settings per key; a value is the setting with its unit.

    At most fourteen names pass the filter; repeated rows of a name are reduced
    to one before the map is built, so no map can grow with the data.
    """
    value = F.concat(F.col("setting"), F.coalesce(F.col("unit"), F.lit("")))
    once = (
        settings.filter(F.col("name").isin(*SNAPSHOT_SETTINGS))
        .groupBy(*keys, "name")
        .agg(F.max(value).alias("value"))
    )
    return once.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("parameters")
    )


def database_size(tables: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return tables.groupBy(*keys).agg(F.sum("total_bytes").alias("size_bytes")).withColumn(
        "database_size", size_pretty(F.col("size_bytes"))
    )


def collect_metadata(
    tables: DataFrame, indexes: DataFrame, extensions: DataFrame, version: str, keys: Sequence[str]
) -> DataFrame:
    """Version, size, table and index counts and the sorted extension names per key.

    Extension names are reduced to distinct ones first; a database installs few.
    """
    names = (
        extensions.select(*keys, "extname").distinct().groupBy(*keys)
        .agg(F.array_sort(F.collect_list("extname")).alias("extensions"))
    )
    merged = merge_parts(
        [
            tables.groupBy(*keys).agg(F.sum("total_bytes").alias("size_bytes"), F.count("*").alias("table_count")),
            indexes.groupBy(*keys).agg(F.count("*").alias("index_count")),
            names,
        ],
        keys,
    )
    none = F.array().cast("array<string>")
    return merged.select(
        *keys,
        F.lit(version).alias("version"),
        "size_bytes",
        size_pretty(F.col("size_bytes")).alias("database_size"),
        F.coalesce("table_count", F.lit(0)).alias("table_count"),
        F.coalesce("index_count", F.lit(0)).alias("index_count"),
        F.coalesce("extensions", none).alias("extensions"),
    )


def collect_snapshot(metrics: DataFrame, parameters: DataFrame, metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshot documents: parameters, metrics and metadata of each key."""
    names = [c for c in metrics.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("double").alias("v")) for n in names])
    as_map = metrics.select(*keys, F.map_from_entries(F.filter(pairs, lambda p: p.v.isNotNull())).alias("metrics"))
    described = metadata.select(
        *keys, F.struct(*[F.col(c) for c in metadata.columns if c not in keys]).alias("metadata")
    )
    return (
        as_map.join(parameters, list(keys), "full_outer").join(described, list(keys), "full_outer")
    )
