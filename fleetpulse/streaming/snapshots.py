"""Streaming snapshot metrics and latest check results.

State is one row per database and window, or per database and check type; both
are declarative aggregates, so a hot database is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators.skew import newest


def stream_snapshot_windows(
    events: DataFrame,
    aggregates: dict[str, Column],
    keys: Sequence[str] = ("database_id",),
    time: str = "ts",
    period: str = "1 day",
    watermark: str = "1 hour",
) -> DataFrame:
    """Metrics per database and tumbling period; rows later than ``watermark`` are dropped.

    ``time`` has no zone.  It is read as UTC, in which ``window`` cuts its periods,
    and the borders are given back without a zone, so the session's zone plays no part.
    """
    zone = F.current_timezone()
    as_utc = F.convert_timezone(F.lit("UTC"), zone, F.col(time)).cast("timestamp")
    timed = events.withColumn("_time", as_utc).withWatermark("_time", watermark)
    grouped = timed.groupBy(*keys, F.window("_time", period).alias("period"))
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(
        *keys,
        *[F.convert_timezone(zone, F.lit("UTC"), F.col(f"period.{x}").cast("timestamp_ntz")).alias(f"period_{x}") for x in ("start", "end")],
        *aggregates,
    )


def stream_latest_per_check(results: DataFrame, keys: Sequence[str] = ("database_id",)) -> DataFrame:
    """Newest successful result per database and check type, updated as results arrive."""
    groups = [*keys, "check_type"]
    row = F.struct(*[F.col(c) for c in results.columns if c not in groups])
    return (
        results.filter(F.col("status") == "success")
        .groupBy(*groups)
        .agg(newest(row, F.col("executed_at"), F.col("id")).alias("_row"))
        .select(*groups, "_row.*")
    )
