"""Tumbling-window metrics that late rows correct, with a ledger of those rows.

A watermark bounds what a stream keeps in memory, and Spark's own windowed
aggregate drops what comes behind it.  Here a window's metrics are partial
aggregates in a log-structured table: every micro-batch adds one row per key and
window it meets, and the parts of a window add up.  The watermark decides only
whether a row is late: its window ended before the watermark of the batches
before.  Late rows are kept apart in a ledger and corrected into their closed
windows by the same keyed upsert, so the metrics equal those of a batch job over
all rows, whatever their order and lateness.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.streaming.sinks import COMPACT_EVERY
from fleetpulse.streaming.state import BUCKETS, UnitTable, bucket_of

#: How the parts of a metric add up; the others are summed.
MERGES: dict[str, Callable[[str], Column]] = {"min": F.min, "max": F.max, "sum": F.sum}
#: Format of a period's start that names a time slice of the table.
SLICE = "yyyy-MM"


def _merged(rows: DataFrame, keys: Sequence[str], merges: dict[str, str], unit: bool = True) -> DataFrame:
    place = ["slice", "bucket"] if unit else []
    return rows.groupBy(*keys, "period_start", "period_end", *place).agg(
        *[MERGES[how](name).alias(name) for name, how in merges.items()], F.sum("late_rows").alias("late_rows")
    )


def _bound(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """The newest time of the batches before, one small written row."""
    return spark.read.parquet(f"{out}/bound/batch={batch_id - 1}") if batch_id else None


def stream_window_metrics(
    events: DataFrame,
    out: str,
    checkpoint: str,
    aggregates: dict[str, Column],
    merges: dict[str, str] | None = None,
    keys: Sequence[str] = ("database_id",),
    time: str = "ts",
    period: str = "1 day",
    watermark: str = "1 hour",
    compact_every: int = COMPACT_EVERY,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the metrics per key and tumbling period, and the late rows, in ``out``.

    ``merges`` tells how the parts of an aggregate add up (``sum`` unless named).
    ``time`` has no zone, so a period begins where it does in UTC.  A batch that is
    run again reads the same bound and overwrites its own parts.
    """
    spark = events.sparkSession
    merges = {name: (merges or {}).get(name, "sum") for name in aggregates}
    metrics = UnitTable(spark, f"{out}/windows", compact_every)

    def step(batch: DataFrame, batch_id: int) -> None:
        zone = F.current_timezone()
        utc = F.convert_timezone(F.lit("UTC"), zone, F.col(time)).cast("timestamp")
        window = F.window(utc, period)
        start, end = (F.convert_timezone(zone, F.lit("UTC"), window[x].cast("timestamp_ntz")) for x in ("start", "end"))
        rows = batch.withColumns({"period_start": start, "period_end": end})
        known = _bound(spark, out, batch_id)
        newest = known.select("newest").scalar() if known is not None else F.lit(None).cast("timestamp_ntz")
        late = F.coalesce(F.col("period_end") <= newest - F.expr(f"INTERVAL {watermark}"), F.lit(False))
        rows = rows.withColumn("_late", late)

        reached = batch.agg(F.max(time).cast("timestamp_ntz").alias("newest"))
        reached = reached if known is None else reached.union(known.select("newest")).agg(F.max("newest").alias("newest"))
        partial = rows.groupBy(*keys, "period_start", "period_end").agg(
            *[c.alias(n) for n, c in aggregates.items()], F.count_if("_late").alias("late_rows")
        )
        part = F.concat(F.lit("s"), F.date_format(F.to_date("period_start"), SLICE))
        partial = partial.filter(F.col("period_start").isNotNull()).withColumns({"slice": part, "bucket": bucket_of(keys, buckets)})
        ledger = rows.filter("_late").drop("_late")
        with ThreadPoolExecutor(3) as pool:
            jobs = [
                pool.submit(metrics.write, partial, batch_id),
                pool.submit(ledger.write.mode("overwrite").parquet, f"{out}/late/batch={batch_id}"),
                pool.submit(reached.write.mode("overwrite").parquet, f"{out}/bound/batch={batch_id}"),
            ]
            for job in jobs:
                job.result()
        metrics.compact(batch_id, metrics.units_of(batch_id), lambda x: _merged(x, keys, merges))

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_windows(
    spark: SparkSession, out: str, merges: dict[str, str], keys: Sequence[str] = ("database_id",)
) -> DataFrame:
    """Metrics of every period, late rows included; ``late_rows`` tells how many came behind the watermark.

    ``merges`` has the name of every aggregate and how its parts add up.
    """
    return _merged(UnitTable(spark, f"{out}/windows").all(), keys, merges, unit=False)


def read_late(spark: SparkSession, out: str) -> DataFrame:
    """The ledger: late rows with their period and the batch they came in."""
    return spark.read.option("mergeSchema", "true").parquet(f"{out}/late")
