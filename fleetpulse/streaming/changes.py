"""Streaming change detection on settings that arrive one row per reading, in any order.

A reading has the ``keys``, ``parameter``, ``executed_at``, ``id`` and ``setting``.
The readings seen so far are a log-structured table of units (time slice and
hash bucket of the key).  A micro-batch reads the units it touches, and of the
other slices only the ``edges``: the first and last reading of each key and
slice.  With these every new reading meets its true neighbours, so the pairs it
makes or breaks are stored anew, the newest version of each pair counts, and the
result equals the batch result, whatever the order and the cut of the input.

With ``lateness`` the state is bounded: a key keeps the readings of that period
before its own newest one and the reading before them, and an older reading is
dropped when it arrives.  With ``retention`` a predecessor that is older than
that is forgotten, and compaction removes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators.skew import newest, split_lag
from fleetpulse.operators.snapshots import both_empty, change_type
from fleetpulse.streaming.sinks import newest_versions
from fleetpulse.streaming.state import BUCKETS, COMPACT_EVERY, WHOLE, UnitTable, bucket_of

#: Pieces that a batch's readings are cut into for hot keys.
PIECES = 64
#: Bytes of readings, compressed, up to which a key may be sorted whole by one task.
SORTED_WHOLE = 32 << 20
#: Format of ``executed_at`` that names a time slice.
SLICE = "yyyy-MM"
_READING = ("executed_at", "id", "setting")


def _same_group(left: str, right: str, group: Sequence[str]) -> Column:
    same = F.lit(True)
    for name in group:
        same = same & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return same


def detect(
    readings: DataFrame, known: DataFrame | None, keys: Sequence[str], retention: str | None = None, few: bool = False
) -> DataFrame:
    """The pairs that ``readings`` make or break, beside what is ``known`` already: one row per
    reading whose predecessor is new, with ``is_change``.

    With ``retention`` a predecessor older than that is forgotten.  Readings that
    are ``few`` altogether need no cutting of hot keys.
    """
    group = [*keys, "parameter"]
    columns = [*group, *_READING]
    rows = readings.select(*columns, F.lit(True).alias("_new"))
    if known is not None:
        rows = rows.unionByName(known.select(*columns, F.lit(False).alias("_new")))
    if few:
        window = Window.partitionBy(*group).orderBy("executed_at", "id")
        paired = rows.withColumn("previous", F.lag(F.struct("executed_at", "setting", "_new")).over(window))
    else:
        paired = split_lag(rows, group, ["executed_at", "id"], ["executed_at", "setting", "_new"], pieces=PIECES)
    before, after = F.col("previous.setting"), F.col("setting")
    has_previous = F.col("previous").isNotNull()
    if retention is not None:
        has_previous &= F.col("previous.executed_at") >= F.col("executed_at") - F.expr(f"INTERVAL {retention}")
    differs = has_previous & ~before.eqNullSafe(after) & ~both_empty(before, after)
    return paired.filter(F.col("_new") | F.coalesce(F.col("previous._new"), F.lit(False))).select(
        *group,
        F.col("executed_at").alias("detected_at"),
        "id",
        before.alias("from"),
        after.alias("to"),
        change_type(F.col("parameter"), before, after).alias("change_type"),
        F.coalesce(differs, F.lit(False)).alias("is_change"),
    )


def _tables(spark: SparkSession, out: str, compact_every: int = COMPACT_EVERY) -> tuple[UnitTable, UnitTable, UnitTable]:
    return tuple(UnitTable(spark, f"{out}/{name}", compact_every) for name in ("state", "edges", "changes"))


def _edges(readings: DataFrame, group: Sequence[str]) -> DataFrame:
    """First and last reading of each key and slice."""
    row = F.struct(*_READING)
    return (
        readings.groupBy(*group, F.col("slice").alias("of_slice"), F.lit(WHOLE).alias("slice"), "bucket")
        .agg(F.min(row).alias("first"), F.max(row).alias("last"))
    )


def _merged_edges(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.groupBy(*group, "of_slice", "slice", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _within(rows: DataFrame, lateness: str, retention: str | None, group: Sequence[str]) -> DataFrame:
    """The readings that can still become a neighbour: those of the last ``lateness`` of their own
    key, and the newest one before unless ``retention`` forgets it."""
    value = F.struct(*_READING)
    ends = rows.groupBy(*group).agg(F.max("executed_at").alias("_end")).alias("e")
    bound = F.col("_end") - F.expr(f"INTERVAL {lateness}")
    aged = rows.alias("r").join(ends, _same_group("r", "e", group)).select("r.*", bound.alias("_bound"))
    late = F.col("executed_at") < F.col("_bound")
    before = aged.filter(late).groupBy(*group, "slice", "bucket", "_bound").agg(F.max(value).alias("_row"))
    if retention is not None:
        before = before.filter(F.col("_row.executed_at") >= F.col("_bound") - F.expr(f"INTERVAL {retention}"))
    kept = aged.filter(~late).drop("_bound")
    return kept.unionByName(before.select(*group, "slice", "bucket", "_row.*"))


def stream_parameter_changes(
    readings: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = ("database_id",),
    retention: str | None = None,
    lateness: str | None = None,
    compact_every: int = COMPACT_EVERY,
    buckets: int = BUCKETS,
    slices: str = SLICE,
) -> StreamingQuery:
    """Keep the readings, their edges and versions of all pairs in ``out``; see the module.

    ``slices`` is the format of ``executed_at`` that names a slice.  With
    ``lateness`` the state is small and has one slice.  A batch that is run again
    reads the same units and overwrites its own parts.
    """
    spark = readings.sparkSession
    group = [*keys, "parameter"]
    state, edges, pairs = _tables(spark, out, compact_every)

    def slice_of(time: str) -> Column:
        return F.concat(F.lit("s"), F.coalesce(F.date_format(F.to_date(time), slices), F.lit("")))

    def placed(rows: DataFrame) -> DataFrame:
        part = slice_of("executed_at") if lateness is None else F.lit(WHOLE)
        return rows.select(*group, *_READING, part.alias("slice"), bucket_of(group, buckets))

    def in_time(batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch without readings that come too late for their own key."""
        placed(batch).write.mode("overwrite").parquet(f"{out}/staged")
        fresh = spark.read.parquet(f"{out}/staged")
        units = {(WHOLE, r.bucket) for r in fresh.select("bucket").distinct().collect()}
        known = edges.before(batch_id, units)
        if known is None:
            return fresh
        ends = known.groupBy(*group).agg(F.max("last.executed_at").alias("_end")).alias("e")
        met = fresh.alias("r").join(ends, _same_group("r", "e", group), "left")
        on_time = F.col("_end").isNull() | (F.col("executed_at") >= F.col("_end") - F.expr(f"INTERVAL {lateness}"))
        return met.filter(on_time).select("r.*")

    def neighbours(batch_id: int, units: set[tuple[str, int]]) -> DataFrame | None:
        """Readings of the touched units and the edges of the others."""
        known = state.before(batch_id, units)
        if lateness is not None:
            return known
        rims = edges.before(batch_id, {(WHOLE, b) for _, b in units})
        if rims is None:
            return known
        elsewhere = ~F.concat_ws("/", "of_slice", "bucket").isin(*sorted(f"{s}/{b}" for s, b in units))
        two = _merged_edges(rims, group).filter(elsewhere).select(*group, F.explode(F.array("first", "last")).alias("_row"))
        two = two.select(*group, "_row.*")
        return two if known is None else known.select(*two.columns).unionByName(two)

    def step(batch: DataFrame, batch_id: int) -> None:
        state.write(placed(batch) if lateness is None else in_time(batch, batch_id), batch_id)
        fresh, units = state.part(batch_id), state.units_of(batch_id)
        if fresh is None:
            return
        few = state.size(batch_id, units) <= SORTED_WHOLE
        found = detect(fresh, neighbours(batch_id, units), keys, retention, few)
        version = F.lit(batch_id).cast("long")
        found = found.withColumns({"slice": slice_of("detected_at"), "bucket": bucket_of(group, buckets), "version": version})
        # Both follow from the part just written and from earlier batches.
        with ThreadPoolExecutor(2) as pool:
            rims = pool.submit(edges.write, _edges(fresh, group), batch_id)
            pairs.write(found, batch_id)
            rims.result()
        state.compact(batch_id, units, lambda rows: rows if lateness is None else _within(rows, lateness, retention, group))
        edges.compact(batch_id, edges.units_of(batch_id), lambda rows: _merged_edges(rows, group))
        pairs.compact(batch_id, pairs.units_of(batch_id), lambda rows: _newest_pairs(rows, keys))

    return (
        readings.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newest_pairs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of every pair; its time puts a pair into one slice, its key into one bucket."""
    pair = [*keys, "parameter", "id", "detected_at", "slice", "bucket"]
    return newest_versions(rows.withColumn("batch", F.col("version")), pair).drop("batch")


def read_changes(spark: SparkSession, out: str, keys: Sequence[str] = ("database_id",)) -> DataFrame:
    rows = _tables(spark, out)[2].all().drop("level", "batch")
    return _newest_pairs(rows, keys).filter("is_change").drop("is_change", "version", "slice", "bucket")


def read_state(
    spark: SparkSession, out: str, keys: Sequence[str] = ("database_id",), retention: str | None = None
) -> DataFrame:
    """Last value of every parameter, from the edges; with ``retention`` only of those read that shortly
    before the newest reading."""
    group = [*keys, "parameter"]
    rows = _tables(spark, out)[1].all()
    last = newest(F.col("last"), F.col("last.executed_at"), F.col("last.id"))
    state = rows.groupBy(*group).agg(last.alias("_row")).select(*group, "_row.*")
    if retention is None:
        return state
    bound = rows.select((F.max("last.executed_at") - F.expr(f"INTERVAL {retention}")).alias("b")).scalar()
    return state.filter(F.col("executed_at") >= bound)
