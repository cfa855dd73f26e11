"""Turns of conversations in order, and digests of long ordered lists, without gathering a conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written


def with_position(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Add ``position``, from 1, of each row among those of its ``key`` in ``order``.

    All rows are sorted together over ranges of (key, order), so a key that holds
    a third of them lies in a third of the tasks.  A row's number in its task,
    less that of the key's first row there, plus the key's rows in earlier tasks
    is its position.  Rows that are equal in key and order share a task.
    """
    inside = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    numbered = written(inside.withColumn("_row", F.monotonically_increasing_id()), "turn-order")
    task = F.shiftright("_row", 33)  # the high bits of such a number are those of its task
    parts = numbered.groupBy(key, task.alias("_task")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    starts = parts.select(F.struct(key, "_task").alias("_k"), shift.alias("_shift"))
    keyed = numbered.withColumn("_k", F.struct(key, task.alias("_task")))
    return keyed.join(starts, "_k").withColumn("position", F.col("_row") + F.col("_shift")).drop("_k", "_row", "_shift")


class JoinedDigest:
    """SHA-256 of pieces joined by a separator, fed piece by piece."""

    def __init__(self, separator: bytes):
        self.hash, self.separator, self.any = hashlib.sha256(), separator, False

    def add(self, piece: bytes) -> None:
        if self.any:
            self.hash.update(self.separator)
        self.hash.update(piece)
        self.any = True


def runs(rows: DataFrame, key: str, order: Sequence[str], start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """One row of ``schema`` (key and value) per key, from its rows streamed in ``order``.

    ``start()`` makes a state, ``step(state, row)`` takes a row and ``end(state)``
    gives the value.  Rows are shuffled by key and sorted there, which spills;
    Python sees one batch at a time, so memory is that of a state, however many
    rows a key has.
    """
    columns = rows.columns
    at = columns.index(key)
    kind = to_arrow_type(rows.schema[key].dataType)

    def results(out: tuple[list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=["key", "value"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, ([], [])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[at] != current:
                    if state is not None:
                        out[0].append(current)
                        out[1].append(end(state))
                    current, state = row[at], start()
                step(state, row)
            yield results(out)
            out = ([], [])
        if state is not None:
            yield results(([current], [end(state)]))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(stream, schema)


def joined_digests(rows: DataFrame, key: str, order: Sequence[str], piece: str, separator: str) -> DataFrame:
    """``key`` and ``digest``: lowercase SHA-256 hex of each key's pieces, in order and joined."""
    at = rows.columns.index(piece)
    cut = separator.encode()

    def step(state: JoinedDigest, row: tuple) -> None:
        state.add(row[at].encode())

    kind = rows.schema[key].dataType.simpleString()
    return runs(rows, key, order, lambda: JoinedDigest(cut), step, lambda s: s.hash.hexdigest(), f"`{key}` {kind}, digest string")
