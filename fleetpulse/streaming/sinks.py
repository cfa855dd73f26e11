"""Exactly-once table sink for update-mode streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.operators.skew import newest
from fleetpulse.session import shared_folder

#: Batches between two compactions of a table.
COMPACT_EVERY = 10


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Stream of the Parquet files in ``folder`` named like ``pattern``; a batch takes a bounded number of files."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return source.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class VersionedTable:
    """A table that grows by one part per micro-batch and is compacted now and then.

    Part N is ``batch=N``.  Every ``compact_every`` batches a ``base=N`` takes the
    place of all parts up to N; the base and parts before it stay until the next
    one, so a batch that is run again finds what it read before.  Which parts a
    batch sees follows from its number alone.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.every = spark, path, compact_every

    def _read(self, base: int, batches: Iterable[int]) -> DataFrame | None:
        found = [f"{self.path}/base={base}"] if base >= 0 else []
        found += [f"{self.path}/batch={n}" for n in batches]
        return self.spark.read.parquet(*found) if found else None

    def before(self, batch_id: int) -> DataFrame | None:
        """Everything written before a batch."""
        base = batch_id // self.every * self.every - 1
        return self._read(base, range(base + 1, batch_id))

    def write(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch's part, with its number, and read it back."""
        part = f"{self.path}/batch={batch_id}"
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(part)
        return self.spark.read.parquet(part)

    def compact(self, batch_id: int, shrink: Callable[[DataFrame], DataFrame]) -> None:
        """After every ``compact_every``-th batch write a new base and drop what the one before it replaced."""
        if (batch_id + 1) % self.every:
            return
        whole = self._read(batch_id - self.every, range(batch_id - self.every + 1, batch_id + 1))
        shrink(whole).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
        last = batch_id - self.every
        self._drop(f"base={last - self.every}", *[f"batch={n}" for n in range(last - self.every + 1, last + 1)])

    def all(self) -> DataFrame:
        """The newest base and the parts behind it."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = [f.getPath().getName() for f in files if f.isDirectory()]
        numbers = {kind: [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")] for kind in ("base", "batch")}
        base = max(numbers["base"], default=-1)
        return self._read(base, sorted(n for n in numbers["batch"] if n > base))

    def _drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def newest_versions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last written version of each key, with its batch."""
    row = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(newest(row, F.col("batch")).alias("_row")).select(*keys, "_row.*")


def start_upserts(
    updates: DataFrame, out: str, checkpoint: str, keys: Sequence[str], compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Write the changed rows of every micro-batch and stop at the end of the input.

    A batch that is run again after a failure overwrites its part, so each batch
    counts once; replaced versions of a key go when the table is compacted.
    """
    stored = VersionedTable(updates.sparkSession, out, compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        stored.write(batch, batch_id)
        stored.compact(batch_id, lambda rows: newest_versions(rows, keys))

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_upserts(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """The last written version of each key."""
    return newest_versions(VersionedTable(spark, out).all(), keys).drop("batch")


def run_upserts(updates: DataFrame, keys: Sequence[str], purpose: str) -> DataFrame:
    """Run the stream over what is available and give its final table."""
    spark = updates.sparkSession
    folder = shared_folder(spark, purpose)
    query = start_upserts(updates, f"{folder}/rows", f"{folder}/checkpoint", keys)
    query.awaitTermination()
    return read_upserts(spark, f"{folder}/rows", keys)
