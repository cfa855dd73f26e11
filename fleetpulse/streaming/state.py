"""Log-structured tables for streams: cut into units, appended by batch, compacted unit by unit.

A unit is a time slice and a hash bucket of the key.  A micro-batch appends a
part to the units it touches and reads those units only, so its cost follows
the batch and not the history.  A unit with ``compact_every`` parts gets a base
in their place; what the base replaced stays until the unit's next compaction,
so a batch that is run again finds what it read before.

Folders are ``slice=S/bucket=B/level=part|base/batch=N``.  Which folders a batch
sees follows from its number: the newest base before it and the parts since.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.streaming.sinks import COMPACT_EVERY

BUCKETS = 16
#: The slice of a table that is not cut by time.
WHOLE = "all"
UNIT = ("slice", "bucket")
_LAYOUT = (*UNIT, "level", "batch")


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


class UnitTable:
    """A table whose rows have ``slice`` and ``bucket``; see the module."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.every = spark, path, compact_every
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self, pattern: str) -> dict[tuple[str, int], dict[str, list[int]]]:
        """Numbers of the bases and parts of each unit that matches."""
        found: dict = defaultdict(lambda: {"base": [], "part": []})
        for status in self._fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")) or []:
            place = dict(x.split("=", 1) for x in status.getPath().toString().split("/")[-4:])
            found[place["slice"], int(place["bucket"])][place["level"]].append(int(place["batch"]))
        return found

    def _of(self, units: Iterable[tuple[str, int]] | None) -> dict[tuple[str, int], dict[str, list[int]]]:
        """Folders of ``units``, or of all there are: one listing per slice."""
        if units is None:
            return self._folders("slice=*/bucket=*/level=*/batch=*")
        units = set(units)
        by_slice = [self._folders(f"slice={s}/bucket=*/level=*/batch=*") for s in sorted({s for s, _ in units})]
        return {u: f for each in by_slice for u, f in each.items() if u in units}

    def _paths(self, unit: tuple[str, int], base: int | None, parts: Iterable[int]) -> list[str]:
        top = f"{self.path}/slice={unit[0]}/bucket={unit[1]}"
        return [f"{top}/level=base/batch={base}"] * (base is not None) + [f"{top}/level=part/batch={n}" for n in parts]

    def _live(self, folders: dict, before: int | None) -> dict[tuple[str, int], tuple[int | None, list[int]]]:
        """Newest base of each unit and the parts since, of those numbered below ``before``."""
        live = {}
        for unit, numbers in folders.items():
            seen = {k: [n for n in v if before is None or n < before] for k, v in numbers.items()}
            base = max(seen["base"], default=None)
            live[unit] = base, sorted(n for n in seen["part"] if base is None or n > base)
        return live

    def _read(self, live: dict) -> DataFrame | None:
        paths = [p for unit, (base, parts) in live.items() for p in self._paths(unit, base, parts)]
        if not paths:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*paths)
        return rows.withColumn("slice", F.col("slice").cast("string"))

    def write(self, rows: DataFrame, batch_id: int, level: str = "part") -> None:
        """Write the rows of a batch into their units; a batch that is run again writes the same folders."""
        placed = rows.withColumns({"level": F.lit(level), "batch": F.lit(batch_id).cast("long")}).hint("rebalance", *UNIT)
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*_LAYOUT).parquet(self.path)

    def units_of(self, batch_id: int) -> set[tuple[str, int]]:
        """Units that a batch has written: at most buckets times the slices it reaches."""
        return set(self._folders(f"slice=*/bucket=*/level=part/batch={batch_id}"))

    def part(self, batch_id: int) -> DataFrame | None:
        return self._read({u: (None, [batch_id]) for u in self.units_of(batch_id)})

    def before(self, batch_id: int, units: Iterable[tuple[str, int]] | None = None) -> DataFrame | None:
        """What ``units`` held before a batch; the filter on the folders is in the plan."""
        live = self._live(self._of(units), batch_id)
        rows = self._read(live)
        if rows is None or units is None:
            return rows
        return rows.filter(F.col("bucket").isin(*sorted({b for _, b in live})))

    def size(self, batch_id: int, units: Iterable[tuple[str, int]]) -> int:
        """Bytes of what ``units`` hold, the batch's own part included."""
        live = self._live(self._of(units), batch_id + 1)
        paths = [p for unit, (base, parts) in live.items() for p in self._paths(unit, base, parts)]
        return sum(self._fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(p)).getLength() for p in paths)

    def all(self) -> DataFrame | None:
        return self._read(self._live(self._of(None), None))

    def compact(self, batch_id: int, units: Iterable[tuple[str, int]], shrink: Callable[[DataFrame], DataFrame]) -> int:
        """Give each of ``units`` with enough parts a new base; how many got one.

        ``shrink`` keeps the columns and the units of its rows.
        """
        folders = self._of(units)
        live = self._live(folders, batch_id + 1)
        due = {u: x for u, x in live.items() if len(x[1]) >= self.every}
        if not due:
            return 0
        self.write(shrink(self._read(due).drop("level", "batch")), batch_id, "base")
        for unit, (base, _) in due.items():
            # Replaced by the base before this one, so no batch reads them any more.
            gone = [n for n in folders[unit]["part"] if base is not None and n <= base]
            older = [n for n in folders[unit]["base"] if base is not None and n < base]
            for path in self._paths(unit, None, gone) + [p for n in older for p in self._paths(unit, n, [])]:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return len(due)
