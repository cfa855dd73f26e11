"""Exact percentiles from one written, mergeable histogram: how often each value occurs per key.

A histogram is combined map-side and written once, so its source is read once
however many statistics follow.  Histograms of two periods or two shards add up
to that of both, and so do the sums carried along.  Ranks are found on the
histogram: running counts first over ranges of values, then inside the one range
that holds the rank, so no key's values are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators.skew import attach, merge_parts, with_even_piece
from fleetpulse.session import shared_folder


def _written(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str] = ()) -> DataFrame:
    """Write the histogram of ``value``, not NULL, per key: ``keys``, ``value``, ``copies`` and ``sums``."""
    known = df.filter(F.col(value).isNotNull())
    counted = known.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(
        F.count("*").alias("copies"), *[F.sum(c).alias(c) for c in sums]
    )
    return _written(counted, "histogram")


def merge_histograms(histograms: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The histogram of all rows behind ``histograms``, written."""
    stacked = reduce(DataFrame.unionByName, histograms)
    carried = [c for c in stacked.columns if c not in (*keys, "value", "copies")]
    return _written(stacked.groupBy(*keys, "value").agg(F.sum("copies").alias("copies"), *[F.sum(c).alias(c) for c in carried]), "histogram")


def percentiles(histogram: DataFrame, keys: Sequence[str], fractions: dict[str, float]) -> DataFrame:
    """Interpolated percentiles (``percentile_cont``) per key, a column for each of ``fractions``."""
    keys = list(keys)
    pieced = with_even_piece(histogram.select(*keys, "value", "copies"), "value")
    ranges = pieced.groupBy(*keys, "_piece").agg(F.sum("copies").alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.select(*keys, "_piece", F.sum("_n").over(upto).alias("_end"), "_n", F.sum("_n").over(whole).alias("_all"))
    start = F.col("_end") - F.col("_n")

    def ends(fraction: float) -> list[Column]:
        rank = (F.col("_all") - 1) * F.lit(float(fraction))
        return [F.floor(rank), F.ceil(rank)]

    spots = [x for fraction in fractions.values() for x in ends(fraction)]
    wanted = reduce(lambda a, b: a | b, [(start <= x) & (x < F.col("_end")) for x in spots])
    # Of each key the ranges that hold a rank, two per fraction at most.
    held = placed.filter(wanted).select(*keys, "_piece", start.alias("_before"), "_all")
    inside = attach(pieced, held, [*keys, "_piece"])
    running = Window.partitionBy(*keys, "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.sum("copies").over(running)
    valued = inside.select(*keys, "value", "_all", last.alias("_last"), (last - F.col("copies")).alias("_first"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("value")))

    columns = []
    for k, fraction in enumerate(fractions.values()):
        low, high = ends(fraction)
        part = (F.col("_all") - 1) * F.lit(float(fraction)) - low
        columns += [at(low).alias(f"_low{k}"), at(high).alias(f"_high{k}"), F.max(part).alias(f"_part{k}")]
    found = valued.groupBy(*keys).agg(*columns)
    between = [
        (F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * F.col(f"_part{k}")).alias(name) for k, name in enumerate(fractions)
    ]
    return found.select(*keys, *between)


def with_totals(histogram: DataFrame, keys: Sequence[str], totals: dict[str, Column], fractions: dict[str, float]) -> DataFrame:
    """Aggregates over the histogram's rows beside its percentiles."""
    summed = histogram.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    return merge_parts([summed, percentiles(histogram, keys, fractions)], keys)
