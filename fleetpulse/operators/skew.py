"""Per-key building blocks that never gather one key's rows in one task.

A fleet is uneven: one database or one statement may own a third of all rows.
A plain ``lag`` or ``percentile`` per key would sort or buffer that third in a
single task.  The helpers here give the same results from bounded pieces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that rows are cut into before keys are windowed; a square number.
PIECES = 1024


def newest(value: Column, *order: Column) -> Column:
    """Value of the row with the greatest ``order``; a partial aggregate, so no sort per key."""
    return F.max_by(value, F.struct(*order))


def oldest(value: Column, *order: Column) -> Column:
    return F.min_by(value, F.struct(*order))


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` newest rows of each key.

    Spark cuts each key to ``rows`` inside every map task before the shuffle
    (WindowGroupLimit), so a hot key sends only that many rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= rows).drop("_rank")


def with_even_piece(df: DataFrame, column: str, pieces: int = PIECES) -> DataFrame:
    """Add ``_piece``, the number of the piece of all rows that ``column`` lies in, NULLs in the first.

    The pieces are cut at quantiles of all rows, so each holds about ``1/pieces`` of
    them and no key can have more than that in one piece, however its rows bunch.
    Only rows that are equal in ``column`` cannot be told apart.  The cuts come as
    a scalar subquery: one mergeable sketch over a single column.
    """
    root = math.isqrt(pieces)
    shares = F.array(*[F.lit(k / root**2) for k in range(1, root**2)])
    cuts = df.agg(F.percentile_approx(column, shares, F.lit(10 * pieces)).alias("c"))
    # Every root-th cut, and the cuts between those: two short searches instead of a long one.
    tree = cuts.select(
        F.struct(
            F.transform(F.sequence(F.lit(1), F.lit(root - 1)), lambda i: F.try_element_at("c", i * root)).alias("coarse"),
            F.transform(F.sequence(F.lit(0), F.lit(root - 1)), lambda i: F.slice("c", i * root + 1, root - 1)).alias("fine"),
        ).alias("tree")
    ).scalar()

    def upto(values: Column) -> Column:
        return F.coalesce(F.size(F.filter(values, lambda cut: cut <= F.col(column))), F.lit(0))

    branch = upto(F.col("_tree.coarse"))
    piece = branch * root + upto(F.try_element_at(F.col("_tree.fine"), branch + 1))
    return df.withColumn("_tree", tree).withColumn("_piece", piece).drop("_tree")


def split_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carried: Sequence[str],
    as_name: str = "previous",
    pieces: int = PIECES,
) -> DataFrame:
    """Add ``as_name`` = struct of ``carried`` from the row before, per key in ``order``.

    The first column of ``order`` cuts all rows into even ``pieces``.  Rows are
    shuffled once, by key and piece, and the lag runs inside each piece.  The last
    row of a piece, taken from the same shuffle, is handed to the next piece that
    has rows and fills the gap at its first row, so the result equals a lag over
    the whole key.  A task sorts one piece of a key, at most ``1/pieces`` of all
    rows; a key has one row per piece in the window that hands over.  Key and
    piece travel as one struct, in which NULL equals NULL.
    """
    keys, order = list(keys), list(order)
    value = F.struct(*[F.col(c) for c in carried])
    rest = [c for c in df.columns if c not in keys]
    cut = with_even_piece(df, order[0], pieces)
    rows = cut.select(F.struct(*keys, "_piece").alias("_k"), *rest).repartition("_k")
    inside = Window.partitionBy("_k").orderBy(*order)
    lagged = rows.withColumn(as_name, F.lag(value).over(inside))

    tails = rows.groupBy("_k").agg(newest(value, *[F.col(c) for c in order]).alias("_handed"))
    history = Window.partitionBy(*[F.col(f"_k.{k}") for k in keys]).orderBy("_k._piece")
    handed = tails.select(F.lead("_k").over(history).alias("_k"), "_handed").filter(F.col("_k").isNotNull())
    return (
        lagged.join(handed, "_k", "left")
        .withColumn(as_name, F.coalesce(as_name, "_handed"))
        .select(*[F.col(f"_k.{c}").alias(c) if c in keys else F.col(c) for c in df.columns], as_name)
    )


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Add one row per key to its rows; without keys the one row comes as a scalar subquery."""
    if keys:
        left, right = rows.alias("l"), per_key.alias("r")
        same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
        added = [F.col(f"r.{c}") for c in per_key.columns if c not in keys]
        return left.join(right, same).select("l.*", *added)
    whole = per_key.select(F.struct(*[F.col(c) for c in per_key.columns]).alias("_s")).scalar()
    return rows.withColumn("_s", whole).select("*", "_s.*").drop("_s")


def merge_parts(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put aggregates that share ``keys`` side by side without joining them.

    Every part has at most one row per key, so the union is as small as the
    parts and one more aggregate lines the columns up.
    """
    keys = list(keys)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])
