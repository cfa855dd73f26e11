"""Rounding, coercion and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^\d+(\.\d+)?$"


def round_half_up(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal digits, back to double."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def plain_number(value: Column, digits: int) -> Column:
    """Rounded number as text without exponent, at least one decimal digit kept."""
    text = F.round(value.cast("decimal(28,10)"), digits).cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def is_numeric_text(value: Column) -> Column:
    return value.rlike(PLAIN_NUMBER)


def parse_numeric(value: Column) -> Column:
    """Number in a cell of text: ``, $ %`` and blanks are dropped, signs are not accepted."""
    cleaned = F.regexp_replace(value.cast("string"), r"[,$\s%]", "")
    return F.when(cleaned.rlike(PLAIN_NUMBER), cleaned.try_cast("decimal(30,6)"))


def metric_change(before: Column, after: Column) -> Column:
    """struct(before, after, change, change_percent, direction) of one metric."""
    before, after = before.cast("double"), after.cast("double")
    change = after - before
    percent = F.when(before != 0, ratio(change, before) * 100).otherwise(F.lit(0.0))
    return F.struct(
        before.alias("before"),
        after.alias("after"),
        round_half_up(change, 2).alias("change"),
        round_half_up(percent, 2).alias("change_percent"),
        F.when(change > 0, "increase").when(change < 0, "decrease").otherwise("stable").alias("direction"),
    )


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(plain_number(ms, 2), F.lit("ms"))).otherwise(
        F.concat(plain_number(ms / 1000, 2), F.lit("s"))
    )


def format_cost(cost: Column) -> Column:
    return F.when(cost < 1000, plain_number(cost, 2)).otherwise(
        F.concat(plain_number(cost / 1000, 1), F.lit("K"))
    )


def format_memory(kb: Column) -> Column:
    return (
        F.when(kb.isNull(), "N/A")
        .when(kb >= 1024 * 1024, F.concat(plain_number(kb / (1024.0 * 1024), 1), F.lit(" GB")))
        .when(kb >= 1024, F.concat(plain_number(kb / 1024.0, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(kb, 0), F.lit(" KB")))
    )


def timing_percentage(part_ms: Column, total_ms: Column) -> Column:
    share = F.round((ratio(part_ms, total_ms) * 100).cast("decimal(28,10)"), 0).cast("long")
    return F.when(part_ms.isNotNull() & (total_ms > 0), F.least(share, F.lit(100))).otherwise(F.lit(0)).cast("long")


def duration_ms(started: Column, completed: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", started, completed)
    return round_half_up(micros / 1000.0, 3)
