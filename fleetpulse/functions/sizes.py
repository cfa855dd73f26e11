"""Byte sizes: pretty printing and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.constants import SIZE_TEXT, UNIT_EXPONENT


def size_pretty(size: Column) -> Column:
    """``n bytes``, then kB/MB/GB/TB; the next unit starts at 10240 of the current one."""
    text = F.when(size < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
    units = ["kB", "MB", "GB", "TB"]
    for power, unit in enumerate(units, start=1):
        halves = F.shiftright(size.cast("long"), 10 * power - 1)
        rounded = F.shiftright(halves + 1, 1)
        label = F.concat(rounded.cast("string"), F.lit(f" {unit}"))
        text = text.otherwise(label) if unit == units[-1] else text.when(rounded < 10240, label)
    return F.when(size.isNotNull(), text)


def bytes_to_mb(size: Column) -> Column:
    return F.shiftright(size.cast("long"), 20)


def _unit_bytes(unit: Column) -> Column:
    """Bytes of a size unit in upper case, NULL for anything else."""
    factor = None
    for name, exponent in UNIT_EXPONENT.items():
        value = F.lit(float(1024**exponent))
        factor = F.when(unit == name, value) if factor is None else factor.when(unit == name, value)
    return factor


def parse_size_bytes(text: Column) -> Column:
    """Bytes (double) of ``16 MB``-like text or of a plain number; otherwise NULL."""
    number = F.regexp_extract(text, SIZE_TEXT, 1)
    unit = F.upper(F.regexp_extract(text, SIZE_TEXT, 2))
    return F.when(unit != "", number.try_cast("double") * _unit_bytes(unit)).when(
        text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double")
    )


def setting_bytes(setting: Column, unit: Column) -> Column:
    """``setting`` counted in ``unit`` (``kB``, ``8kB``, ``MB``); NULL when the unit is no size."""
    pattern = r"(?i)^(\d*)(kB|MB|GB|TB)$"
    multiple = F.regexp_extract(unit, pattern, 1)
    multiple = F.when(multiple == "", F.lit(1.0)).otherwise(multiple.try_cast("double"))
    return setting.try_cast("double") * multiple * _unit_bytes(F.upper(F.regexp_extract(unit, pattern, 2)))
