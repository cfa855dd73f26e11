"""Profile of any result set.

Each profile is one aggregate over the rows: all columns are measured in the
same pass and only the single result row is turned into one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.constants import CHART_MAX_ROWS, DATE_TEXT, NUMBER_TEXT, TYPE_SHARE
from fleetpulse.functions.numbers import is_numeric_text, parse_numeric
from fleetpulse.functions.text import strip, truncate_text

CELL_CLASSES = ("null-value", "empty-value", "numeric-value", "long-text", "text-value")


def _numeric(df: DataFrame, name: str) -> Column:
    """Cell as an exact decimal: numbers as they are, text through ``parse_numeric``."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("decimal(30,6)")
    return parse_numeric(F.col(name))


def _unfold(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One aggregate row with a struct per column -> one row per column."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in columns])
    return row.select(F.explode(entries).alias("e")).select("e.column", *[f"e.v.{f}" for f in fields])


def result_column_stats(result: DataFrame) -> DataFrame:
    """Rows, and sum, average, maximum and minimum of the numeric cells of every column but the first."""
    columns = result.columns[1:]

    def measure(name: str) -> Column:
        value = _numeric(result, name)
        total = F.sum(value)
        return F.struct(
            F.count("*").alias("total_rows"),
            F.count(value).alias("numeric_cells"),
            F.round(total, 2).cast("double").alias("sum"),
            F.round(F.try_divide(total, F.count(value)), 2).cast("double").alias("avg"),
            F.max(value).cast("double").alias("max"),
            F.min(value).cast("double").alias("min"),
        ).alias(name)

    fields = ["total_rows", "numeric_cells", "sum", "avg", "max", "min"]
    row = result.agg(*[measure(c) for c in columns])
    out = _unfold(row, columns, fields).filter(F.col("numeric_cells") > 0)
    return out.withColumn("columns", F.lit(len(result.columns)).cast("long"))


def cell_class(df: DataFrame, name: str) -> Column:
    text = F.col(name).cast("string")
    number = F.lit(isinstance(df.schema[name].dataType, T.NumericType)) | is_numeric_text(text)
    return (
        F.when(text.isNull(), CELL_CLASSES[0])
        .when(strip(text) == "", CELL_CLASSES[1])
        .when(number, CELL_CLASSES[2])
        .when(F.length(text) > 50, CELL_CLASSES[3])
        .otherwise(CELL_CLASSES[4])
    )


def cell_class_profile(result: DataFrame) -> DataFrame:
    """Number of cells per column and class."""

    def measure(name: str) -> Column:
        kind = cell_class(result, name)
        return F.array(
            *[F.struct(F.lit(c).alias("cell_class"), F.count_if(kind == c).alias("cells")) for c in CELL_CLASSES]
        ).alias(name)

    row = result.agg(*[measure(c) for c in result.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in result.columns])
    return (
        row.select(F.explode(entries).alias("e"))
        .select("e.column", F.inline("e.v"))
        .filter(F.col("cells") > 0)
    )


def infer_column_type(result: DataFrame, share: float = TYPE_SHARE) -> DataFrame:
    """Type of each column from all its cells, in one aggregate.

    More than ``share`` of numbers make a number column, of ISO dates a date column.
    """

    def measure(name: str) -> Column:
        text = strip(F.col(name).cast("string"))
        number = text.rlike(NUMBER_TEXT)
        day = text.rlike(DATE_TEXT)
        part = [F.try_divide(F.count_if(hit), F.count("*")) for hit in (number, ~number & day)]
        return F.when(part[0] > share, "number").when(part[1] > share, "date").otherwise("text").alias(name)

    row = result.agg(*[measure(c) for c in result.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("inferred_type")) for c in result.columns])
    return row.select(F.inline(entries))


def chart_series(result: DataFrame, label: str | None = None, value: str | None = None) -> DataFrame:
    """Label, its short form for an axis, and value of the first two columns; rows without a number are dropped."""
    label = label or result.columns[0]
    value = value or result.columns[1]
    text = F.coalesce(F.col(label).cast("string"), F.lit(""))
    return result.select(
        text.alias("label"),
        truncate_text(text, 30).alias("short_label"),
        _numeric(result, value).cast("double").alias("value"),
    ).filter(F.col("value").isNotNull())


def chart_eligible(result: DataFrame, max_rows: int = CHART_MAX_ROWS) -> DataFrame:
    """Whether a result can be charted: 2 to 4 columns, 1 to ``max_rows`` rows, some number."""
    number = F.lit(False)
    for name in result.columns:
        cell = F.lit(isinstance(result.schema[name].dataType, T.NumericType)) & F.col(name).isNotNull()
        number = number | cell | F.coalesce(is_numeric_text(F.col(name).cast("string")), F.lit(False))
    shape = F.lit(2 <= len(result.columns) <= 4)
    row = result.agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(number), F.lit(False)).alias("has_number"))
    return row.select(
        "rows",
        F.lit(len(result.columns)).cast("long").alias("columns"),
        "has_number",
        (shape & (F.col("rows") > 0) & (F.col("rows") <= max_rows) & F.col("has_number")).alias("eligible"),
    )


def result_to_document(result: DataFrame) -> DataFrame:
    """Rows as JSON documents beside the schema, one row each; never one big document."""
    return result.select(
        F.to_json(F.struct(*[F.col(c) for c in result.columns]), {"ignoreNullFields": "false"}).alias("row"),
        F.lit(result.schema.json()).alias("column_types"),
    )
