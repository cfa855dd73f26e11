"""Text helpers, including the audit of SQL statements kept in a log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.constants import (
    FORBIDDEN_KEYWORDS,
    MAX_ROWS,
    REFUSED_EMPTY,
    REFUSED_KEYWORD,
    REFUSED_SEMICOLON,
    REFUSED_START,
)

KEYWORD_PATTERN = r"(?i)\b(" + "|".join(FORBIDDEN_KEYWORDS) + r")\b"
LIMIT_PATTERN = r"(?i)limit\s+\d+"


def fill(template: str, *values: Column | str) -> Column:
    """``template`` with each ``%s`` replaced by the next value; NULL when a value is NULL."""
    pieces = template.split("%s")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def truncate_text(value: Column, length: int) -> Column:
    shortened = F.concat(F.substring(value, 1, length - 3), F.lit("..."))
    return F.when(F.length(value) > length, shortened).otherwise(value)


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def normalize_sql(sql: Column) -> Column:
    return F.regexp_replace(strip(sql), r"\s+", " ")


def is_read_only(sql: Column) -> Column:
    """One SELECT statement without a semicolon and without a writing keyword."""
    body = strip(sql)
    allowed = F.lower(body).startswith("select") & ~body.contains(";") & ~body.rlike(KEYWORD_PATTERN)
    return F.coalesce(allowed, F.lit(False))


def read_only_reason(sql: Column) -> Column:
    """Why a statement is refused; NULL when it is allowed."""
    body = strip(F.coalesce(sql, F.lit("")))
    keyword = F.upper(F.regexp_extract(body, KEYWORD_PATTERN, 1))
    return (
        F.when(body == "", REFUSED_EMPTY)
        .when(~F.lower(body).startswith("select"), REFUSED_START)
        .when(body.contains(";"), REFUSED_SEMICOLON)
        .when(keyword != "", fill(REFUSED_KEYWORD, keyword))
    )


def has_limit(sql: Column) -> Column:
    return sql.rlike(LIMIT_PATTERN)


def append_limit(sql: Column, rows: int = MAX_ROWS) -> Column:
    return F.when(has_limit(sql), sql).otherwise(F.concat(strip(sql), F.lit(f" LIMIT {rows}")))


def qualified_name(schema: Column, name: Column) -> Column:
    """``schema.name``; NULL when either part is NULL."""
    return F.concat(schema, F.lit("."), name)


def version_token(version: Column) -> Column:
    return F.split(version, " ")[0]
