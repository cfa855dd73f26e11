"""Scalar functions, one case per rule."""

import pytest
from pyspark.sql import functions as F

from fleetpulse.functions import ladders, numbers, sizes, text


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize(
    "size, want",
    [
        (0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10239 * 1024 + 511, "10239 kB"),
        (10239 * 1024 + 512, "10 MB"), (10 * 1024**3, "10 GB"), (10 * 1024**4, "10 TB"), (90 * 1024**5, "92160 TB"), (None, None),
    ],
)
def test_size_pretty(spark, size, want):
    assert one(spark, size, "bigint", sizes.size_pretty) == want


@pytest.mark.parametrize(
    "value, want",
    [("16MB", 16 * 1024**2), ("1.5 gb", 1.5 * 1024**3), ("8kB", 8192), ("2TB", 2 * 1024**4), ("128", 128.0), ("-1", None), ("on", None), ("", None), (None, None)],
)
def test_parse_size_bytes(spark, value, want):
    assert one(spark, value, "string", sizes.parse_size_bytes) == want


@pytest.mark.parametrize(
    "setting, unit, want",
    [("16384", "8kB", 16384 * 8192.0), ("4096", "kB", 4096 * 1024.0), ("1", "MB", 1048576.0), ("30", "s", None), ("x", "kB", None), ("5", None, None)],
)
def test_setting_and_unit_are_multiplied_not_glued(spark, setting, unit, want):
    df = spark.createDataFrame([(setting, unit)], "s string, u string")
    assert df.select(sizes.setting_bytes(F.col("s"), F.col("u")).alias("r")).collect()[0].r == want


@pytest.mark.parametrize(
    "value, want", [("$1,234.50", 1234.5), ("50 %", 50.0), ("12", 12.0), ("-3", None), ("1.2.3", None), (".5", None), ("", None), (None, None)]
)
def test_parse_numeric_takes_no_sign(spark, value, want):
    got = one(spark, value, "string", numbers.parse_numeric)
    assert (None if got is None else float(got)) == want


@pytest.mark.parametrize("value, want", [(2.345, 2.35), (-2.345, -2.35), (1.005, 1.01), (None, None)])
def test_round_half_up(spark, value, want):
    assert one(spark, value, "double", lambda c: numbers.round_half_up(c, 2)) == want


@pytest.mark.parametrize("ms, want", [(12.346, "12.35ms"), (12.0, "12.0ms"), (999.99, "999.99ms"), (1000.0, "1.0s"), (12345.6, "12.35s"), (None, None)])
def test_format_duration(spark, ms, want):
    assert one(spark, ms, "double", numbers.format_duration) == want


@pytest.mark.parametrize("cost, want", [(12.5, "12.5"), (1000.0, "1.0K"), (123456789.0, "123456.8K")])
def test_format_cost(spark, cost, want):
    assert one(spark, cost, "double", numbers.format_cost) == want


@pytest.mark.parametrize("kb, want", [(None, "N/A"), (1000, "1,000 KB"), (1536, "1.5 MB"), (3 * 1024 * 1024, "3.0 GB")])
def test_format_memory(spark, kb, want):
    assert one(spark, kb, "bigint", numbers.format_memory) == want


def test_metric_change_from_zero(spark):
    df = spark.createDataFrame([(0.0, 5.0), (4.0, 3.0), (2.0, 2.0)], "a double, b double")
    rows = [tuple(r.m) for r in df.select(numbers.metric_change(F.col("a"), F.col("b")).alias("m")).collect()]
    assert rows == [(0.0, 5.0, 5.0, 0.0, "increase"), (4.0, 3.0, -1.0, -25.0, "decrease"), (2.0, 2.0, 0.0, 0.0, "stable")]


@pytest.mark.parametrize(
    "ms, rating, benchmark",
    [(50.0, "Excellent", "Excellent"), (50.5, "Good", "Excellent"), (100.5, "Good", "Good"), (200.5, "Fair", "Good"), (1000.5, "Slow", "Acceptable"), (10000.5, "Slow", "Very Slow"), (None, "Unknown", "")],
)
def test_bands_leave_no_gap_for_decimals(spark, ms, rating, benchmark):
    assert one(spark, ms, "double", ladders.performance_rating) == rating
    assert one(spark, ms, "double", ladders.benchmark_text) == benchmark


@pytest.mark.parametrize("ms, want", [(49.9, "excellent"), (50.0, "good"), (200.0, "fair"), (1000.0, "poor"), (None, "unknown")])
def test_performance_class(spark, ms, want):
    assert one(spark, ms, "double", ladders.performance_class) == f"performance-{want}"


@pytest.mark.parametrize(
    "name, value, category, status",
    [("cache_hit_rate", 95.0, "Memory", "good"), ("avg_query_time", 9.9, "Performance", "excellent"), ("total_connections", 3.0, "Concurrency", "neutral"), ("high_seq_scan_tables", 1.0, "Storage", "neutral"), ("wal_size_mb", 1.0, "Database", "neutral")],
)
def test_metric_category_and_status(spark, name, value, category, status):
    df = spark.createDataFrame([(name, value)], "n string, v double")
    row = df.select(ladders.metric_category(F.col("n")).alias("c"), ladders.metric_status(F.col("n"), F.col("v")).alias("s")).collect()[0]
    assert (row.c, row.s) == (category, status)


@pytest.mark.parametrize(
    "sql, allowed, reason",
    [
        (" select 1 ", True, None),
        ("SELECT updated_at FROM t", True, None),
        ("SELECT 1;", False, "Semicolons (;) are not allowed. Please use a single SELECT statement only."),
        ("SELECT * FROM (DELETE FROM t) x", False, "DELETE statements are not allowed. Only SELECT queries are permitted."),
        ("WITH x AS (SELECT 1) SELECT * FROM x", False, "Only SELECT statements are allowed"),
        ("  ", False, "Please enter a SQL query"),
        (None, False, "Please enter a SQL query"),
    ],
)
def test_read_only(spark, sql, allowed, reason):
    assert one(spark, sql, "string", text.is_read_only) is allowed
    assert one(spark, sql, "string", text.read_only_reason) == reason


def test_limit_and_normalisation(spark):
    assert one(spark, " SELECT  1\n FROM t ", "string", text.normalize_sql) == "SELECT 1 FROM t"
    assert one(spark, "SELECT 1 ", "string", text.append_limit) == "SELECT 1 LIMIT 1000"
    assert one(spark, "SELECT 1 Limit  5", "string", text.append_limit) == "SELECT 1 Limit  5"
    assert one(spark, "x" * 60, "string", lambda c: text.truncate_text(c, 50)) == "x" * 47 + "..."


def test_qualified_name_keeps_null(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "s string, t string")
    assert [r.q for r in df.select(text.qualified_name(F.col("s"), F.col("t")).alias("q")).collect()] == ["a.b", None]
