"""The store of captures: day folders, the index of newest captures, and what a report reads."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetpulse.operators import reports
from fleetpulse.sources import telemetry
from registry.fixtures import captures

START = datetime(2024, 1, 1, 12)
ROW = "database_id string, captured_at timestamp_ntz, schemaname string, relname string, n_live_tup bigint, n_dead_tup bigint, total_bytes bigint"


def capture(spark, day, *databases, tables=3):
    rows = [
        (d, None if day is None else START + timedelta(days=day), "public", f"t{k}", 100, 50 + k, 1 << 30) for d in databases for k in range(tables)
    ]
    return spark.createDataFrame(rows, ROW)


def test_a_report_reads_the_folders_of_newest_captures(spark, tmp_path):
    path = str(tmp_path / "store")
    for day in range(6):
        telemetry.append_captures(capture(spark, day, "a", "b") if day < 3 else capture(spark, day, "a"), path)
    newest = telemetry.scan_newest(spark, "table_stats", path)
    assert {(r.database_id, r.captured_at) for r in newest.collect()} == {("a", START + timedelta(days=5)), ("b", START + timedelta(days=2))}
    bloat = reports.table_bloat(newest)
    plan = bloat._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*captured_on", plan)
    assert "dead_tuple_pct" in bloat.columns and bloat.count() == 6
    scan = next(line for line in plan.splitlines() if "captured_on" in line and "FileScan" in line)
    assert "2024-01-03" in scan and "2024-01-06" in scan and "2024-01-05" not in scan


def test_late_repeated_and_unnamed_captures(spark, tmp_path):
    path = str(tmp_path / "store")
    telemetry.append_captures(capture(spark, 4, "a"), path)
    # An older capture that arrives later, and rows without a database or a time.
    telemetry.append_captures(capture(spark, 1, "a", tables=9), path)
    telemetry.append_captures(capture(spark, 2, None).union(capture(spark, None, "c")), path)
    history = telemetry.scan_captures(spark, "table_stats", path)
    for _ in range(2):
        rows = telemetry.scan_newest(spark, "table_stats", path)
        got = sorted(map(str, rows.select("database_id", "captured_at", "relname").collect()))
        want = sorted(map(str, reports.latest_capture(history).select("database_id", "captured_at", "relname").collect()))
        assert got == want and len(got) == 9
        telemetry.compact_index(spark, path)
    index = telemetry.newest_captures(spark, path)
    assert index.count() == 3 and len(index.inputFiles()) <= 3
    assert telemetry.scan_captures(spark, "table_stats", path, "2024-01-02", "2024-01-03").count() == 12


def test_a_gone_store_is_written_anew(spark, sf_dir, tmp_path):
    first = captures(spark, sf_dir, "v_statement_history", "statement_stats")
    assert captures(spark, sf_dir, "v_statement_history", "statement_stats") == first
    fs, folder = telemetry._folder(spark, first)
    fs.delete(folder, True)
    second = captures(spark, sf_dir, "v_statement_history", "statement_stats")
    assert second != first and telemetry.scan_newest(spark, "statement_stats", second).filter(F.col("calls") > 0).count() > 0
