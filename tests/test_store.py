"""Result store, retention, refresh and lifecycle on small stores."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetpulse.limits import TimeLimitExceeded, within
from fleetpulse.operators import audit, history
from fleetpulse.sources import commits, exports, store

NOW = datetime(2024, 3, 31, 12)


def results(spark, *rows):
    full = [(i, "db", kind, status, "[]", None, NOW - age, 5) for i, (kind, status, age) in enumerate(rows)]
    return spark.createDataFrame(full, store.RESULT_SCHEMA)


def test_store_reads_one_partition(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    store.append_check_result(results(spark, ("table_bloat", "success", timedelta(0)), ("slow_queries", "error", timedelta(0))), path)
    store.append_check_result(results(spark, ("table_bloat", "error", timedelta(days=1))), path)
    assert store.read_check_results(spark, path).count() == 3
    one = store.read_check_results(spark, path, "table_bloat", "success")
    assert [r.id for r in one.collect()] == [0]
    one.explain("formatted")
    assert "PartitionFilters: [isnotnull(check_type" in capsys.readouterr().out


def test_freshness_and_grid(spark):
    df = results(
        spark,
        ("table_bloat", "success", timedelta(minutes=4)),
        ("slow_queries", "success", timedelta(minutes=5)),
        ("slow_queries", "error", timedelta(minutes=1)),
    )
    payload = {r.check_type: r for r in store.check_status_payload(df, NOW).collect()}
    assert len(payload) == 7
    assert payload["table_bloat"].fresh and not payload["slow_queries"].fresh
    assert (payload["unused_indexes"].data, payload["unused_indexes"].status) == ("[]", "pending")
    assert store.stale_checks(df, NOW).count() == 6
    counts = {r.check_type: (r.results, r.recent_24h, r.freshness) for r in store.store_counts(df, NOW).collect()}
    assert counts["slow_queries"] == (2, 2, "stale") and counts["missing_indexes"] == (0, 0, "no data")
    assert store.check_type_filter(df.withColumn("status", F.lit("odd"))).count() == 0


@pytest.mark.parametrize("cleanup, deleted", [(store.retention_cleanup, 2), (store.result_cleanup, 5)])
def test_cleanup_deletes_exactly_the_expired_rows(spark, tmp_path, cleanup, deleted):
    path = str(tmp_path / "store")
    day, edge = timedelta(days=1), timedelta(hours=1)
    df = results(
        spark,
        ("database_snapshot", "success", 100 * day),
        ("database_snapshot", "success", 90 * day + edge),
        ("database_snapshot", "success", 90 * day - edge),
        ("table_bloat", "success", 100 * day),
        ("table_bloat", "success", 30 * day + edge),
        ("table_bloat", "success", 30 * day - edge),
        ("slow_queries", "success", timedelta(0)),
    )
    store.append_check_result(df, path)
    limit = 90 if cleanup is store.retention_cleanup else 30
    condition = store.snapshot_expired(NOW) if limit == 90 else store.expired(NOW, 30)
    kept = {r.id for r in df.filter(~condition).collect()}
    split = store.retention_split(df, condition).agg(F.sum("deleted")).collect()[0][0]
    assert cleanup(spark, path, NOW) == deleted == split
    assert {r.id for r in store.read_check_results(spark, path).collect()} == kept
    assert cleanup(spark, path, NOW) == 0


def test_refresh_stores_failures_and_goes_on(spark, tmp_path):
    path = str(tmp_path / "store")
    every = spark.createDataFrame([("a",), ("b",)], "database_id string")
    failing = every.select("database_id", F.raise_error(F.lit("boom " + "x" * 2000)).alias("x"))
    report = spark.createDataFrame([("a", 2), ("a", 1)], "database_id string, `table` int")
    checks = {"table_bloat": failing, "slow_queries": report, "sequential_scans": report}
    store.refresh_all(spark, checks, path, NOW, every, max_rows=2)
    rows = {(r.check_type, r.database_id): r for r in store.read_check_results(spark, path).collect()}
    for name in ("a", "b"):
        bad = rows["table_bloat", name]
        assert bad.status == "error" and "x" * 2000 in bad.error_message and bad.result_data is None
    assert rows["slow_queries", "a"].result_data == '[{"table":1},{"table":2}]'
    assert rows["slow_queries", "b"].result_data == "[]"
    assert rows["slow_queries", "a"].execution_time_ms > 0
    assert len(rows) == len({r.id for r in rows.values()}) == 6
    # Later runs have other ids.
    store.refresh_all(spark, {"slow_queries": report}, path, NOW + timedelta(hours=1), every)
    late = store.read_check_results(spark, path).filter(F.col("executed_at") > NOW).collect()
    assert len({r.id for r in late} | {r.id for r in rows.values()}) == 8


def test_a_report_too_long_fails_for_its_database_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "database_id string")
    report = spark.createDataFrame([("a", 1), *[("b", k) for k in range(5)]], "database_id string, x int")
    assert store.refresh_all(spark, {"slow_queries": report}, path, NOW, every, max_rows=3, run="first")
    rows = {r.database_id: r for r in store.read_check_results(spark, path).collect()}
    assert (rows["a"].status, rows["a"].result_data) == ("success", '[{"x":1}]') and rows["c"].result_data == "[]"
    assert (rows["b"].status, rows["b"].result_data) == ("error", None) and "more than 3 rows" in rows["b"].error_message
    assert not store.refresh_all(spark, {"slow_queries": report}, path, NOW, every, run="first")
    assert store.read_check_results(spark, path).count() == 3


def test_slow_checks_and_queries_meet_their_limit(spark, tmp_path):
    path = str(tmp_path / "store")
    every = spark.createDataFrame([("a",)], "database_id string")
    # One task that would run for hours; the quick check beside it has the other cores.
    endless = spark.range(0, 1 << 45, 1, 1).agg(F.sum(F.hash("id")).alias("x")).withColumn("database_id", F.lit("a"))
    quick = every.withColumn("x", F.lit(1))
    started = time.monotonic()
    store.refresh_all(spark, {"table_bloat": endless, "slow_queries": quick}, path, NOW, every, seconds=4)
    rows = {r.check_type: r for r in store.read_check_results(spark, path).collect()}
    assert rows["table_bloat"].status == "error" and "exceeded the limit of 4 s" in rows["table_bloat"].error_message
    assert rows["slow_queries"].status == "success" and time.monotonic() - started < 40
    endless.createOrReplaceTempView("endless")
    with pytest.raises(TimeLimitExceeded, match="limit of 1 s"):
        audit.run_select(spark, "SELECT * FROM endless", seconds=1)
    assert audit.run_select(spark, "SELECT 1 AS one", seconds=30).collect()[0].one == 1
    assert within(spark, None, lambda: 5) == 5
    # The failed action's tag is gone: later jobs of this thread run.
    assert every.count() == 1 and not spark.sparkContext.getJobTags()


def test_run_select_looks_at_the_parsed_plan(spark, tmp_path):
    for bad in ("select 1; select 2", "update t set x = 1", "select", "selectx", "select * frm where (", "set spark.x = 1", "show tables"):
        with pytest.raises(ValueError):
            audit.run_select(spark, bad)
    few = spark.range(10)
    assert audit.run_select(spark, " SELECT * FROM {few} WHERE id IN (SELECT max(id) FROM {few})", few=few).collect()[0].id == 9


# --- commits


def committed(spark, tmp_path):
    return commits.CommittedTable(spark, str(tmp_path / "table"), ["kind", "day"]), "v bigint, kind string, day string"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), "v bigint, kind string, day string")


def test_a_repeated_append_changes_nothing(spark, tmp_path, monkeypatch):
    table, schema = committed(spark, tmp_path)
    assert table.read(schema).count() == 0
    rows = rows_of(spark, (1, "a", "2024-01-01"), (2, "b c=%/d", None))
    assert table.append(rows, "run-1") and not table.append(rows, "run-1")
    assert sorted(map(tuple, table.read(schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    # A failure behind the files and before the manifest leaves no row; the same run then succeeds.
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda new: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.append(rows_of(spark, (3, "a", "2024-01-02")), "run-2")
    assert table.read(schema).count() == 2 and (tmp_path / "table/data/run=run-2").exists()
    assert table.append(rows_of(spark, (3, "a", "2024-01-02")), "run-2") and table.read(schema).count() == 3
    assert sum(table.manifest().folders.values()) == 3
    with pytest.raises(ValueError):
        table.append(rows, "../x")


def test_a_delete_is_seen_whole(spark, tmp_path, monkeypatch):
    table, schema = committed(spark, tmp_path)
    for k in range(4):
        table.append(rows_of(spark, (k, "a", f"2024-01-0{k + 1}"), (10 + k, "a", f"2024-01-0{k + 1}")), f"run-{k}")
    before = table.manifest().version
    old, edge = (lambda v: v["day"] < "2024-01-02"), (lambda v: v["day"] == "2024-01-02")
    reader = table.read(schema)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda new: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.delete(schema, old, edge, F.col("v") < 10)
    assert table.manifest().version == before and table.read(schema).count() == 8
    assert table.delete(schema, old, edge, F.col("v") < 10) == 3
    assert sorted(r.v for r in table.read(schema).collect()) == [2, 3, 11, 12, 13]
    # Who opened the version before still reads it; its folders go some versions later.
    assert table.vacuum(timedelta(days=1)) == 0 and reader.count() == 8
    assert table.read(schema, version=before).count() == 8
    for k in range(commits.KEPT):
        table.append(rows_of(spark, (20 + k, "b", "2024-01-09")), f"late-{k}")
    assert table.vacuum(timedelta(0)) >= 2 and table.read(schema).count() == 8
    assert table.delete(schema, old, edge, F.col("v") < 10) == 0


def test_two_changes_at_once_are_both_kept(spark, tmp_path, monkeypatch):
    table, schema = committed(spark, tmp_path)
    other, _ = committed(spark, tmp_path)
    publish = table._publish

    def late(new):
        monkeypatch.setattr(table, "_publish", publish)
        assert other.append(rows_of(spark, (7, "b", "2024-01-01")), "other")
        return publish(new)

    monkeypatch.setattr(table, "_publish", late)
    assert table.append(rows_of(spark, (1, "a", "2024-01-01")), "mine")
    assert sorted(r.v for r in table.read(schema).collect()) == [1, 7] and table.manifest().runs == ["other", "mine"]


def test_lifecycle_is_the_last_step_even_at_equal_times(spark, tmp_path):
    path = str(tmp_path / "log")
    ids = spark.range(2).select(F.col("id").alias("exec_id"))
    history.append_execution(history.lifecycle_event(ids, "pending", NOW), path)
    history.append_execution(history.lifecycle_event(ids, "running", NOW), path)
    done = history.lifecycle_event(ids.filter("exec_id = 1"), "failed", NOW + timedelta(milliseconds=1500), "timeout")
    history.append_execution(done, path)
    rows = history.execution_state(history.read_executions(spark, path)).orderBy("exec_id").collect()
    assert [(r.status, r.error_message, r.duration_ms) for r in rows] == [("running", None, None), ("failed", "timeout", 1500.0)]


def test_executions_without_a_query_stay(spark):
    log = spark.createDataFrame([(1, 7), (2, None), (3, 99)], "exec_id bigint, query_id bigint")
    saved = spark.createDataFrame([(7, "q", "saved")], "id bigint, name string, category string")
    rows = history.execution_query_join(log, saved).orderBy("exec_id").collect()
    assert [(r.exec_id, r.query_id, r.query_name) for r in rows] == [(1, 7, "q"), (2, None, None), (3, 99, None)]


def test_csv_header(spark, tmp_path):
    from test_snapshots import history as snapshots

    path = str(tmp_path / "csv")
    exports.export_timeline_csv(snapshots(spark, {"a": "1"}), path)
    header = spark.read.text(path).collect()[0].value
    assert header == (
        "database_id,Date,Time,Cache Hit Rate %,Avg Query Time (ms),P95 Query Time (ms),Bloated Tables,Total Connections,"
        "Active Connections,High Seq Scan Tables,Database Size,Version"
    )
