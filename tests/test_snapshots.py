"""Snapshot history on hand-made snapshots."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from fleetpulse.operators import snapshots as snap

SCHEMA = """id bigint, database_id string, executed_at timestamp_ntz, execution_time_ms int, parameters map<string,string>,
    metrics map<string,double>, metadata struct<version:string,size_bytes:bigint,table_count:bigint,index_count:bigint,extensions:array<string>>"""
START = datetime(2024, 1, 1, 12)


def history(spark, *parameters, metrics=None):
    rows = []
    for i, values in enumerate(parameters):
        meta = ("16.1" if i else "15.4", 10 + i, 1, 2, ["a", "b"] if i else ["b", "c", "c"])
        rows.append((i, "db", START + timedelta(days=i), 5, values, (metrics or [{}] * len(parameters))[i], meta))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df, **options):
    rows = snap.parameter_changes(df, datetime(2024, 12, 31), 366, **options).orderBy("detected_at", "parameter").collect()
    return [(r.detected_at.day, r.parameter, r["from"], r["to"], r.change_type) for r in rows]


def test_planned_history_gives_five_events_with_nine_changes(spark):
    """Ninety-one days with changes on days 15, 30, 45, 60 and 75."""
    planned = {
        15: {"work_mem": "8MB", "shared_buffers": "256MB"},
        30: {"max_connections": "200", "random_page_cost": "1.1"},
        45: {"effective_cache_size": "6GB"},
        60: {"work_mem": "16MB", "checkpoint_completion_target": "0.9"},
        75: {"maintenance_work_mem": "128MB", "autovacuum": "off"},
    }
    now = {
        "work_mem": "4MB", "shared_buffers": "128MB", "max_connections": "100", "random_page_cost": "4.0", "effective_cache_size": "4GB",
        "checkpoint_completion_target": "0.5", "maintenance_work_mem": "64MB", "autovacuum": "on",
    }
    days = []
    for day in range(91):
        now = {**now, **planned.get(day, {})}
        days.append(now)
    df = history(spark, *days)
    found = snap.parameter_changes(df, datetime(2024, 12, 31), 366)
    assert found.count() == 9
    assert snap.change_events(found).count() == 5
    assert snap.parameter_change_count(found).collect()[0].parameter_changes == 9
    kinds = {r.parameter: r.change_type for r in found.collect()}
    assert kinds["work_mem"] == "increase" and kinds["autovacuum"] == kinds["random_page_cost"] == "change"


def test_change_rules(spark):
    df = history(
        spark,
        {"work_mem": "", "max_connections": "200", "effective_cache_size": "4GB", "wal_buffers": "16MB", "gone": "1"},
        {"max_connections": "100", "effective_cache_size": "4096MB", "wal_buffers": "-1", "new": "x", "blank": "", "work_mem": "4MB"},
    )
    expected = [
        (2, "effective_cache_size", "4GB", "4096MB", "stable"),
        (2, "max_connections", "200", "100", "decrease"),
        (2, "new", None, "x", "change"),
        (2, "wal_buffers", "16MB", "-1", "change"),
        (2, "work_mem", "", "4MB", "change"),
    ]
    assert changes(df) == expected
    assert changes(df, include_removed=True) == sorted(expected + [(2, "gone", "1", None, "change")], key=lambda r: r[1])


def test_two_snapshots_of_one_moment_are_two_events(spark):
    df = history(spark, {"a": "1"}, {"a": "2"}, {"a": "3"}).withColumn(
        "executed_at", F.when(F.col("id") == 0, F.col("executed_at")).otherwise(F.lit("2024-01-09 00:00:00").cast("timestamp_ntz"))
    )
    found = snap.parameter_changes(df, datetime(2024, 12, 31), 366)
    events = snap.change_events(found).orderBy("id").collect()
    assert [(e.id, e.changes["a"]["from"], e.changes["a"]["to"]) for e in events] == [(1, "1", "2"), (2, "2", "3")]


def test_a_snapshot_has_no_changes_to_itself(spark):
    df = history(spark, {"a": "1"}, {"a": "1"})
    assert changes(df) == []


def test_pair_needs_both_days_and_takes_the_lowest_id(spark):
    df = history(spark, {"a": "1"}, {"a": "2"}, metrics=[{"cache_hit_rate": 0.0, "avg_query_time": 4.0}, {"cache_hit_rate": 5.0}])
    later = df.filter("id = 1").withColumn("id", F.lit(9).cast("bigint")).withColumn("parameters", F.create_map(F.lit("a"), F.lit("3")))
    pair = snap.snapshot_pair_by_date(df.unionByName(later), date(2024, 1, 1), date(2024, 1, 2))
    assert [(r["from"], r["to"]) for r in snap.compare_params(pair).collect()] == [("1", "2")]
    metric = snap.compare_metrics(pair).collect()
    assert [(m.metric, m.change, m.change_percent, m.direction) for m in metric] == [("cache_hit_rate", 5.0, 0.0, "increase")]
    meta = snap.compare_metadata(pair).collect()[0]
    assert (meta.version_changed, meta.version_before, meta.version_after) == (True, "15.4", "16.1")
    assert (meta.extensions_added, meta.extensions_removed, meta.table_count_before) == (["a"], ["c"], 1)
    assert snap.snapshot_pair_by_date(df, date(2024, 1, 1), date(2024, 2, 2)).count() == 0


def test_between_dates_is_inclusive_and_pushed_down(spark, tmp_path, capsys):
    path = str(tmp_path / "s")
    history(spark, {"a": "1"}, {"a": "2"}, {"a": "3"}).write.parquet(path)
    rows = snap.between_dates(spark.read.parquet(path), date(2024, 1, 1), date(2024, 1, 2)).select("id")
    assert rows.count() == 2
    rows.explain("formatted")
    assert "GreaterThanOrEqual(executed_at" in capsys.readouterr().out
