"""Report rules on hand-made telemetry."""

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import audit, metrics, profile, reports
from fleetpulse.sources import telemetry

TABLE = "schemaname string, relname string, seq_scan bigint, idx_scan bigint, seq_tup_read bigint, n_live_tup bigint, n_dead_tup bigint, total_bytes bigint"


def tables(spark, *rows):
    df = spark.createDataFrame([("public", *r) for r in rows], TABLE)
    return df.withColumn("database_id", F.lit("db"))


def test_missing_indexes_drops_tables_without_any_index(spark):
    df = tables(spark, ("a", 2000, 0, 0, 1, 0, 1), ("b", 3000, None, 0, 1, 0, 1), ("c", 1000, 0, 0, 1, 0, 1))
    assert [r.table for r in reports.missing_indexes(df).collect()] == ["public.a"]


def test_null_counters_rank_first(spark):
    df = tables(spark, ("a", 5, 0, 0, 1, 0, 10), ("b", 5, 0, 0, 1, 0, None), ("c", 5, 0, 0, 1, 0, 99))
    assert [r.table_name for r in reports.table_sizes(df).collect()] == ["b", "c", "a"]


def test_bloat_report_and_summary_use_different_rules(spark):
    mib = 2**20
    df = tables(
        spark,
        ("share", 0, 0, 0, 89, 11, 2 * mib),
        ("at_share", 0, 0, 0, 90, 10, 2 * mib),
        ("many", 0, 0, 0, 10**6, 1001, 2 * mib),
        ("small", 0, 0, 0, 1, 99, mib),
        ("empty", 0, 0, 0, 0, 0, 2 * mib),
    )
    rows = reports.table_bloat(df.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze")})).collect()
    assert [(r.table_name, r.dead_tuple_pct, r.table_mb) for r in rows] == [("public.share", 11.0, 2), ("public.many", 0.1, 2)]
    summary = metrics.bloat_summary(df).collect()[0]
    assert (summary.bloated_tables, summary.avg_bloat_pct) == (2, 55.0)


@pytest.mark.parametrize(
    "ids, constraints, kept",
    [([1, 2, None], [2], [1]), ([1, 2, None], [2, None], []), ([1, 2, None], [], [1, 2, None])],
)
def test_anti_join_has_not_in_meaning(spark, ids, constraints, kept):
    ix = spark.createDataFrame([(i,) for i in ids], "indexrelid bigint")
    con = spark.createDataFrame([(i,) for i in constraints], "conindid bigint")
    ix.createOrReplaceTempView("ix_ids")
    con.createOrReplaceTempView("con_ids")
    got = sorted((r.indexrelid for r in reports.without_constraint(ix, con, keys=()).collect()), key=str)
    want = spark.sql("SELECT indexrelid FROM ix_ids WHERE indexrelid NOT IN (SELECT conindid FROM con_ids)")
    assert got == sorted((r.indexrelid for r in want.collect()), key=str) == sorted(kept, key=str)


def test_hit_rate_of_nothing_is_zero(spark):
    io = spark.createDataFrame([(0, 0)], "heap_blks_hit bigint, heap_blks_read bigint")
    assert metrics.cache_hit_rate(io).collect()[0].cache_hit_rate == 0.0


def test_settings_map_joins_setting_and_unit_once(spark):
    df = spark.createDataFrame(
        [("d", "work_mem", "4096", "kB"), ("d", "work_mem", "4096", "kB"), ("d", "autovacuum", "on", None), ("d", "port", "1", None)],
        "database_id string, name string, setting string, unit string",
    )
    assert metrics.settings_to_map(df, ["database_id"]).collect()[0].parameters == {"autovacuum": "on", "work_mem": "4096kB"}


def test_scan_reads_only_what_is_asked(spark, tmp_path, capsys):
    schema = telemetry.SCHEMAS["table_stats"]
    path = str(tmp_path / "table_stats")
    spark.createDataFrame([], schema).write.parquet(path)
    top = reports.missing_indexes(telemetry.scan_table_stats(spark, path), keys=())
    top.explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThan(seq_scan,1000)" in plan and "EqualTo(schemaname,public)" in plan
    read = plan[plan.index("ReadSchema") :]
    assert "n_tup_ins" not in read and "last_vacuum" not in read
    for relation in telemetry.SCHEMAS:
        assert telemetry.scan(spark, relation, path).columns[0] == "database_id"


def test_run_select_refuses_and_caps(spark):
    assert audit.run_select(spark, "SELECT id FROM range(50)", 7).count() == 7
    for sql in ("DROP TABLE t", "SELECT 1; SELECT 2", "SELECT * FROM t WHERE x IN (delete from y)"):
        with pytest.raises(ValueError):
            audit.run_select(spark, sql)


def test_type_inference_accepts_negatives_and_needs_more_than_seventy_percent(spark):
    rows = [(i, "-1.5" if i >= 5 else "x", "-2" if i >= 6 else "x", "2024-01-05 10:00", None) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string, d string")
    got = {r.column: r.inferred_type for r in profile.infer_column_type(df).collect()}
    assert got == {"id": "number", "a": "number", "b": "text", "c": "date", "d": "text"}


def test_reports_rank_each_database_and_its_last_capture(spark):
    rows = [(d, c, f"t{k}", 2000 + k) for d in ("x", "y") for c in (1, 2) for k in range(20) if (c, k) != (2, 19)]
    rows += [("x", 2, "t18", 5000), ("z", 1, "only", 3000)]
    df = spark.createDataFrame(rows, "database_id string, c int, relname string, seq_scan long").selectExpr(
        "*", "'public' AS schemaname", "0L AS idx_scan", "1L AS total_bytes", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(c) AS captured_at"
    )
    got = reports.missing_indexes(reports.latest_capture(df), limit=2).collect()
    assert sorted((r.database_id, r.table, r.seq_scan) for r in got) == [
        ("x", "public.t18", 2018), ("x", "public.t18", 5000), ("y", "public.t17", 2017), ("y", "public.t18", 2018), ("z", "public.only", 3000),
    ]


def test_constraints_count_in_their_own_database_only(spark):
    ix = spark.createDataFrame([(d, i) for d in ("a", "b", "c") for i in (1, 2)] + [(None, 1)], "database_id string, indexrelid long")
    con = spark.createDataFrame([("a", 1), ("b", None), ("b", 1)], "database_id string, conindid long")
    got = sorted(((r.database_id, r.indexrelid) for r in reports.without_constraint(ix, con).collect()), key=str)
    assert got == [("a", 2), ("c", 1), ("c", 2), (None, 1)]


def test_chart_rules(spark):
    two = spark.createDataFrame([("a", "1"), ("b", None)], "l string, v string")
    assert profile.chart_eligible(two).collect()[0].eligible
    assert not profile.chart_eligible(two.select("l")).collect()[0].eligible
    assert not profile.chart_eligible(spark.range(51).selectExpr("id", "id AS v")).collect()[0].eligible
    assert not profile.chart_eligible(two.filter("false")).collect()[0].eligible
    series = profile.chart_series(two).collect()
    assert [(r.label, r.value) for r in series] == [("a", 1.0)]
    long = profile.chart_series(spark.createDataFrame([("x" * 40, 1)], "l string, v int")).collect()
    assert [(r.label, len(r.short_label)) for r in long] == [("x" * 40, 30)]
