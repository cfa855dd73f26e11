"""Streams over several batches equal the batch result; late and repeated input is handled."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetpulse.streaming import changes, sinks, snapshots, windows
from fleetpulse.streaming.state import UnitTable

START = datetime(2024, 1, 1)
READING = "database_id string, parameter string, executed_at timestamp_ntz, id bigint, setting string"


def reading(i, setting, key="work_mem", minutes=None):
    return ("db", key, START + timedelta(minutes=i if minutes is None else minutes), i, setting)


def run_changes(spark, tmp_path, batches, retention=None, **options):
    """One run of the stream per batch of readings, on the same checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, READING).coalesce(1).write.mode("append").parquet(source)
        stream = sinks.file_stream(spark, source, files_per_batch=1)
        changes.stream_parameter_changes(stream, out, f"{out}/checkpoint", retention=retention, **options).awaitTermination()
    found = changes.read_changes(spark, out).orderBy("id").collect()
    return [(r.id, r["from"], r["to"], r.change_type) for r in found], out


def test_changes_across_batches(spark, tmp_path):
    batches = [
        [reading(0, "4MB"), reading(1, "4MB"), reading(2, "8MB"), reading(3, "on", "autovacuum")],
        [reading(4, "8MB"), reading(5, "2MB"), reading(6, "off", "autovacuum")],
        [reading(7, "16MB"), reading(8, "1MB", minutes=3)],
    ]
    found, out = run_changes(spark, tmp_path, batches)
    # The late reading (8, at minute 3) comes between 2 and 4.
    assert found == [
        (2, "4MB", "8MB", "increase"), (4, "1MB", "8MB", "increase"), (5, "8MB", "2MB", "decrease"), (6, "on", "off", "change"),
        (7, "2MB", "16MB", "increase"), (8, "8MB", "1MB", "decrease"),
    ]
    state = {r.parameter: r.setting for r in changes.read_state(spark, out).collect()}
    assert state == {"work_mem": "16MB", "autovacuum": "off"}


def test_forgotten_parameters_start_anew(spark, tmp_path):
    batches = [
        [reading(0, "4MB"), reading(1, "on", "autovacuum")],
        [reading(200, "on", "autovacuum")],
        [reading(201, "8MB"), reading(202, "off", "autovacuum")],
    ]
    found, _ = run_changes(spark, tmp_path, batches, retention="1 hour")
    assert found == [(202, "on", "off", "change")]


@pytest.fixture
def event_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("database_id", F.concat(F.lit("db_"), F.col("user_id") % 3))
    events.repartitionByRange(5, "ts").write.parquet(path)
    return path


def test_windows_in_five_batches_equal_batch(spark, event_files, tmp_path):
    aggregates = {"events": F.count("*"), "total": F.sum(F.round(F.col("value") * 100).cast("bigint"))}
    stream = snapshots.stream_snapshot_windows(sinks.file_stream(spark, event_files, files_per_batch=1), aggregates, watermark="60 days")
    out = str(tmp_path / "out")
    keys = ["database_id", "period_start", "period_end"]
    sinks.start_upserts(stream, out, str(tmp_path / "checkpoint"), keys, compact_every=2).awaitTermination()
    got = sinks.read_upserts(spark, out, ["database_id", "period_start", "period_end"])
    events = spark.read.parquet(event_files)
    want = events.groupBy("database_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period_start")).agg(
        *[c.alias(n) for n, c in aggregates.items()]
    )
    columns = ["database_id", "period_start", "events", "total"]
    # Two compactions, the second of which dropped what the first had replaced.
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if "=" in p.name[:6]) == ["base=1", "base=3", "batch=2", "batch=3", "batch=4"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_latest_result_wins_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id bigint, database_id string, check_type string, status string, executed_at timestamp_ntz"
    for i, (status, minute) in enumerate([("success", 5), ("error", 9), ("success", 7), ("success", 6)]):
        row = [(i, "db", "table_bloat", status, START + timedelta(minutes=minute))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(source)
        latest = snapshots.stream_latest_per_check(sinks.file_stream(spark, source))
        sinks.start_upserts(latest, out, f"{out}-checkpoint", ["database_id", "check_type"]).awaitTermination()
    rows = sinks.read_upserts(spark, out, ["database_id", "check_type"]).collect()
    assert [(r.id, r.status) for r in rows] == [(2, "success")]


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    """Detecting a batch twice from the same state gives the same pairs."""
    state = spark.createDataFrame([reading(0, "4MB")], READING)
    batch = spark.createDataFrame([reading(1, "8MB"), reading(2, "8MB")], READING)
    runs = [sorted(map(str, changes.detect(batch, state, ["database_id"]).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and [r.id for r in changes.detect(batch, state, ["database_id"]).filter("is_change").collect()] == [1]


@pytest.mark.parametrize("compact_every,whole", [(1, 0), (3, 1 << 20), (10, 0)])
def test_any_order_of_readings_equals_batch(spark, tmp_path, monkeypatch, compact_every, whole):
    monkeypatch.setattr(changes, "SORTED_WHOLE", whole)
    rnd = random.Random(9)
    rows = [reading(i, rnd.choice(["1MB", "2MB", "4MB", ""]), rnd.choice(["work_mem", "wal_buffers"]), rnd.randrange(40)) for i in range(60)]
    rnd.shuffle(rows)
    found, out = run_changes(spark, tmp_path, [rows[k::6] for k in range(6)], compact_every=compact_every)
    want = []
    for name in ("work_mem", "wal_buffers"):
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (r[2], r[3]))
        want += [(b[3], a[4], b[4]) for a, b in zip(own, own[1:]) if a[4] != b[4]]
    assert [f[:3] for f in found] == sorted(want)


def test_lateness_bounds_the_state(spark, tmp_path):
    batches = [
        [reading(0, "1MB", minutes=60), reading(1, "2MB", minutes=240)],
        [reading(2, "4MB", minutes=120), reading(3, "8MB", minutes=180), reading(4, "9MB", minutes=300)],
    ]
    found, _ = run_changes(spark, tmp_path / "all", batches)
    assert [f[:3] for f in found] == [(1, "8MB", "2MB"), (2, "1MB", "4MB"), (3, "4MB", "8MB"), (4, "2MB", "9MB")]
    found, out = run_changes(spark, tmp_path / "some", batches, lateness="90 minutes", compact_every=1)
    assert [f[:3] for f in found] == [(1, "8MB", "2MB"), (3, "1MB", "8MB"), (4, "2MB", "9MB")]
    assert sorted(r.id for r in UnitTable(spark, f"{out}/state").all().collect()) == [1, 3, 4]


def test_batches_read_only_the_units_they_touch(spark, tmp_path):
    """Folders of other buckets and slices are not read, and a reading meets its neighbours in other slices."""
    days = [[reading(10 * d + k, f"{k}MB", f"p{k}", minutes=1440 * d + k) for k in range(6)] for d in (0, 1, 3)]
    late = [reading(100, "9MB", "p2", minutes=1440 * 2)]
    found, out = run_changes(spark, tmp_path, [*days, late], slices="yyyy-MM-dd", buckets=4)
    assert found == [(32, "9MB", "2MB", "change"), (100, "2MB", "9MB", "change")]
    state = UnitTable(spark, f"{out}/state")
    units = state.units_of(3)
    assert len(units) == 1 and len(state.units_of(0)) > 1
    rows = state.before(4, units)
    assert len(rows.inputFiles()) == 1 < len(state.all().inputFiles())
    assert "PartitionFilters: [" in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in rows.collect()] == [100]


def test_a_unit_is_compacted_alone(spark, tmp_path):
    table = UnitTable(spark, str(tmp_path / "t"), compact_every=2)
    for n in range(7):
        rows = spark.createDataFrame([("sa", n % 2, n)], "slice string, bucket int, v int").union(
            spark.createDataFrame([("sb", 0, n)], "slice string, bucket int, v int").filter(f"{n} = 0")
        )
        table.write(rows, n)
        table.compact(n, table.units_of(n), lambda x: x.groupBy("slice", "bucket").agg(F.sum("v").cast("int").alias("v")))
    folders = {str(p.relative_to(tmp_path / "t")).rsplit("/", 1)[0] for p in (tmp_path / "t").rglob("batch=*/*.parquet")}
    assert {f for f in folders if "slice=sb" in f} == {"slice=sb/bucket=0/level=part/batch=0"}
    assert {f for f in folders if "level=base" in f and "bucket=1" in f} == {"slice=sa/bucket=1/level=base/batch=3"}
    assert sum(r.v for r in table.all().collect()) == sum(range(7))
    # What a batch saw before stays readable for a second run of it.
    assert sum(r.v for r in table.before(6, {("sa", 0)}).collect()) == 0 + 2 + 4


def test_time_of_a_batch_does_not_grow(spark, tmp_path):
    """Fifty batches, each of a day of its own: the last ones take about as long as the early ones."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for d in range(50):
        rows = [reading(100 * d + k, f"{(d + k) % 3}MB", f"p{k % 20}", minutes=1440 * d + k) for k in range(60)]
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(source)
    stream = sinks.file_stream(spark, source, files_per_batch=1)
    query = changes.stream_parameter_changes(stream, out, f"{out}/checkpoint", slices="yyyy-MM-dd", buckets=2, compact_every=4)
    query.awaitTermination()
    took = [p["durationMs"]["addBatch"] for p in query.recentProgress if p["numInputRows"]]
    assert len(took) == 50
    early, late = sorted(took[5:15])[5], sorted(took[-10:])[5]
    assert late < 1.6 * early + 300, (early, late)
    want = []
    rows = spark.read.parquet(source).collect()
    for name in {r.parameter for r in rows}:
        own = sorted((r for r in rows if r.parameter == name), key=lambda r: (r.executed_at, r.id))
        want += [(b.id, a.setting, b.setting) for a, b in zip(own, own[1:]) if a.setting != b.setting]
    assert sorted((r.id, r["from"], r["to"]) for r in changes.read_changes(spark, out).collect()) == sorted(want)


def test_retention_bounds_the_state(spark, tmp_path):
    """Over ten retention periods the state keeps what the last one needs, for each key by its own clock."""
    batches = [[reading(10 * h + k, f"{h % 4}MB", f"p{k}", minutes=60 * h + k) for k in range(3 if h else 4)] for h in range(20)]
    found, out = run_changes(spark, tmp_path, batches, retention="2 hours", lateness="1 hour", compact_every=2)
    assert len(found) == 19 * 3
    sizes = {r.parameter: r["count"] for r in UnitTable(spark, f"{out}/state").all().groupBy("parameter").count().collect()}
    # At most the readings of an hour, the one before, and the parts since the last compaction.
    assert max(sizes.values()) <= 4 and sizes["p3"] == 1
    assert {r.parameter: r.id for r in changes.read_state(spark, out, retention="2 hours").collect()} == {f"p{k}": 190 + k for k in range(3)}


def test_windows_do_not_follow_the_session_zone(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT id, timestamp_ntz '2024-03-09 00:00:00' + make_dt_interval(0, id) AS ts, 'db' AS database_id FROM range(72)").coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        windows = snapshots.stream_snapshot_windows(sinks.file_stream(spark, source), {"n": F.count("*")})
        out = str(tmp_path / "out")
        sinks.start_upserts(windows, out, f"{out}-checkpoint", ["database_id", "period_start", "period_end"]).awaitTermination()
        got = sinks.read_upserts(spark, out, ["database_id", "period_start", "period_end"]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted((r.period_start, r.n) for r in got) == [(datetime(2024, 3, d), 24) for d in (9, 10, 11)]


def test_late_rows_correct_closed_windows(spark, tmp_path):
    """Rows days behind the watermark reach their windows, and the ledger has them and no others."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "database_id string, ts timestamp_ntz, v bigint"
    at = lambda day, hour: START + timedelta(days=day, hours=hour)
    batches = [
        [("a", at(0, 1), 1), ("a", at(5, 3), 2), ("b", at(5, 3), 3)],
        [("a", at(0, 2), 10), ("a", at(4, 23), 20), ("a", at(5, 1), 30), ("c", at(1, 0), 40)],
        [("a", at(6, 0), 100), ("a", at(5, 23), 200), (None, at(0, 0), 300)],
        [("a", at(5, 22), 1000), ("a", None, 2000)],
    ]
    aggregates = {"n": F.count("*"), "total": F.sum("v"), "top": F.max("v")}
    merges = {"n": "sum", "total": "sum", "top": "max"}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = sinks.file_stream(spark, source, files_per_batch=1)
        windows.stream_window_metrics(stream, out, f"{out}-checkpoint", aggregates, {"top": "max"}, compact_every=2, watermark="2 hours").awaitTermination()
    got = {(r.database_id, r.period_start.day): (r.n, r.total, r.top, r.late_rows) for r in windows.read_windows(spark, out, merges).collect()}
    assert got == {
        ("a", 1): (2, 11, 10, 1), ("a", 5): (1, 20, 20, 1), ("a", 6): (4, 1232, 1000, 0), ("a", 7): (1, 100, 100, 0),
        ("b", 6): (1, 3, 3, 0), ("c", 2): (1, 40, 40, 1), (None, 1): (1, 300, 300, 1),
    }
    ledger = sorted((r.batch, r.v) for r in windows.read_late(spark, out).collect())
    assert ledger == [(1, 10), (1, 20), (1, 40), (2, 300)]
