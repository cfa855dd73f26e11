"""The skew-safe building blocks against plain windows and percentiles on uneven keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetpulse.operators import metrics
from fleetpulse.operators.histogram import merge_histograms, percentiles, value_counts
from fleetpulse.operators.skew import merge_parts, newest_rows, split_lag, with_even_piece

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def uneven(spark):
    """Three keys, one NULL; the hot one has a third of the rows, with gaps of months and equal times."""
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{rnd.randrange(40)}")
        day = rnd.choice([0, 1, 2, 40, 41, 200, 201, 202, 380])
        value = None if i % 50 == 0 else rnd.choice([rnd.random() * 100, float(rnd.randrange(5))])
        rows.append((i, key, START + timedelta(days=day, hours=rnd.randrange(6)), value))
    return spark.createDataFrame(rows, "id bigint, k string, at timestamp_ntz, value double").cache()


@pytest.mark.parametrize("pieces", [4, 64, 1024])
def test_split_lag_equals_lag(uneven, pieces):
    window = Window.partitionBy("k").orderBy("at", "id")
    plain = uneven.select("id", F.lag("id").over(window).alias("want"))
    split = split_lag(uneven, ["k"], ["at", "id"], ["id", "value"], pieces=pieces)
    both = split.join(plain, "id")
    assert both.count() == uneven.count()
    assert both.filter(~F.col("previous.id").eqNullSafe(F.col("want"))).count() == 0


def test_split_lag_shares_one_shuffle(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    out = split_lag(events, ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_in_one_hour_is_split(spark):
    """A third of all rows is one key within one hour; no piece of it holds more than a few."""
    rows = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 1000) END AS k",
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CASE WHEN id % 3 = 0 THEN id % 3600 ELSE id * 997 END) AS at",
        "id",
        "CAST(hash(id) AS double) AS v",
    )
    for column, limit in (("at", 40), ("v", 40)):
        sizes = with_even_piece(rows, column).filter("k = 'hot'").groupBy("_piece").count().agg(F.max("count"), F.count("*")).first()
        assert sizes[0] <= limit and sizes[1] > 300
    window = Window.partitionBy("k").orderBy("at", "id")
    plain = rows.select("id", F.lag("id").over(window).alias("want"))
    both = split_lag(rows, ["k"], ["at", "id"], ["id"]).join(plain, "id")
    assert both.filter(~F.col("previous.id").eqNullSafe(F.col("want"))).count() == 0


def test_pieces_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], "k string, at timestamp_ntz, id long")
    assert split_lag(none, ["k"], ["at", "id"], ["id"]).count() == 0
    nulls = spark.createDataFrame([("x", None, 1), ("x", None, 2), (None, None, 3)], "k string, at timestamp_ntz, id long")
    got = {r.id: r.previous.id if r.previous else None for r in split_lag(nulls, ["k"], ["at", "id"], ["id"]).collect()}
    assert got == {1: None, 2: 1, 3: None}


FRACTIONS = {f"p{k}": f for k, f in enumerate([0.0, 0.05, 0.5, 0.95, 0.999, 1.0])}


def plain_percentiles(rows, keys):
    return rows.groupBy(*keys).agg(*[F.expr(f"percentile(value, {f}D)").alias(n) for n, f in FRACTIONS.items()])


def values(df, keys):
    return {tuple(r[k] for k in keys): [r[n] for n in FRACTIONS] for r in df.collect()}


@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_of_a_histogram(uneven, keys):
    got = values(percentiles(value_counts(uneven, keys, "value"), keys, FRACTIONS), keys)
    want = values(plain_percentiles(uneven, keys), keys)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_histograms_of_two_periods_add_up(uneven):
    first, second = uneven.filter("id % 4 = 0"), uneven.filter("id % 4 <> 0")
    both = merge_histograms([value_counts(x, ["k"], "value", ["id"]) for x in (first, second)], ["k"])
    got, want = values(percentiles(both, ["k"], FRACTIONS), ["k"]), values(plain_percentiles(uneven, ["k"]), ["k"])
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert both.agg(F.sum("copies")).first()[0] == uneven.filter("value IS NOT NULL").count()
    assert both.agg(F.sum("id")).first()[0] == uneven.filter("value IS NOT NULL").agg(F.sum("id")).first()[0]


def test_a_summary_reads_its_source_once(spark, uneven, tmp_path):
    """The plan has no scan of the source: it was read when the histogram was written."""
    path = str(tmp_path / "statements")
    uneven.selectExpr("k", "value AS mean_exec_time", "id AS calls").write.parquet(path)
    rows = spark.read.parquet(path)
    summary = metrics.statement_summary(rows, ["k"])
    assert path not in summary._jdf.queryExecution().executedPlan().toString() and not set(rows.inputFiles()) & set(summary.inputFiles())
    halves = [metrics.statement_histogram(rows.filter(f"calls % 2 = {n}"), ["k"]) for n in (0, 1)]
    merged = metrics.summary_of_histogram(merge_histograms(halves, ["k"]), ["k"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, summary.collect()))
    nothing = metrics.statement_summary(rows.limit(0), []).first()
    assert (nothing.total_queries, nothing.p95_query_time) == (0, None)


def test_newest_rows_cuts_before_the_shuffle(uneven):
    out = newest_rows(uneven, ["k"], ["at", "id"], 4)
    assert max(r["count"] for r in out.groupBy("k").count().collect()) == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange")


def test_merge_parts_keeps_every_key(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, a int")
    b = spark.createDataFrame([("y", 3), (None, 4)], "k string, b int")
    rows = {(r.k, r.a, r.b) for r in merge_parts([a, b], ["k"]).collect()}
    assert rows == {("x", 1, None), ("y", 2, 3), (None, None, 4)}
