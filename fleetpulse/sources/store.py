"""Result store: one row per executed check, kept as Parquet.

The store is partitioned by ``check_type`` and by day, so that reading one type
prunes to its folders and retention drops whole days.  It is a committed table:
an append counts once however often it is tried, and a cleanup is seen whole.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.constants import (
    CHECK_EXPIRY,
    CHECK_STATUSES,
    CHECK_TYPES,
    MAX_ROWS,
    RESULT_RETENTION_DAYS,
    SNAPSHOT_CHECK,
    SNAPSHOT_RETENTION_DAYS,
)
from fleetpulse.limits import TimeLimitExceeded, within
from fleetpulse.operators.skew import newest
from fleetpulse.session import shared_folder
from fleetpulse.sources.commits import CommittedTable

RESULT_SCHEMA = """id bigint, database_id string, check_type string, status string, result_data string,
    error_message string, executed_at timestamp_ntz, execution_time_ms int"""


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


STORED = RESULT_SCHEMA + ", executed_on date"


def result_table(spark: SparkSession, store: str) -> CommittedTable:
    return CommittedTable(spark, store, ["check_type", "executed_on"])


def append_check_result(results: DataFrame, store: str, run: str | None = None) -> bool:
    """Append results, few files per folder; False if ``run`` was appended before.

    The rebalance puts a folder's rows together and splits a folder too large for one task.
    """
    dated = results.withColumn("executed_on", F.to_date("executed_at"))
    return result_table(results.sparkSession, store).append(dated, run)


def read_check_results(
    spark: SparkSession, store: str, check_type: str | None = None, status: str | None = None
) -> DataFrame:
    return select_results(result_table(spark, store).read(STORED), check_type, status)


def select_results(results: DataFrame, check_type: str | None = None, status: str | None = None) -> DataFrame:
    """Results of a type and status; sort by ``executed_at`` only what is shown."""
    if check_type is not None:
        results = results.filter(F.col("check_type") == check_type)
    if status is not None:
        results = results.filter(F.col("status") == status)
    return results


def check_violations(results: DataFrame) -> DataFrame:
    """Rows per invalid type or status."""
    bad_type = ~F.coalesce(F.col("check_type").isin(*CHECK_TYPES), F.lit(False))
    bad_status = ~F.coalesce(F.col("status").isin(*CHECK_STATUSES), F.lit(False))
    return (
        results.filter(bad_type | bad_status)
        .groupBy("check_type", "status")
        .agg(F.count("*").alias("rows"), F.bool_or(bad_type).alias("bad_type"), F.bool_or(bad_status).alias("bad_status"))
    )


def check_type_filter(results: DataFrame) -> DataFrame:
    return results.filter(F.col("check_type").isin(*CHECK_TYPES) & F.col("status").isin(*CHECK_STATUSES))


def latest_per_check(results: DataFrame, keys: Sequence[str] = ("database_id",)) -> DataFrame:
    """Newest successful result per database and type."""
    groups = [*keys, "check_type"]
    row = F.struct(*[F.col(c) for c in results.columns if c not in groups])
    return (
        results.filter(F.col("status") == "success")
        .groupBy(*groups)
        .agg(newest(row, F.col("executed_at"), F.col("id")).alias("_row"))
        .select(*groups, "_row.*")
    )


def _every_type() -> Column:
    return F.explode(F.array(*[F.lit(t) for t in CHECK_TYPES])).alias("check_type")


def freshness(as_of: datetime, expiry: str = CHECK_EXPIRY) -> Column:
    """True while the result is younger than ``expiry``; NULL times are not fresh."""
    bound = _moment(as_of) - F.expr(f"INTERVAL {expiry}")
    return F.coalesce(F.col("executed_at") > bound, F.lit(False))


def check_status_payload(
    results: DataFrame, as_of: datetime, expiry: str = CHECK_EXPIRY, keys: Sequence[str] = ("database_id",)
) -> DataFrame:
    """Data, status, time and freshness for every database and every check type, with defaults."""
    grid = results.select(*keys).distinct().select(*keys, _every_type())
    joined = grid.join(latest_per_check(results, keys), [*keys, "check_type"], "left")
    return joined.select(
        *keys,
        "check_type",
        F.coalesce("result_data", F.lit("[]")).alias("data"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        "executed_at",
        freshness(as_of, expiry).alias("fresh"),
    )


def stale_checks(
    results: DataFrame, as_of: datetime, expiry: str = CHECK_EXPIRY, keys: Sequence[str] = ("database_id",)
) -> DataFrame:
    """Database and type pairs whose newest success is missing or too old."""
    payload = check_status_payload(results, as_of, expiry, keys)
    return payload.filter(~F.col("fresh")).select(*keys, "check_type", F.col("executed_at").alias("last_success"))


def store_counts(results: DataFrame, as_of: datetime, expiry: str = CHECK_EXPIRY) -> DataFrame:
    """Per check type: rows, rows of the last 24 hours, newest status and ``fresh``/``stale``/``no data``."""
    success = F.col("status") == "success"
    counted = results.groupBy("check_type").agg(
        F.count("*").alias("results"),
        F.count_if(F.col("executed_at") > _moment(as_of - timedelta(hours=24))).alias("recent_24h"),
        F.max(F.when(success, F.col("executed_at"))).alias("executed_at"),
    )
    types = results.sparkSession.range(1).select(_every_type())
    joined = types.join(counted, "check_type", "left")
    known = F.col("executed_at").isNotNull()
    return joined.select(
        "check_type",
        F.coalesce("results", F.lit(0)).alias("results"),
        F.coalesce("recent_24h", F.lit(0)).alias("recent_24h"),
        F.when(known, "success").alias("latest_status"),
        F.when(~known, "no data").when(freshness(as_of, expiry), "fresh").otherwise("stale").alias("freshness"),
    )


def expired(as_of: datetime, days: int) -> Column:
    return F.col("executed_at") < _moment(as_of - timedelta(days=days))


def snapshot_expired(as_of: datetime, days: int = SNAPSHOT_RETENTION_DAYS) -> Column:
    return (F.col("check_type") == SNAPSHOT_CHECK) & expired(as_of, days)


def retention_split(results: DataFrame, condition: Column) -> DataFrame:
    """Kept and expired rows per check type under a retention ``condition``."""
    gone = F.coalesce(condition, F.lit(False))
    return results.groupBy("check_type").agg(
        F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted")
    )


def _delete_expired(spark: SparkSession, store: str, as_of: datetime, days: int, types: Sequence[str]) -> int:
    """Delete expired rows in one version: old day folders go, only the cut-off day is written anew.

    What the last versions still name stays for their readers; ``vacuum`` removes older folders.
    """
    cutoff = as_of - timedelta(days=days)
    edge = cutoff.date().isoformat()

    def before(values: dict) -> bool:
        return values["check_type"] in types and values["executed_on"] is not None and values["executed_on"] < edge

    def at_edge(values: dict) -> bool:
        return values["check_type"] in types and values["executed_on"] == edge

    table = result_table(spark, store)
    deleted = table.delete(STORED, before, at_edge, expired(as_of, days))
    table.vacuum()
    return deleted


def retention_cleanup(spark: SparkSession, store: str, as_of: datetime, days: int = SNAPSHOT_RETENTION_DAYS) -> int:
    """Delete snapshots older than ``days`` days; returns how many."""
    return _delete_expired(spark, store, as_of, days, [SNAPSHOT_CHECK])


def result_cleanup(spark: SparkSession, store: str, as_of: datetime, days: int = RESULT_RETENTION_DAYS) -> int:
    """Delete results of every type older than ``days`` days; returns how many."""
    return _delete_expired(spark, store, as_of, days, CHECK_TYPES)


def _documents(report: DataFrame, max_rows: int) -> DataFrame:
    """One JSON document per database, or a message where its report is too long.

    Rows are cut behind ``max_rows`` in every map task, so no document grows with the data.
    """
    body = [c for c in report.columns if c != "database_id"]
    rank = F.row_number().over(Window.partitionBy("database_id").orderBy(*[F.col(c) for c in body]))
    few = report.withColumn("_rank", rank).filter(F.col("_rank") <= max_rows + 1)
    document = F.to_json(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in body]))))
    too_long = F.count("*") > max_rows
    message = F.lit(f"The report has more than {max_rows} rows for this database")
    return few.groupBy("database_id").agg(
        F.when(~too_long, document).alias("result_data"), F.when(too_long, message).alias("error_message")
    )


def _run_check(
    spark: SparkSession, check_type: str, report: DataFrame, every: DataFrame, max_rows: int, seconds: float | None
) -> DataFrame:
    """Status, document and message of every database for one check, with the elapsed time."""
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "checks")
    path = shared_folder(spark, f"check-{check_type}")
    started = time.monotonic()
    try:
        within(spark, seconds, lambda: _documents(report, max_rows).write.parquet(path), f"The check {check_type}")
        found = spark.read.schema("database_id string, result_data string, error_message string").parquet(path)
        met = every.alias("e").join(found.alias("f"), F.col("e.database_id").eqNullSafe(F.col("f.database_id")), "left")
        failed = F.col("error_message").isNotNull()
        rows = met.select(
            "e.database_id",
            F.when(failed, "error").otherwise("success").alias("status"),
            F.when(~failed, F.coalesce("result_data", F.lit("[]"))).alias("result_data"),
            "error_message",
        )
    except (PySparkException, TimeLimitExceeded) as failure:
        rows = every.select(
            "database_id",
            F.lit("error").alias("status"),
            F.lit(None).cast("string").alias("result_data"),
            F.lit(str(failure)).alias("error_message"),
        )
    return rows.withColumn("execution_time_ms", F.lit(int((time.monotonic() - started) * 1000)).cast("int"))


def refresh_all(
    spark: SparkSession,
    checks: dict[str, DataFrame],
    store: str,
    as_of: datetime,
    databases: DataFrame,
    max_rows: int = MAX_ROWS,
    seconds: float | None = None,
    at_once: int = 4,
    run: str | None = None,
) -> bool:
    """Run every check and append one result row per database with status and elapsed time.

    Reports have a ``database_id``.  Each is run once into its documents while the
    clock runs, ``at_once`` of them side by side in one fair scheduler pool, and all
    results are appended to the store in one commit.  A database without rows in a
    report gets an empty document; one whose report is too long gets an error of
    its own.  A check that fails, or takes more than ``seconds``, is stored with its
    whole message for each of ``databases`` (``database_id``) and does not stop the
    others.  Ids follow from database, type and time, so a run repeated for one
    time gives the same ids; with ``run`` a repeated run appends nothing (False).
    """
    unknown = sorted(set(checks) - set(CHECK_TYPES))
    if unknown:
        raise ValueError(f"Unknown check types: {', '.join(unknown)}")
    every = databases.select("database_id").distinct()
    with ThreadPoolExecutor(at_once) as pool:
        done = {
            check_type: pool.submit(_run_check, spark, check_type, report, every, max_rows, seconds)
            for check_type, report in checks.items()
        }
    results = [
        job.result().select(
            F.xxhash64("database_id", F.lit(check_type), F.lit(as_of.isoformat())).alias("id"),
            "database_id",
            F.lit(check_type).alias("check_type"),
            "status",
            "result_data",
            "error_message",
            _moment(as_of).alias("executed_at"),
            "execution_time_ms",
        )
        for check_type, job in done.items()
    ]
    return append_check_result(reduce(DataFrame.unionByName, results), store, run)
