"""Input schemas, readers, and the store of captures.

Each relation is a Parquet table; ``database_id`` and ``captured_at`` tell whose
counters they are and when they were taken.  The readers pass an explicit
schema (no inference pass) and leave pruning and pushdown to the scan.

A collector appends its captures with ``append_captures``: rows lie in folders
of the day they were captured, and beside them an index has one row per database
and capture.  ``scan_newest`` takes each database's newest capture from the index
and reads the folders of those days only, whatever the length of the history.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLEET = "database_id string, captured_at timestamp_ntz"

SCHEMAS = {
    "table_stats": f"""{FLEET}, schemaname string, relname string, relid bigint, seq_scan bigint,
        idx_scan bigint, seq_tup_read bigint, n_tup_ins bigint, n_tup_upd bigint, n_tup_del bigint,
        n_live_tup bigint, n_dead_tup bigint, total_bytes bigint, last_vacuum timestamp_ntz,
        last_autovacuum timestamp_ntz, last_analyze timestamp_ntz, last_autoanalyze timestamp_ntz""",
    "index_stats": f"""{FLEET}, schemaname string, relname string, indexrelname string,
        indexrelid bigint, idx_scan bigint, idx_tup_read bigint, index_bytes bigint""",
    "constraints": f"{FLEET}, conindid bigint",
    "statement_stats": f"""{FLEET}, query string, calls bigint, total_exec_time double,
        mean_exec_time double, rows bigint""",
    "settings": f"""{FLEET}, name string, setting string, unit string, short_desc string,
        context string, vartype string""",
    "io_stats": f"{FLEET}, heap_blks_hit bigint, heap_blks_read bigint",
    "activity": f"{FLEET}, pid bigint, state string",
    "extensions": f"{FLEET}, extname string",
}


def scan(spark: SparkSession, relation: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[relation]).parquet(path)


def scan_table_stats(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "table_stats", path)


def scan_index_stats(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "index_stats", path)


def scan_statement_stats(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "statement_stats", path)


def scan_settings(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "settings", path)


def scan_activity(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "activity", path)


def scan_io_stats(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "io_stats", path)


DAY = "captured_on"


def _rows_of(path: str) -> str:
    return f"{path}/rows"


def _index_of(path: str) -> str:
    return f"{path}/newest"


def append_captures(captures: DataFrame, path: str) -> None:
    """Append captures of any number of databases and times to the store of their relation.

    The index is written after the rows, so a capture is seen when it is whole.
    """
    dated = captures.withColumn(DAY, F.to_date("captured_at")).hint("rebalance", DAY)
    dated.write.mode("append").partitionBy(DAY).parquet(_rows_of(path))
    newest = captures.groupBy("database_id").agg(F.max("captured_at").alias("captured_at"))
    newest.write.mode("append").parquet(f"{_index_of(path)}/part={uuid4().hex}")


def newest_captures(spark: SparkSession, path: str) -> DataFrame:
    """database_id and time of the newest capture of each database; reads the index alone."""
    index = spark.read.schema(FLEET).parquet(f"{_index_of(path)}/part=*")
    return index.groupBy("database_id").agg(F.max("captured_at").alias("captured_at"))


def compact_index(spark: SparkSession, path: str) -> None:
    """Put the parts of the index together, one row per database; a reader meets the old parts, both, or the new one."""
    fs, folder = _folder(spark, _index_of(path))
    old = [status.getPath() for status in fs.listStatus(folder)]
    newest_captures(spark, path).write.parquet(f"{_index_of(path)}/part={uuid4().hex}")
    for part in old:
        fs.delete(part, True)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def has_captures(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, _index_of(path))
    return fs.exists(folder)


def scan_newest(spark: SparkSession, relation: str, path: str) -> DataFrame:
    """Rows of each database's newest capture.

    The days of the newest captures, few even for many databases, become a filter
    on the folders; within them a semi join with the index keeps the right captures.
    """
    newest = newest_captures(spark, path)
    days = [r[0] for r in newest.select(F.to_date("captured_at")).distinct().collect()]
    dated = spark.read.schema(f"{SCHEMAS[relation]}, {DAY} date").parquet(_rows_of(path))
    on_days = F.col(DAY).isin(*[d for d in days if d is not None])
    rows = dated.filter(on_days | F.col(DAY).isNull() if None in days else on_days).drop(DAY)
    return rows.alias("r").join(
        newest.alias("n"),
        F.col("r.database_id").eqNullSafe(F.col("n.database_id")) & F.col("r.captured_at").eqNullSafe(F.col("n.captured_at")),
        "left_semi",
    )


def scan_captures(spark: SparkSession, relation: str, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The history from day ``first`` to day ``last``, both included."""
    rows = spark.read.schema(f"{SCHEMAS[relation]}, {DAY} date").parquet(_rows_of(path))
    if first is not None:
        rows = rows.filter(F.col(DAY) >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.filter(F.col(DAY) <= F.lit(last).cast("date"))
    return rows.drop(DAY)


def scan_extensions(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, "extensions", path)


def list_extensions(extensions: DataFrame) -> DataFrame:
    """Installed component names, sorted."""
    return extensions.select("extname").distinct().orderBy("extname")
