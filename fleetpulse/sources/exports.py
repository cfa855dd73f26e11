"""Timeline exports: a flat CSV table, nested JSON lines, and a document per database."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.constants import SNAPSHOT_RETENTION_DAYS
from fleetpulse.operators.skew import merge_parts, newest_rows
from fleetpulse.operators.snapshots import DATABASE, timeline_rows

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def export_timeline_csv(snapshots: DataFrame, path: str, keys: Sequence[str] = DATABASE) -> None:
    """Flat export with a header row; many snapshots give many part files."""
    timeline_rows(snapshots, keys).write.mode("errorifexists").option("header", True).csv(path)


def snapshot_documents(snapshots: DataFrame, keys: Sequence[str] = DATABASE) -> DataFrame:
    return snapshots.select(
        *keys,
        "id",
        F.date_format("executed_at", ISO).alias("collected_at"),
        "execution_time_ms",
        "parameters",
        "metrics",
        "metadata",
    )


def export_info(
    snapshots: DataFrame,
    exported_at: datetime,
    frequency: str = "1 day",
    retention_days: int = SNAPSHOT_RETENTION_DAYS,
    keys: Sequence[str] = DATABASE,
) -> DataFrame:
    return snapshots.groupBy(*keys).agg(
        F.count("*").alias("snapshot_count"),
        F.struct(
            F.date_format(F.min("executed_at"), ISO).alias("from"), F.date_format(F.max("executed_at"), ISO).alias("to")
        ).alias("date_range"),
    ).select(
        *keys,
        F.lit(exported_at.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("exported_at"),
        "snapshot_count",
        "date_range",
        F.lit(frequency).alias("frequency"),
        F.lit(retention_days).alias("retention_days"),
    )


def export_timeline_json(
    snapshots: DataFrame, changes: DataFrame, path: str, exported_at: datetime, keys: Sequence[str] = DATABASE
) -> None:
    """JSON lines in three folders: ``info`` per database, ``parameter_changes`` and ``snapshots``.

    The parts stay separate tables so that no document grows with the history.
    """
    export_info(snapshots, exported_at, keys=keys).write.json(f"{path}/info")
    changes.withColumn("detected_at", F.date_format("detected_at", ISO)).write.json(f"{path}/parameter_changes")
    snapshot_documents(snapshots, keys).write.json(f"{path}/snapshots")


#: Layout of the three folders of a JSON export, without the keys.
EXPORT_SCHEMAS = {
    "info": "exported_at string, snapshot_count bigint, date_range struct<`from`:string,`to`:string>, frequency string, retention_days int",
    "parameter_changes": "detected_at string, id bigint, parameter string, `from` string, `to` string, change_type string",
    "snapshots": """id bigint, collected_at string, execution_time_ms bigint, parameters map<string,string>,
        metrics map<string,double>, metadata struct<version:string,size_bytes:bigint,table_count:bigint,index_count:bigint,extensions:array<string>>""",
}


def read_timeline_json(spark: SparkSession, path: str, part: str, keys: Sequence[str] = DATABASE) -> DataFrame:
    """One of the three parts of a JSON export."""
    named = ", ".join(f"{k} string" for k in keys)
    return spark.read.schema(f"{named}, {EXPORT_SCHEMAS[part]}").json(f"{path}/{part}")


def export_documents(
    spark: SparkSession, path: str, limit: int = SNAPSHOT_RETENTION_DAYS, keys: Sequence[str] = DATABASE
) -> DataFrame:
    """An export put together again: per database one JSON document of its info, and of its ``limit`` newest
    snapshots, newest first, with the changes they brought.

    The limit bounds a document; ``info`` counts all snapshots of the export.
    """
    snapshots = newest_rows(read_timeline_json(spark, path, "snapshots", keys), list(keys), ["collected_at", "id"], limit)
    changes = read_timeline_json(spark, path, "parameter_changes", keys)
    told = changes.alias("c").join(
        snapshots.select(*keys, "id").alias("s"),
        reduce(lambda a, b: a & b, [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "id")]),
        "left_semi",
    )

    def listed(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
        body = [c for c in rows.columns if c not in keys and c not in order]
        row = F.struct(*[F.col(c) for c in (*order, *body)])
        # Maps cannot be compared, so the row travels as text behind its order.
        pair = F.struct(*[F.col(c) for c in order], F.to_json(row).alias("_text"))
        return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(pair), asc=False), lambda x: x["_text"]).alias(name))

    info = read_timeline_json(spark, path, "info", keys)
    text = F.to_json(F.struct(*[F.col(c) for c in info.columns if c not in keys]))
    parts = [
        info.select(*keys, text.alias("info")),
        listed(told, "changes", ["detected_at", "id", "parameter"]),
        listed(snapshots, "snapshots", ["collected_at", "id"]),
    ]

    def array(name: str) -> Column:
        return F.concat(F.lit("["), F.coalesce(F.array_join(name, ","), F.lit("")), F.lit("]"))

    whole = F.concat(
        F.lit('{"export_info":'), "info", F.lit(',"parameter_changes":'), array("changes"), F.lit(',"snapshots":'), array("snapshots"), F.lit("}")
    )
    return merge_parts(parts, keys).select(*keys, whole.alias("document"))
