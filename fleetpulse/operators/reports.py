"""Health checks and curated ranking reports over telemetry.

Reports rank within each database (``keys``) and keep its columns; with
``keys=()`` a fleet is ranked as one.  They expect current counters: reduce a
history with ``latest_capture`` first.  NULL counters sort first, and the last
sort keys are the object's names so that ties are stable.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.constants import REVIEWED_SETTINGS, SETTING_ADVICE
from fleetpulse.functions.ladders import bloat_severity
from fleetpulse.functions.numbers import round_half_up
from fleetpulse.functions.sizes import bytes_to_mb, setting_bytes, size_pretty
from fleetpulse.functions.text import qualified_name

MIB = 1024 * 1024
KEYS = ("database_id",)


def schema_filter(df: DataFrame, schema: str | None) -> DataFrame:
    return df if schema is None else df.filter(F.col("schemaname") == schema)


def _table() -> Column:
    return qualified_name(F.col("schemaname"), F.col("relname"))


def _index() -> Column:
    return qualified_name(F.col("schemaname"), F.col("indexrelname"))


def dead_share() -> Column:
    """Dead rows over all rows as an exact decimal; NULL for an empty table."""
    dead = F.col("n_dead_tup").cast("decimal(20,0)")
    return F.try_divide(dead, (F.col("n_live_tup") + F.col("n_dead_tup")).cast("decimal(20,0)"))


def dead_tuple_pct() -> Column:
    pct = F.coalesce(dead_share() * 100, F.lit(0).cast("decimal(20,0)"))
    return F.round(pct, 2).cast("double")


def is_bloated(min_share: float = 0.1, min_dead: int = 1000, min_bytes: int = MIB) -> Column:
    return (
        ((F.col("n_live_tup") + F.col("n_dead_tup")) > 0)
        & ((dead_share() > min_share) | (F.col("n_dead_tup") > min_dead))
        & (F.col("total_bytes") > min_bytes)
    )


def latest_capture(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of each database's newest capture, out of a telemetry history with ``captured_at``.

    The newest times are one row per database, joined back; no history is sorted.
    """
    left, right = df.alias("l"), df.groupBy(*keys).agg(F.max("captured_at").alias("captured_at")).alias("r")
    return left.join(right, _same((*keys, "captured_at")), "left_semi")


def _same(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names])


def _top(df: DataFrame, keys: Sequence[str], limit: int | None, *order: Column | str) -> DataFrame:
    """First ``limit`` rows in ``order`` of each key, or of all rows without keys; all rows without a limit.

    Per key, Spark cuts the rows to ``limit`` in every map task before the shuffle.
    """
    if limit is None:
        return df
    if not keys:
        return df.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def _down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def without_constraint(indexes: DataFrame, constraints: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Indexes that back no constraint of their own database, with the meaning of ``NOT IN``.

    Object ids repeat across databases, so both the anti join and the NULL rule
    go by ``keys``: in a database, one NULL constraint id removes every index, and
    an index without id goes if there is any constraint.  An anti join can be
    hashed or sorted at any size, where ``NOT IN`` would broadcast the constraints.
    """
    own = constraints.select(*keys, F.col("conindid").alias("indexrelid"))
    left, right = indexes.alias("l"), own.filter(F.col("indexrelid").isNotNull()).alias("r")
    same_id = F.col("l.indexrelid") == F.col("r.indexrelid")
    kept = left.join(right, _same(keys) & same_id if keys else same_id, "left_anti")
    facts = own.groupBy(*keys).agg(F.bool_or(F.col("indexrelid").isNull()).alias("_has_null"), F.count("*").alias("_n"))
    if keys:
        left, right = kept.alias("l"), facts.alias("r")
        known = left.join(right, _same(keys), "left").select("l.*", "_has_null", "_n")
    else:
        known = kept.withColumn("_facts", facts.select(F.struct("_has_null", "_n").alias("f")).scalar())
        known = known.select("*", "_facts._has_null", "_facts._n").drop("_facts")
    none = F.coalesce(F.col("_n"), F.lit(0)) == 0
    return known.filter(none | (~F.col("_has_null") & F.col("indexrelid").isNotNull())).drop("_has_null", "_n")


def unused_indexes(
    indexes: DataFrame,
    constraints: DataFrame,
    schema: str | None = "public",
    max_scans: int = 50,
    limit: int | None = 10,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    rare = schema_filter(indexes, schema).filter(F.col("idx_scan") < max_scans)
    free = without_constraint(rare, constraints, keys)
    return _top(free, keys, limit, _down("index_bytes"), "schemaname", "indexrelname").select(
        *keys,
        _table().alias("table"),
        F.col("indexrelname").alias("index"),
        size_pretty(F.col("index_bytes")).alias("index_size"),
        F.col("idx_scan").alias("index_scans"),
    )


def missing_indexes(
    tables: DataFrame,
    schema: str | None = "public",
    min_seq: int = 1000,
    limit: int | None = 10,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    bare = schema_filter(tables, schema).filter((F.col("seq_scan") > min_seq) & (F.col("idx_scan") == 0))
    return _top(bare, keys, limit, _down("seq_scan"), "schemaname", "relname").select(
        *keys, _table().alias("table"), "seq_scan", "idx_scan", size_pretty(F.col("total_bytes")).alias("table_size")
    )


def sequential_scans(
    tables: DataFrame,
    schema: str | None = "public",
    min_seq: int = 100,
    limit: int | None = 10,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    scanned = schema_filter(tables, schema).filter(F.col("seq_scan") > min_seq)
    return _top(scanned, keys, limit, _down("seq_scan"), "schemaname", "relname").select(
        *keys, _table().alias("table"), "seq_scan", "seq_tup_read", size_pretty(F.col("total_bytes")).alias("table_size")
    )


def slow_queries(statements: DataFrame, limit: int | None = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    return _top(statements, keys, limit, _down("total_exec_time"), "query").select(
        *keys, "query", "calls", "total_exec_time", "mean_exec_time", "rows"
    )


def table_bloat(
    tables: DataFrame, schema: str | None = "public", limit: int | None = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    bloated = schema_filter(tables, schema).filter(is_bloated()).withColumn("dead_tuple_pct", dead_tuple_pct())
    return _top(bloated, keys, limit, _down("dead_tuple_pct"), _down("n_dead_tup"), "schemaname", "relname").select(
        *keys,
        _table().alias("table_name"),
        size_pretty(F.col("total_bytes")).alias("table_size"),
        "n_dead_tup",
        "n_live_tup",
        "dead_tuple_pct",
        bytes_to_mb(F.col("total_bytes")).alias("table_mb"),
        bloat_severity(F.col("dead_tuple_pct")).alias("severity"),
        "last_vacuum",
        "last_autovacuum",
        "last_analyze",
        "last_autoanalyze",
    )


def settings_in_list(settings: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return settings.filter(F.col("name").isin(*names))


def parameter_settings(settings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reviewed settings with their advice, looked up in a literal map of six entries."""
    advice = F.create_map(*[F.lit(x) for pair in SETTING_ADVICE.items() for x in pair])
    return settings_in_list(settings, REVIEWED_SETTINGS).select(
        *keys,
        "name",
        "setting",
        "unit",
        "short_desc",
        F.try_element_at(advice, F.col("name")).alias("recommendation"),
        setting_bytes(F.col("setting"), F.col("unit")).alias("bytes"),
    )


def advice_table(settings: DataFrame) -> DataFrame:
    """The advice as a table of six rows, for joining."""
    advice = F.create_map(*[F.lit(x) for pair in SETTING_ADVICE.items() for x in pair])
    return settings.sparkSession.range(1).select(F.explode(advice).alias("name", "recommendation"))


def settings_with_advice(settings: DataFrame, advice: DataFrame) -> DataFrame:
    """Left join on the setting name; Spark broadcasts the advice when it is small enough."""
    return settings.join(advice, "name", "left")


def table_sizes(
    tables: DataFrame, schema: str | None = "public", limit: int | None = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    return _top(schema_filter(tables, schema), keys, limit, _down("total_bytes"), "relname", "schemaname").select(
        *keys, F.col("relname").alias("table_name"), F.col("total_bytes").alias("size_bytes")
    )


def table_activity(
    tables: DataFrame, schema: str | None = "public", limit: int | None = 8, keys: Sequence[str] = KEYS
) -> DataFrame:
    changed = F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")
    ranked = _top(schema_filter(tables, schema), keys, limit, changed.desc_nulls_first(), "schemaname", "relname")
    return ranked.select(
        *keys,
        _table().alias("table"),
        F.col("n_tup_ins").alias("inserts"),
        F.col("n_tup_upd").alias("updates"),
        F.col("n_tup_del").alias("deletes"),
    )


def index_usage(
    indexes: DataFrame, schema: str | None = "public", limit: int | None = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    used = schema_filter(indexes, schema).filter(F.col("idx_scan") > 0)
    return _top(used, keys, limit, _down("idx_scan"), "schemaname", "indexrelname").select(
        *keys, _index().alias("index"), F.col("idx_scan").alias("scans"), F.col("idx_tup_read").alias("tuples_read")
    )


def never_used_indexes(
    indexes: DataFrame, schema: str | None = "public", limit: int | None = 12, keys: Sequence[str] = KEYS
) -> DataFrame:
    idle = schema_filter(indexes, schema).filter(F.col("idx_scan") == 0)
    return _top(idle, keys, limit, _down("index_bytes"), "schemaname", "indexrelname").select(
        *keys,
        _index().alias("index"),
        F.col("idx_scan").alias("scans"),
        size_pretty(F.col("index_bytes")).alias("index_size"),
    )


def slowest_queries(statements: DataFrame, limit: int | None = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    return _top(statements, keys, limit, _down("mean_exec_time"), "query").select(
        *keys,
        "query",
        "calls",
        round_half_up(F.col("mean_exec_time"), 2).alias("mean_time_ms"),
        round_half_up(F.col("total_exec_time"), 2).alias("total_time_ms"),
    )


def dead_rows_report(
    tables: DataFrame, schema: str | None = "public", limit: int | None = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    dead = schema_filter(tables, schema).filter(F.col("n_dead_tup") > 0)
    return _top(dead, keys, limit, _down("n_dead_tup"), "relname", "schemaname").select(
        *keys,
        F.col("relname").alias("table"),
        F.col("n_live_tup").alias("live_rows"),
        F.col("n_dead_tup").alias("dead_rows"),
        size_pretty(F.col("total_bytes")).alias("table_size"),
    )


def health_card_counts(reports: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of items per key and report; give reports without a limit to count all there is."""
    parts = [
        df.groupBy(*keys).agg(F.count("*").alias("items")).select(*keys, F.lit(name).alias("report"), "items")
        for name, df in reports.items()
    ]
    return reduce(DataFrame.unionByName, parts)
