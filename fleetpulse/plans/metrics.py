"""Per-execution metrics, issues and summaries from the node array of ``with_nodes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import constants as fixed
from fleetpulse.functions.numbers import plain_number
from fleetpulse.functions.text import fill
from fleetpulse.plans.tree import BUFFER_FIELDS, root

#: Node fields that ``plan_metrics``, ``with_issues`` and ``plan_summary`` read.
METRIC_FIELDS = (
    "node_type", "total_cost", "actual_rows", "join_type", "index_name", "sort_method", "peak_memory", "workers_planned",
    "workers_launched",
)
ISSUE_FIELDS = ("node_type", "relation_name", "actual_time", "actual_rows", "temp_written_blocks")
SUMMARY_FIELDS = ("node_type", "relation_name", "total_cost", "actual_rows", "actual_time")

METRIC_COLUMNS = (
    "rows_returned",
    "rows_scanned",
    "total_rows",
    "workers_planned",
    "workers_launched",
    "memory_usage_kb",
    "sort_methods",
    "index_usage",
    "node_count",
    "max_level",
    "join_types",
    "scan_types",
    "seq_scan_present",
)


def _sum(field: Column) -> Column:
    return F.aggregate(field, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _largest(field: str) -> Column:
    return F.coalesce(F.array_max(F.transform("nodes", lambda n: n[field])), F.lit(0))


def _distinct(values: Column) -> Column:
    """Distinct known values in pre-order of first appearance."""
    return F.array_distinct(F.array_compact(values))


def _is_scan(n: Column) -> Column:
    return F.coalesce(n["node_type"].contains("Scan"), F.lit(False))


def join_types(include_nested_loop: bool = False) -> Column:
    """Join nodes by name, with their join type in front; nested loops only when asked for."""

    def label(n: Column) -> Column:
        known = n["node_type"].contains("Join")
        if include_nested_loop:
            known = known | (n["node_type"] == "Nested Loop")
        return F.when(known, F.concat_ws(" ", n["join_type"], n["node_type"]))

    return _distinct(F.transform("nodes", label))


def plan_metrics(df: DataFrame) -> DataFrame:
    """Add the plan metrics and times to rows of ``with_nodes``; rows without a plan get NULLs."""
    scans = F.filter("nodes", _is_scan)
    top = root()
    total = F.coalesce(F.col("planning_time"), F.lit(0.0)) + F.coalesce(F.col("execution_time"), F.lit(0.0))
    has = F.col("plan_state") == "ok"
    measured = F.col("measured_ms") if "measured_ms" in df.columns else F.lit(None).cast("double")
    rows_returned = F.when(has, top["actual_rows"])
    out = df.select(
        "*",
        F.col("planning_time").alias("planning_time_ms"),
        F.col("execution_time").alias("execution_time_ms"),
        F.coalesce(F.when(has, total), measured).alias("total_time_ms"),
        top["total_cost"].alias("query_cost"),
        rows_returned.alias("rows_returned"),
        F.when(has, _sum(F.transform(scans, lambda n: n["actual_rows"]))).alias("rows_scanned"),
        F.when(has, _sum(F.transform("nodes", lambda n: n["actual_rows"]))).alias("total_rows"),
        F.when(has, _largest("workers_planned")).alias("workers_planned"),
        F.when(has, _largest("workers_launched")).alias("workers_launched"),
        F.when(has, _largest("peak_memory")).alias("memory_usage_kb"),
        _distinct(F.transform("nodes", lambda n: n["sort_method"])).alias("sort_methods"),
        _distinct(F.transform("nodes", lambda n: n["index_name"])).alias("index_usage"),
        F.when(has, F.size("nodes").cast("long")).alias("node_count"),
        F.when(has, F.array_max(F.transform("nodes", lambda n: n["level"]))).alias("max_level"),
        join_types().alias("join_types"),
        _distinct(F.transform(scans, lambda n: n["node_type"])).alias("scan_types"),
        F.when(
            has, F.exists("nodes", lambda n: F.coalesce(n["node_type"].contains("Seq Scan"), F.lit(False)))
        ).alias("seq_scan_present"),
    )
    if "result_rows_count" in df.columns:
        out = out.withColumn("rows_returned", F.when(has, F.col("rows_returned")).otherwise(F.col("result_rows_count")))
    return out


def depth_estimate() -> Column:
    """Depth guessed from the node count, as the comparison view shows it."""
    return F.when(F.col("node_count") > 0, F.ceil(F.log2("node_count")))


def plan_summary() -> Column:
    """``Type on relation (cost=..) rows=.. time=..ms`` of the root node."""
    top = root()
    return F.when(
        F.col("plan_state") == "ok",
        F.concat_ws(
            " ",
            top["node_type"],
            F.concat(F.lit("on "), top["relation_name"]),
            F.concat(F.lit("(cost="), plain_number(top["total_cost"], 2), F.lit(")")),
            F.concat(F.lit("rows="), top["actual_rows"].cast("string")),
            F.concat(F.lit("time="), plain_number(top["actual_time"], 2), F.lit("ms")),
        ),
    )


def plan_buffer_stats(df: DataFrame, keys: tuple[str, ...] = ("exec_id",)) -> DataFrame:
    """The seven block counters of the root node; NULLs for a row without a plan."""
    top = root()
    return df.select(*keys, *[top[f].alias(f) for f in BUFFER_FIELDS])


def with_issues(df: DataFrame) -> DataFrame:
    """Add ``slow_operations``, ``suggestions``, ``missing_indexes`` and ``issues_detected``.

    Each node yields at most one finding; findings stay in pre-order.
    """

    def finding(n: Column) -> Column:
        kind, time = n["node_type"], n["actual_time"]
        relation = F.coalesce(n["relation_name"], F.lit(""))
        seq = (kind == fixed.SEQ_SCAN) & (n["actual_rows"] > fixed.ISSUE_SEQ_ROWS)
        # (condition, texts, what fills the slow-operation text, what fills the suggestion)
        rules = (
            (seq, fixed.ISSUE_SEQ, (relation, n["actual_rows"]), (relation,)),
            ((kind == "Sort") & (time > fixed.ISSUE_SORT_MS), fixed.ISSUE_SORT, (plain_number(time, 2),), ()),
            ((kind == "Nested Loop") & (time > fixed.ISSUE_LOOP_MS), fixed.ISSUE_LOOP, (), ()),
            ((kind == "Hash Join") & (n["temp_written_blocks"] > 0), fixed.ISSUE_SPILL, (), ()),
        )
        slow = [F.when(hit, fill(texts[0], *of_slow)) for hit, texts, of_slow, _ in rules]
        advice = [F.when(hit, fill(texts[1], *of_advice)) for hit, texts, _, of_advice in rules]
        return F.struct(
            F.coalesce(*slow).alias("slow"),
            F.coalesce(*advice).alias("advice"),
            F.when(seq, n["relation_name"]).alias("missing"),
        )

    def collected(field: str) -> Column:
        known = F.array_compact(F.transform("_findings", lambda f: f[field]))
        return F.coalesce(known, F.array().cast("array<string>"))

    lists = df.withColumn("_findings", F.transform("nodes", finding)).select(
        "*",
        collected("slow").alias("slow_operations"),
        collected("advice").alias("suggestions"),
        collected("missing").alias("missing_indexes"),
    )
    return lists.drop("_findings").withColumn(
        "issues_detected",
        (F.size("slow_operations") > 0) | (F.size("suggestions") > 0) | (F.size("missing_indexes") > 0),
    )


def has_performance_issues() -> Column:
    """The listing's view of issues: suggestions alone do not count."""
    return F.col("issues_detected") | (F.size("slow_operations") > 0) | (F.size("missing_indexes") > 0)
