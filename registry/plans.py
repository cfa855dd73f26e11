"""Plan mining.  Spark flattens plan JSON; the checking side never sees the JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.plans import metrics, scores, tree
from registry.base import joined, plain, register, rnd
from registry.fixtures import executions, with_parsed_nodes
from registry.history import ANALYSED, analysed

PM = """pm AS (SELECT exec_id, MAX(CASE WHEN ord = 0 THEN actual_rows END) AS root_rows,
  CAST(SUM(CASE WHEN contains(node_type, 'Scan') THEN actual_rows ELSE 0 END) AS BIGINT) AS rows_scanned,
  CAST(SUM(COALESCE(actual_rows, 0)) AS BIGINT) AS total_rows, COALESCE(MAX(workers_planned), 0) AS workers_planned,
  COALESCE(MAX(workers_launched), 0) AS workers_launched, COALESCE(MAX(peak_memory), 0) AS memory_usage_kb,
  COALESCE(string_agg(sort_method, ', ' ORDER BY ord), '') AS sort_methods,
  COALESCE(string_agg(index_name, ', ' ORDER BY ord), '') AS index_usage, COUNT(index_name) AS index_count,
  COUNT(*) AS node_count, CAST(MAX(level) AS INT) AS max_level,
  COALESCE(string_agg(CASE WHEN contains(node_type, 'Join') THEN concat_ws(' ', join_type, node_type) END, ', ' ORDER BY ord), '') AS join_types,
  COALESCE(string_agg(CASE WHEN contains(node_type, 'Scan') THEN node_type END, ', ' ORDER BY ord), '') AS scan_types,
  bool_or(contains(node_type, 'Seq Scan')) AS seq_scan_present FROM nodes GROUP BY exec_id)"""
# Executions with their metrics; list columns are comma-joined text here.
EXEC = """ex AS (SELECT a.*, CASE WHEN plan_state = 'plan' THEN root_rows ELSE result_rows_count END AS rows_returned, rows_scanned,
  total_rows, workers_planned, workers_launched, memory_usage_kb, sort_methods, index_usage, index_count, node_count, max_level,
  join_types, scan_types, seq_scan_present, COALESCE(contains(concat(', ', scan_types, ', '), ', Seq Scan, '), false) AS has_seq,
  COALESCE(contains(sort_methods, 'external merge'), false) AS disk_sort, COALESCE(index_count > 0, false) AS has_index,
  COALESCE(contains(scan_types, 'Index'), false) AS has_index_scan FROM analysed a LEFT JOIN pm USING (exec_id))"""
EX = dict(nodes=True, extra=(ANALYSED, PM, EXEC))


@register(
    "flatten_plan",
    """SELECT exec_id, CAST(row_number() OVER (PARTITION BY exec_id ORDER BY ord) - 1 AS INT) AS ord, CAST(level AS INT) AS level,
      node_type, relation_name, total_cost, actual_time, actual_rows FROM nodes""",
    nodes=True,
)
def flatten_plan(spark, sf):
    rows = tree.flatten_plan(with_parsed_nodes(spark, sf))
    return rows.select("exec_id", "ord", "level", "node_type", "relation_name", "total_cost", "actual_time", "actual_rows")


@register(
    "plan_node_count",
    """SELECT node_count, COUNT(*) AS plans, CAST(SUM(node_count) AS BIGINT) AS nodes
    FROM (SELECT exec_id, COUNT(*) AS node_count FROM nodes GROUP BY exec_id) n GROUP BY node_count""",
    nodes=True,
)
def plan_node_count(spark, sf):
    """How many plans have how many nodes."""
    counted = metrics.plan_metrics(tree.with_nodes(executions(spark, sf), fields=metrics.METRIC_FIELDS)).groupBy("node_count")
    out = counted.agg(F.count("*").alias("plans"), F.sum("node_count").alias("nodes"))
    return out.filter(F.col("nodes").isNotNull())


@register(
    "plan_metrics",
    """SELECT exec_id, rows_returned, rows_scanned, total_rows, workers_planned, workers_launched, memory_usage_kb,
      sort_methods, index_usage, node_count, max_level, CAST(CEIL(LOG2(node_count)) AS BIGINT) AS depth_estimate, join_types, scan_types, seq_scan_present,
      planning_time_ms, execution_time_ms, total_time_ms, query_cost FROM ex""",
    **EX,
)
def plan_metrics(spark, sf):
    lists = ["sort_methods", "index_usage", "join_types", "scan_types"]
    out = analysed(spark, sf)
    return out.select(
        "exec_id",
        *[c for c in metrics.METRIC_COLUMNS if c not in lists],
        *[F.array_join(c, ", ").alias(c) for c in lists],
        metrics.depth_estimate().alias("depth_estimate"),
        "planning_time_ms",
        "execution_time_ms",
        "total_time_ms",
        "query_cost",
    )


@register(
    "tolerant_plan_parse",
    """SELECT CASE plan_state WHEN 'plan' THEN 'ok' ELSE plan_state END AS plan_state, COUNT(*) AS executions,
      COUNT(*) FILTER (WHERE plan_state = 'malformed') AS errors FROM v_executions GROUP BY 1""",
)
def tolerant_plan_parse(spark, sf):
    rows = tree.with_nodes(executions(spark, sf))
    failed = tree.plan_error_document().isNotNull()
    return rows.groupBy("plan_state").agg(F.count("*").alias("executions"), F.count_if(failed).alias("errors"))


@register(
    "plan_summary",
    f"""SELECT exec_id, CASE WHEN plan_state = 'plan' THEN planning_part END AS planning_time,
      CASE WHEN plan_state = 'plan' THEN execution_part END AS execution_time, CASE WHEN plan_state = 'plan' THEN concat_ws(' ', node_type,
      CASE WHEN relation_name IS NOT NULL THEN concat('on ', relation_name) END, concat('(cost=', {plain('total_cost', 2)}, ')'),
      concat('rows=', actual_rows), concat('time=', {plain('actual_time', 2)}, 'ms')) END AS plan_summary
    FROM v_executions LEFT JOIN (SELECT * FROM nodes WHERE ord = 0) r USING (exec_id)""",
    nodes=True,
)
def plan_summary(spark, sf):
    rows = tree.with_root(executions(spark, sf), fields=metrics.SUMMARY_FIELDS)
    return rows.select("exec_id", "planning_time", "execution_time", metrics.plan_summary().alias("plan_summary"))


@register(
    "plan_buffer_stats",
    """SELECT exec_id, CASE WHEN p THEN q % 100 END AS shared_hit_blocks, CASE WHEN p THEN w % 10 END AS shared_read_blocks,
      CASE WHEN p THEN q % 3 END AS shared_dirtied_blocks, CAST(NULL AS BIGINT) AS local_hit_blocks,
      CAST(NULL AS BIGINT) AS local_read_blocks, CASE WHEN p AND q % 4 = 1 THEN w % 7 END AS temp_read_blocks,
      CAST(NULL AS BIGINT) AS temp_written_blocks FROM (SELECT *, plan_state = 'plan' AS p FROM v_executions) e""",
)
def plan_buffer_stats(spark, sf):
    return metrics.plan_buffer_stats(tree.with_root(executions(spark, sf), fields=tree.BUFFER_FIELDS))


@register(
    "node_class",
    """SELECT class AS node_class, COUNT(*) AS nodes, COUNT(DISTINCT exec_id) AS plans FROM (SELECT exec_id,
      CASE node_type WHEN 'Seq Scan' THEN 'seq-scan' WHEN 'Index Scan' THEN 'index-scan' WHEN 'Index Only Scan' THEN 'index-scan'
      WHEN 'Hash Join' THEN 'hash' WHEN 'Sort' THEN 'sort' WHEN 'Aggregate' THEN 'aggregate' WHEN 'Limit' THEN 'limit'
      WHEN 'Merge Join' THEN 'join' ELSE 'other' END AS class FROM nodes) n GROUP BY class""",
    nodes=True,
)
def node_class(spark, sf):
    rows = tree.flatten_plan(tree.with_nodes(executions(spark, sf)))
    return rows.groupBy(tree.node_class(F.col("node_type")).alias("node_class")).agg(
        F.count("*").alias("nodes"), F.count_distinct("exec_id").alias("plans")
    )


FOUND = f"""found AS (SELECT exec_id, ord, relation_name,
  CASE WHEN node_type = 'Seq Scan' AND actual_rows > 1000 THEN 'seq' WHEN node_type = 'Sort' AND actual_time > 100 THEN 'sort'
    WHEN node_type = 'Nested Loop' AND actual_time > 50 THEN 'loop' WHEN node_type = 'Hash Join' AND temp_written > 0 THEN 'spill' END AS kind,
  CASE WHEN node_type = 'Seq Scan' AND actual_rows > 1000 THEN concat('Sequential scan on ', relation_name, ' (', actual_rows, ' rows)')
    WHEN node_type = 'Sort' AND actual_time > 100 THEN concat('Expensive sort operation (', {plain('actual_time', 2)}, 'ms)')
    WHEN node_type = 'Nested Loop' AND actual_time > 50 THEN 'Potentially expensive nested loop join'
    WHEN node_type = 'Hash Join' AND temp_written > 0 THEN 'Hash join spilling to disk' END AS slow FROM nodes)"""
ADVICE = """advised AS (SELECT *, CASE kind WHEN 'seq' THEN concat('Consider adding an index on ', relation_name, ' to avoid full table scan')
  WHEN 'sort' THEN 'Consider adding an index to avoid sorting, or increase work_mem'
  WHEN 'loop' THEN 'Consider adding indexes on join columns or using different join strategy'
  WHEN 'spill' THEN 'Consider increasing work_mem to avoid disk spilling' END AS advice FROM found WHERE kind IS NOT NULL)"""


@register(
    "plan_issues",
    """SELECT exec_id, COALESCE(slow, '') AS slow_operations, COALESCE(advice, '') AS suggestions, COALESCE(missing, '') AS missing_indexes,
      slow IS NOT NULL AS issues_detected, slow IS NOT NULL AS flagged FROM v_executions LEFT JOIN (SELECT exec_id, string_agg(slow, ' | ' ORDER BY ord) AS slow,
      string_agg(advice, ' | ' ORDER BY ord) AS advice, string_agg(CASE WHEN kind = 'seq' THEN relation_name END, ' | ' ORDER BY ord) AS missing
      FROM advised GROUP BY exec_id) i USING (exec_id)""",
    nodes=True,
    extra=(FOUND, ADVICE),
)
def plan_issues(spark, sf):
    rows = metrics.with_issues(with_parsed_nodes(spark, sf, metrics.ISSUE_FIELDS))
    return rows.select(
        "exec_id", joined("slow_operations"), joined("suggestions"), joined("missing_indexes"), "issues_detected",
        metrics.has_performance_issues().alias("flagged"),
    )


@register(
    "missing_index_candidates",
    """SELECT relation_name AS relation, COUNT(*) AS findings, COUNT(DISTINCT exec_id) AS executions
    FROM advised WHERE kind = 'seq' GROUP BY relation_name""",
    nodes=True,
    extra=(FOUND, ADVICE),
)
def missing_index_candidates(spark, sf):
    """Relations named by the missing-index rule over the whole log."""
    rows = metrics.with_issues(with_parsed_nodes(spark, sf, metrics.ISSUE_FIELDS))
    each = rows.select("exec_id", F.explode_outer("missing_indexes").alias("relation"))
    return each.filter(F.col("relation").isNotNull()).groupBy("relation").agg(F.count("*").alias("findings"), F.count_distinct("exec_id").alias("executions"))


@register(
    "recommendations",
    """SELECT exec_id, position, suggestion, CASE WHEN contains(lower(suggestion), 'index') AND
        (contains(lower(suggestion), 'avoid') OR contains(lower(suggestion), 'eliminate')) THEN 'HIGH'
      WHEN contains(suggestion, 'work_mem') OR contains(suggestion, 'memory') THEN 'MEDIUM' WHEN position = 0 THEN 'HIGH'
      WHEN position <= 2 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
      CASE WHEN contains(lower(suggestion), 'index') AND contains(suggestion, 'avoid') THEN '~50-80% faster'
      WHEN contains(suggestion, 'work_mem') THEN '~20-40% improvement' WHEN contains(suggestion, 'parallel') THEN '~30-60% faster'
      ELSE 'Performance gain' END AS impact, CASE WHEN contains(suggestion, 'index') AND contains(suggestion, 'order_items') THEN 'CREATE INDEX ON order_items(...)'
      WHEN contains(suggestion, 'work_mem') THEN 'SET work_mem = ''256MB'''
      WHEN contains(suggestion, 'parallel') THEN 'Adjust max_parallel_workers' ELSE 'See PostgreSQL docs' END AS hint
    FROM (SELECT exec_id, CAST(row_number() OVER (PARTITION BY exec_id ORDER BY ord) - 1 AS INT) AS position, advice AS suggestion
      FROM advised) s""",
    nodes=True,
    extra=(FOUND, ADVICE),
)
def recommendations(spark, sf):
    return scores.recommendations(metrics.with_issues(with_parsed_nodes(spark, sf, metrics.ISSUE_FIELDS)))


def clamp(score: str) -> str:
    return f"GREATEST(0, LEAST(100, {score}))"


def steps(value: str, pairs: list[tuple[float, object]], rest: object, op: str) -> str:
    def quote(x):
        return f"'{x}'" if isinstance(x, str) else str(x)

    return "CASE " + " ".join(f"WHEN {value} {op} {b} THEN {quote(v)}" for b, v in pairs) + f" ELSE {quote(rest)} END"


SHARE = "(CAST(rows_returned AS DOUBLE) / NULLIF(rows_scanned, 0))"
PER_ROW = "(CAST(memory_usage_kb AS DOUBLE) / NULLIF(rows_returned, 0))"
USED = "(CAST(workers_launched AS DOUBLE) / NULLIF(workers_planned, 0))"
PLAN_EFFICIENCY = clamp(
    f"""100 + CASE WHEN rows_scanned > 0 THEN {steps(SHARE + ' * 100', [(20, -40), (50, -20)], 0, '<')} ELSE 0 END
    + CASE WHEN has_index THEN 10 ELSE 0 END - CASE WHEN has_seq AND rows_scanned > 10000 THEN 20 ELSE 0 END
    - CASE WHEN disk_sort THEN 15 ELSE 0 END + CASE WHEN workers_launched > 0 THEN 5 ELSE 0 END"""
)
OVERALL = clamp(
    f"""100 + {steps('total_time_ms', [(10000, -40), (5000, -25), (1000, -15), (500, -8)], 0, '>')}
    + {steps('query_cost', [(1000000, -20), (100000, -10)], 0, '>')} + CASE WHEN has_index THEN 5 ELSE 0 END
    + CASE WHEN workers_launched > 0 THEN 5 ELSE 0 END - CASE WHEN disk_sort THEN 10 ELSE 0 END"""
)
OPTIMIZATION = f"""GREATEST(0, 100 + {steps('total_time_ms', [(1000, -30), (500, -15), (100, -5)], 0, '>')}
    + {steps('query_cost', [(10000, -20), (1000, -10)], 0, '>')}
    - CASE WHEN rows_returned > 0 AND total_time_ms > 0 AND rows_returned / total_time_ms < 0.1 THEN 15 ELSE 0 END)"""
EFFICIENCY = clamp(
    f"""100 + {steps('total_time_ms', [(5000, -40), (1000, -20), (500, -10)], 0, '>')} + CASE WHEN workers_launched > 0 THEN 10 ELSE 0 END
    - CASE WHEN memory_usage_kb > 50000 THEN 15 ELSE 0 END + CASE WHEN has_index THEN 5 ELSE 0 END
    - CASE WHEN has_seq THEN 10 ELSE 0 END - CASE WHEN disk_sort THEN 15 ELSE 0 END"""
)
EFFICIENCY_LABEL = f"""CASE WHEN total_time_ms IS NULL OR total_time_ms = 0 THEN 'N/A'
  ELSE {steps(EFFICIENCY, [(85, 'Excellent'), (70, 'Good'), (50, 'Fair')], 'Needs Review', '>=')} END"""
BOTTLENECKS = """COALESCE(NULLIF(concat_ws(', ', CASE WHEN has_seq THEN 'Sequential Scans' END, CASE WHEN disk_sort THEN 'Disk Sorting' END,
  CASE WHEN memory_usage_kb > 100000 THEN 'High Memory' END, CASE WHEN workers_planned > workers_launched THEN 'Worker Shortage' END,
  CASE WHEN NOT has_index AND rows_scanned > 10000 THEN 'Missing Indexes' END), ''), 'None')"""


@register(
    "score_executions",
    f"""SELECT exec_id, {steps('total_time_ms', [(50, 'Excellent'), (200, 'Good'), (1000, 'Fair')], 'Slow', '<=').replace('CASE', "CASE WHEN total_time_ms IS NULL THEN 'Unknown'", 1)} AS performance_rating,
      {steps('total_time_ms', [(100, 'Excellent'), (500, 'Good'), (2000, 'Acceptable'), (10000, 'Slow')], 'Very Slow', '<=').replace('CASE', "CASE WHEN total_time_ms IS NULL THEN ''", 1)} AS benchmark,
      {steps('query_cost', [(1000, 'Low'), (10000, 'Medium'), (100000, 'High')], 'Very High', '<=').replace('CASE', "CASE WHEN query_cost IS NULL THEN ''", 1)} AS cost_level,
      {steps('memory_usage_kb', [(10000, 'Low'), (50000, 'Medium'), (200000, 'High')], 'Very High', '<=').replace('CASE', "CASE WHEN memory_usage_kb IS NULL THEN ''", 1)} AS memory_level,
      CASE WHEN rows_returned IS NULL OR rows_scanned IS NULL THEN 'N/A'
        ELSE {steps(PLAN_EFFICIENCY, [(80, 'Excellent'), (60, 'Good'), (40, 'Fair')], 'Poor', '>=')} END AS plan_efficiency,
      CAST(CASE WHEN total_time_ms IS NULL OR query_cost IS NULL THEN 75 ELSE {OVERALL} END AS INT) AS overall_score,
      CAST({OPTIMIZATION} AS INT) AS optimization_score,
      {steps(OPTIMIZATION, [(90, 'A'), (80, 'B'), (70, 'C')], 'D', '>=')} AS score_grade,
      {EFFICIENCY_LABEL} AS efficiency_label, {BOTTLENECKS} AS bottlenecks FROM ex""",
    **EX,
)
def score_executions(spark, sf):
    names = [
        "performance_rating", "benchmark", "cost_level", "memory_level", "plan_efficiency", "overall_score",
        "optimization_score", "score_grade", "efficiency_label", "bottlenecks",
    ]
    return scores.score_executions(analysed(spark, sf), names).select("exec_id", *names)


@register(
    "execution_impacts",
    f"""SELECT exec_id, CASE WHEN rows_returned IS NOT NULL AND rows_scanned > 0
        THEN {steps(SHARE + ' * 100', [(80, 'Excellent'), (50, 'Good'), (20, 'Fair')], 'Poor', '>=')} ELSE 'N/A' END AS io_efficiency,
      CASE WHEN memory_usage_kb IS NOT NULL AND rows_returned > 0
        THEN {steps(PER_ROW, [(1, 'Excellent'), (5, 'Good'), (20, 'Fair')], 'Poor', '<=')} ELSE 'N/A' END AS memory_efficiency,
      CASE WHEN memory_usage_kb IS NULL THEN 'N/A' WHEN memory_usage_kb >= 1048576 THEN concat({plain('memory_usage_kb / 1048576.0', 1)}, ' GB')
        WHEN memory_usage_kb >= 1024 THEN concat({plain('memory_usage_kb / 1024.0', 1)}, ' MB') ELSE format('{{:,}} KB', memory_usage_kb) END AS memory_text,
      CASE WHEN workers_planned IS NULL OR workers_planned = 0 THEN 'N/A' WHEN workers_launched = 0 THEN 'None'
        ELSE {steps(USED + ' * 100', [(90, 'Excellent'), (70, 'Good'), (50, 'Fair')], 'Poor', '>=')} END AS parallelization,
      CASE WHEN has_index_scan AND NOT has_seq THEN 'Excellent' WHEN has_index_scan THEN 'Good' WHEN has_seq THEN 'Poor' ELSE 'N/A' END AS index_utilization,
      CASE WHEN rows_returned IS NULL OR rows_scanned IS NULL THEN 'N/A' WHEN {SHARE} > 1 THEN 'Poor selectivity'
        ELSE {steps(SHARE, [(0.8, 'Excellent selectivity'), (0.5, 'Good filtering'), (0.1, 'Moderate waste')], 'Poor selectivity', '>=')} END AS io_impact,
      CASE WHEN memory_usage_kb IS NULL OR rows_returned IS NULL THEN 'N/A'
        ELSE {steps(PER_ROW, [(1, 'Very efficient'), (10, 'Reasonable usage'), (100, 'High consumption')], 'Memory intensive', '<=')} END AS memory_impact,
      CASE WHEN workers_planned IS NULL THEN 'N/A' WHEN workers_launched = 0 THEN 'No parallelization'
        WHEN workers_launched = workers_planned THEN 'Full utilization' ELSE 'Partial utilization' END AS parallel_impact,
      CASE WHEN scan_types IS NULL OR scan_types = '' THEN 'N/A' WHEN has_index_scan AND NOT has_seq THEN 'Optimal access'
        WHEN has_index_scan THEN 'Mixed access pattern' WHEN has_seq THEN 'Sequential scans' ELSE 'Unknown pattern' END AS index_impact,
      CASE WHEN execution_time_ms > 0 THEN {steps('planning_time_ms / execution_time_ms', [(0.5, 'High planning overhead'), (0.2, 'Moderate planning cost')], '#', '>').replace("'#'", "CASE WHEN planning_time_ms / execution_time_ms < 0.05 THEN 'Efficient planning' ELSE 'Balanced timing' END")}
        ELSE '' END AS planning_insight,
      CAST(CASE WHEN planning_time_ms IS NOT NULL AND total_time_ms > 0 THEN LEAST(100, ROUND(CAST(planning_time_ms / total_time_ms * 100 AS DECIMAL(28,10)), 0)) ELSE 0 END AS BIGINT) AS planning_pct,
      CAST(CASE WHEN execution_time_ms IS NOT NULL AND total_time_ms > 0 THEN LEAST(100, ROUND(CAST(execution_time_ms / total_time_ms * 100 AS DECIMAL(28,10)), 0)) ELSE 0 END AS BIGINT) AS execution_pct,
      {rnd('query_cost / COALESCE(NULLIF(result_rows_count, 0), NULLIF(rows_returned, 0))', 2)} AS cost_per_row,
      {rnd(SHARE + ' * 100', 1)} AS io_efficiency_pct,
      CASE WHEN workers_launched > 0 THEN {rnd(USED + ' * 100', 0)} END AS worker_utilisation,
      {rnd('rows_returned / NULLIF(total_time_ms, 0)', 4)} AS rows_per_ms FROM ex""",
    **EX,
)
def execution_impacts(spark, sf):
    names = [
        "io_efficiency", "memory_efficiency", "memory_text", "parallelization", "index_utilization", "io_impact",
        "memory_impact", "parallel_impact", "index_impact", "planning_insight", "planning_pct", "execution_pct",
        "cost_per_row", "io_efficiency_pct", "worker_utilisation", "rows_per_ms",
    ]
    return scores.score_executions(analysed(spark, sf), names).select("exec_id", *names)


@register(
    "execution_findings",
    """SELECT exec_id, COALESCE(NULLIF(concat_ws(' | ', CASE WHEN total_time_ms > 5000 THEN 'Very slow execution time (>5 seconds)'
        WHEN total_time_ms > 1000 THEN 'Slow execution time (>1 second)' END,
        CASE WHEN memory_usage_kb > 100000 THEN 'High memory usage (>100MB)' END, CASE WHEN disk_sort THEN 'Sorting spilled to disk' END,
        CASE WHEN has_seq AND rows_scanned > 100000 THEN 'Large sequential scan detected' END,
        CASE WHEN workers_planned > workers_launched THEN 'Worker shortage detected' END), ''), 'No major performance issues detected') AS performance_issues,
      COALESCE(NULLIF(concat_ws(' | ', CASE WHEN has_seq THEN 'Consider adding indexes to eliminate sequential scans' END,
        CASE WHEN disk_sort THEN 'Increase work_mem to avoid disk-based sorting' END,
        CASE WHEN COALESCE(workers_launched, 0) = 0 AND total_time_ms > 1000 THEN 'Query could benefit from parallel execution' END,
        CASE WHEN NOT has_index AND rows_scanned > 10000 THEN 'Add indexes to improve query performance' END,
        CASE WHEN COALESCE(join_types, '') <> '' AND total_time_ms > 500 THEN 'Review join strategy and column statistics' END), ''),
        'Query is well-optimized') AS plan_optimizations FROM ex""",
    **EX,
)
def execution_findings(spark, sf):
    out = scores.score_executions(analysed(spark, sf), ["performance_issues", "plan_optimizations"])
    return out.select("exec_id", joined("performance_issues"), joined("plan_optimizations"))
