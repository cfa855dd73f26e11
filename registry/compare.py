"""Comparison of executions: consecutive runs of a statement, and chosen pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators.history import statement_key
from fleetpulse.plans import compare
from fleetpulse.plans.metrics import METRIC_COLUMNS
from registry.base import joined, register, rnd
from registry.fixtures import table, with_parsed_nodes
from registry.history import ANALYSED, analysed
from registry.plans import BOTTLENECKS, EFFICIENCY_LABEL, EXEC, OPTIMIZATION, PM, steps

TIMES = ["total_time_ms", "planning_time_ms", "execution_time_ms", "query_cost"]
CARRIED = ["exec_id", *METRIC_COLUMNS, *TIMES]

# Every execution scored, then joined to the one before it of the same statement.
SCORED = f"""scored AS (SELECT *, {EFFICIENCY_LABEL} AS efficiency, {BOTTLENECKS} AS bottleneck, {OPTIMIZATION} AS score,
  {steps(OPTIMIZATION, [(90, 'A'), (80, 'B'), (70, 'C')], 'D', '>=')} AS grade,
  ROUND(CAST(COALESCE(COALESCE(NULLIF(rows_returned, 0), rows_scanned, 0) / NULLIF(total_time_ms, 0), 0) AS DECIMAL(28,10)), 2) AS throughput,
  row_number() OVER (PARTITION BY w ORDER BY created_at, exec_id) AS n FROM ex)"""
_FIELDS = [
    "exec_id", "rows_returned", "rows_scanned", "workers_planned", "workers_launched", "memory_usage_kb", "sort_methods",
    "index_usage", "index_count", "node_count", "scan_types", "seq_scan_present", "has_seq", "disk_sort", "has_index",
    *TIMES, "efficiency", "bottleneck", "score", "grade", "throughput",
]
PAIRS = "pairs AS (SELECT " + ", ".join(f"a.{f} AS a_{f}, b.{f} AS b_{f}" for f in _FIELDS) + f""",
  {rnd('(a.total_time_ms - b.total_time_ms) / NULLIF(a.total_time_ms, 0) * 100', 1)} AS time_pct,
  {rnd('(a.query_cost - b.query_cost) / NULLIF(a.query_cost, 0) * 100', 1)} AS cost_pct,
  {rnd('abs(a.total_time_ms - b.total_time_ms) / NULLIF(GREATEST(a.total_time_ms, b.total_time_ms), 0) * 100', 1)} AS gap,
  a.total_time_ms IS NOT NULL AND b.total_time_ms IS NOT NULL AS timed
  FROM scored a JOIN scored b ON a.w = b.w AND b.n = a.n + 1)"""
CTES = dict(nodes=True, extra=(ANALYSED, PM, EXEC, SCORED, PAIRS))
IDS = "a_exec_id AS a_id, b_exec_id AS b_id"


def shown(value: str) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,10)), 1) AS DECIMAL(28,1))"


def pairs(spark, sf, carried=CARRIED):
    """Consecutive runs of each statement; only ``carried`` columns are shuffled."""
    log = analysed(spark, sf).withColumn("statement", statement_key())
    return compare.consecutive_pairs(log, carried)


def ids():
    return [F.col("a.exec_id").alias("a_id"), F.col("b.exec_id").alias("b_id")]


@register(
    "execution_regressions",
    f"""SELECT {IDS}, CASE WHEN timed THEN time_pct END AS time_difference_pct, CASE WHEN timed THEN cost_pct END AS cost_difference_pct,
      CASE WHEN timed THEN CASE WHEN time_pct > 0 THEN 'b' ELSE 'a' END END AS time_faster,
      CASE WHEN timed THEN CASE WHEN cost_pct > 0 THEN 'b' ELSE 'a' END END AS cost_cheaper,
      CASE WHEN NOT timed THEN 'unknown' WHEN a_total_time_ms < b_total_time_ms THEN 'a' ELSE 'b' END AS winner,
      concat_ws(' | ', CASE WHEN timed AND gap > 20 THEN concat(CASE WHEN a_total_time_ms < b_total_time_ms THEN 'Query A' ELSE 'Query B' END,
          ' is ', {shown('gap')}, '% faster in execution time') END,
        CASE WHEN COALESCE(a_seq_scan_present, false) AND NOT COALESCE(b_seq_scan_present, false) THEN 'Query B uses index scans while Query A uses sequential scans'
          WHEN COALESCE(b_seq_scan_present, false) AND NOT COALESCE(a_seq_scan_present, false) THEN 'Query A uses index scans while Query B uses sequential scans' END) AS insights
    FROM pairs""",
    **CTES,
)
def execution_regressions(spark, sf):
    compared = ["exec_id", "total_time_ms", "query_cost", "seq_scan_present"]
    return pairs(spark, sf, compared).select(
        *ids(), compare.perf_diff().alias("p"), compare.winner().alias("winner"), compare.comparison_insights().alias("insights")
    ).select("a_id", "b_id", "p.*", "winner", joined("insights"))


@register(
    "comparison_scores",
    f"""SELECT {IDS}, CASE WHEN time_pct IS NULL OR time_pct = 0 THEN 'Negligible' ELSE
        {steps('abs(time_pct)', [(50, 'Critical'), (25, 'High'), (10, 'Moderate')], 'Low', '>')} END AS time_impact,
      CASE WHEN cost_pct IS NULL OR cost_pct = 0 THEN 'Same' ELSE
        {steps('abs(cost_pct)', [(100, 'Very High'), (50, 'High'), (20, 'Moderate')], 'Low', '>')} END AS cost_impact,
      CASE WHEN a_throughput = b_throughput THEN 'Same' WHEN a_throughput > b_throughput THEN 'A more efficient' ELSE 'B more efficient' END AS throughput,
      a_efficiency AS efficiency_a, b_efficiency AS efficiency_b, a_bottleneck AS bottlenecks_a, b_bottleneck AS bottlenecks_b,
      CAST(a_score AS INT) AS score_a, CAST(b_score AS INT) AS score_b, a_grade AS grade_a, b_grade AS grade_b,
      CASE WHEN abs(a_score - b_score) > 5 THEN concat(CASE WHEN a_score > b_score THEN 'A' ELSE 'B' END, ': ', abs(a_score - b_score), ' points better')
        ELSE 'Similar performance' END AS score_gap FROM pairs""",
    **CTES,
)
def comparison_scores(spark, sf):
    names = [
        "time_impact", "cost_impact", "throughput", "efficiency_a", "efficiency_b", "bottlenecks_a", "bottlenecks_b",
        "score_a", "score_b", "grade_a", "grade_b", "score_gap",
    ]
    return compare.compare_executions(pairs(spark, sf), names).select(*ids(), *names)


def _issues(s: str) -> str:
    p, q = s.lower(), f"Query {s}: "
    ms = f"concat('(', {rnd(p + '_total_time_ms', 3)}, 'ms)')"
    return f"""CASE WHEN {p}_total_time_ms > 5000 THEN concat('{q}Very slow execution ', {ms})
        WHEN {p}_total_time_ms > 1000 THEN concat('{q}Slow execution time ', {ms}) END,
      CASE WHEN {p}_memory_usage_kb > 100000 THEN concat('{q}High memory usage (', {p}_memory_usage_kb, 'KB)') END,
      CASE WHEN {p}_disk_sort THEN '{q}Sorting spilled to disk' END,
      CASE WHEN {p}_workers_planned > {p}_workers_launched THEN concat('{q}Only ', {p}_workers_launched, '/', {p}_workers_planned, ' parallel workers launched') END,
      CASE WHEN {p}_has_seq AND {p}_rows_scanned > 100000 THEN concat('{q}Large sequential scan (', {p}_rows_scanned, ' rows)') END"""


def _indexes(s: str) -> str:
    p = s.lower()
    return f"""CASE WHEN {p}_has_index THEN concat('Query {s}: Uses ', {p}_index_count, ' index(es) - ', {p}_index_usage)
      ELSE 'Query {s}: No indexes used (may cause performance issues)' END"""


@register(
    "comparison_findings",
    f"""SELECT {IDS}, COALESCE(NULLIF(concat_ws(' | ', {_issues('A')}, {_issues('B')}), ''), 'No major performance issues detected') AS performance_findings,
      concat_ws(' | ', {_indexes('A')}, {_indexes('B')}, CASE WHEN a_has_seq AND NOT b_has_seq THEN 'Query B has better index utilization than Query A'
        WHEN b_has_seq AND NOT a_has_seq THEN 'Query A has better index utilization than Query B'
        WHEN NOT a_has_seq AND NOT b_has_seq THEN 'Both queries efficiently use indexes' END) AS index_findings,
      COALESCE(NULLIF(concat_ws(' | ',
        CASE WHEN timed AND abs(a_total_time_ms - b_total_time_ms) / NULLIF(GREATEST(a_total_time_ms, b_total_time_ms), 0) * 100 > 50
          THEN CASE WHEN a_total_time_ms > b_total_time_ms THEN 'Query A could benefit from Query B''s execution strategy'
          ELSE 'Query B could benefit from Query A''s execution strategy' END END,
        CASE WHEN a_memory_usage_kb > b_memory_usage_kb * 2 THEN 'Query A uses significantly more memory - consider optimizing'
          WHEN b_memory_usage_kb > a_memory_usage_kb * 2 THEN 'Query B uses significantly more memory - consider optimizing' END,
        CASE WHEN a_workers_launched = 0 AND a_total_time_ms > 1000 THEN 'Query A could benefit from parallel execution' END,
        CASE WHEN b_workers_launched = 0 AND b_total_time_ms > 1000 THEN 'Query B could benefit from parallel execution' END,
        CASE WHEN a_disk_sort THEN 'Query A: Increase work_mem to avoid disk-based sorting' END,
        CASE WHEN b_disk_sort THEN 'Query B: Increase work_mem to avoid disk-based sorting' END,
        CASE WHEN a_has_seq AND a_rows_scanned > 10000 THEN 'Query A: Consider adding indexes to eliminate sequential scans' END,
        CASE WHEN b_has_seq AND b_rows_scanned > 10000 THEN 'Query B: Consider adding indexes to eliminate sequential scans' END), ''),
        'Both queries are well-optimized') AS opportunities,
      concat_ws(' | ', CASE WHEN a_total_time_ms > 1000 OR b_total_time_ms > 1000
          THEN 'HIGH: Consider adding appropriate indexes to reduce sequential scans and improve query performance.' END,
        CASE WHEN abs(a_total_time_ms - b_total_time_ms) > 200 THEN concat('MEDIUM: Analyze Query ', CASE WHEN a_total_time_ms < b_total_time_ms
          THEN 'A' ELSE 'B' END, '''s execution plan to optimize the slower query''s performance.') END,
        'LOW: Monitor query performance over time and consider query result caching for frequently accessed data.') AS recommendations
    FROM pairs""",
    **CTES,
)
def comparison_findings(spark, sf):
    names = ["performance_findings", "index_findings", "opportunities", "recommendations"]
    out = compare.compare_executions(pairs(spark, sf), names)
    advice = F.transform("recommendations", lambda r: F.concat(r.priority, F.lit(": "), r.text))
    return out.select(
        *ids(), joined("performance_findings"), joined("index_findings"), joined("opportunities"),
        F.array_join(advice, " | ").alias("recommendations"),
    )


def _difference(field: str) -> str:
    a, b = f"CAST(a_{field} AS DOUBLE)", f"CAST(b_{field} AS DOUBLE)"
    pct = f"abs(({b} - {a}) / NULLIF({a}, 0)) * 100"
    return f"""CASE WHEN {a} <> 0 AND {b} <> 0 AND {a} <> {b} AND {pct} >= 1
      THEN concat({shown(pct)}, '% ', CASE WHEN {a} < {b} THEN 'A' ELSE 'B' END, ' faster') ELSE 'Same' END"""


def _number(label: str, field: str, impact: str, difference: str | None = None, where: str = "true") -> str:
    def cell(p):
        return f"CAST({rnd(f'NULLIF({p}_{field}, 0)', 3)} AS VARCHAR)"

    return f"""SELECT {IDS}, '{label}' AS label, {cell('a')} AS value_a, {cell('b')} AS value_b,
      {difference or "'Same'"} AS difference, {impact} AS impact FROM pairs WHERE {where}"""


def _names(label: str, field: str, impact: str) -> str:
    return f"""SELECT {IDS}, '{label}', NULLIF(a_{field}, ''), NULLIF(b_{field}, ''), 'Same', '{impact}' FROM pairs
      WHERE COALESCE(a_{field}, '') <> '' OR COALESCE(b_{field}, '') <> ''"""


def _side(pct: str, word: str) -> str:
    return f"""CASE WHEN timed AND {pct} <> 0 THEN concat({shown(f'abs({pct})')}, '% ', CASE WHEN {pct} > 0 THEN 'B' ELSE 'A' END, ' {word}') ELSE 'Same' END"""


TIME_IMPACT = f"CASE WHEN NOT timed OR time_pct IS NULL OR time_pct = 0 THEN 'Negligible' ELSE {steps('abs(time_pct)', [(50, 'Critical'), (25, 'High'), (10, 'Moderate')], 'Low', '>')} END"
COST_IMPACT = f"CASE WHEN NOT timed OR cost_pct IS NULL OR cost_pct = 0 THEN 'Same' ELSE {steps('abs(cost_pct)', [(100, 'Very High'), (50, 'High'), (20, 'Moderate')], 'Low', '>')} END"


@register(
    "metrics_table",
    " UNION ALL ".join(
        [
            _number("Total Time", "total_time_ms", TIME_IMPACT, _side("time_pct", "faster")),
            _number("Query Cost", "query_cost", COST_IMPACT, _side("cost_pct", "cheaper")),
            _number("Rows Returned", "rows_returned", "'Data Volume'"),
            _number("Planning Time", "planning_time_ms", "'Query Complexity'", _difference("planning_time_ms")),
            _number("Execution Time", "execution_time_ms", "'Resource Usage'", _difference("execution_time_ms")),
            _number("Rows Scanned", "rows_scanned", "'I/O Efficiency'", _difference("rows_scanned")),
            _number("Peak Memory", "memory_usage_kb", "'Resource Usage'", _difference("memory_usage_kb"), "a_memory_usage_kb > 0 OR b_memory_usage_kb > 0"),
            _number("Parallel Workers", "workers_launched", "'Parallelization'", None, "a_workers_launched > 0 OR b_workers_launched > 0"),
            _number("Plan Nodes", "node_count", "'Complexity'"),
            _names("Scan Methods", "scan_types", "Access Pattern"),
            _names("Indexes Used", "index_usage", "Index Efficiency"),
            _names("Sort Methods", "sort_methods", "Memory Efficiency"),
        ]
    ),
    **CTES,
)
def metrics_table(spark, sf):
    keyed = pairs(spark, sf).select(*ids(), "a", "b")
    return compare.metrics_table(keyed, ["a_id", "b_id"])


@register(
    "plan_node_diff",
    f"""SELECT a_id, b_id, node_type, relation_name, CAST(SUM(in_a) AS BIGINT) AS count_a, CAST(SUM(in_b) AS BIGINT) AS count_b,
      CASE WHEN SUM(in_b) = 0 THEN 'only a' WHEN SUM(in_a) = 0 THEN 'only b' ELSE 'common' END AS place FROM (
      SELECT {IDS}, node_type, relation_name, 1 AS in_a, 0 AS in_b FROM pairs JOIN nodes ON exec_id = a_exec_id
        WHERE b_node_count IS NOT NULL
      UNION ALL SELECT {IDS}, node_type, relation_name, 0, 1 FROM pairs JOIN nodes ON exec_id = b_exec_id
        WHERE a_node_count IS NOT NULL) n GROUP BY ALL""",
    **CTES,
)
def plan_node_diff(spark, sf):
    log = with_parsed_nodes(spark, sf, ("node_type", "relation_name")).withColumn("statement", statement_key())
    slim = log.withColumn(
        "nodes", F.transform("nodes", lambda n: F.struct(n["node_type"].alias("node_type"), n["relation_name"].alias("relation_name")))
    )
    both = compare.consecutive_pairs(slim, ["exec_id", "nodes"]).select(*ids(), "a", "b")
    return compare.plan_node_diff(both, ["a_id", "b_id"])


@register(
    "execution_pair",
    f"""SELECT a.exec_id AS a_id, b.exec_id AS b_id, a.node_count AS a_nodes, b.node_count AS b_nodes,
      CASE WHEN a.total_time_ms IS NULL OR b.total_time_ms IS NULL THEN 'unknown' WHEN a.total_time_ms < b.total_time_ms THEN 'a' ELSE 'b' END AS winner
    FROM orders o JOIN ex a ON a.exec_id = o.o_orderkey JOIN ex b ON b.exec_id = o.o_orderkey + 1""",
    nodes=True,
    extra=(ANALYSED, PM, EXEC),
)
def execution_pair(spark, sf):
    """Chosen pairs: every order with the next order number."""
    chosen = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("a_id"), (F.col("o_orderkey") + 1).alias("b_id")
    )
    both = compare.execution_pairs(analysed(spark, sf), chosen, CARRIED)
    return both.select(
        "a_id", "b_id", F.col("a.node_count").alias("a_nodes"), F.col("b.node_count").alias("b_nodes"),
        compare.winner().alias("winner"),
    )


@register(
    "comparison_document",
    f"""SELECT {IDS}, CASE WHEN NOT timed THEN 'unknown' WHEN a_total_time_ms < b_total_time_ms THEN 'a' ELSE 'b' END AS winner,
      CASE WHEN timed THEN time_pct END AS time_difference_pct, b_rows_scanned AS b_rows_scanned FROM pairs""",
    **CTES,
)
def comparison_document(spark, sf):
    """The nested document of each pair, read back by path."""
    compared = compare.compare_executions(pairs(spark, sf), ["performance", "winner", "insights"]).select(
        *ids(), compare.comparison_document().alias("document")
    )
    path = F.get_json_object
    return compared.select(
        "a_id",
        "b_id",
        path("document", "$.comparison.winner").alias("winner"),
        path("document", "$.comparison.performance.time_difference_pct").cast("double").alias("time_difference_pct"),
        path("document", "$.executions.b.rows_scanned").cast("bigint").alias("b_rows_scanned"),
    )
