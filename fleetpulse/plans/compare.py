"""Comparison of two executions ``a`` and ``b``, row by row.

Pairs come from consecutive executions of the same statement
(``consecutive_pairs``), so the comparisons work as a regression finder over a
whole log, or from a table of chosen ids (``execution_pairs``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import constants as fixed
from fleetpulse.functions.ladders import cost_impact, score_grade, time_impact
from fleetpulse.functions.numbers import ratio, round_half_up
from fleetpulse.functions.text import fill
from fleetpulse.operators.skew import split_lag
from fleetpulse.plans.scores import Metrics, bottlenecks, efficiency_label, lines, optimization_score, slow_text

A, B = Metrics("a"), Metrics("b")


def consecutive_pairs(
    executions: DataFrame,
    carried: Sequence[str],
    keys: Sequence[str] = ("database_id", "statement"),
) -> DataFrame:
    """Each execution (``b``) with the one before it of the same statement (``a``)."""
    paired = split_lag(
        executions.select(*dict.fromkeys([*keys, "created_at", "exec_id", *carried])),
        keys,
        ["created_at", "exec_id"],
        list(carried),
        as_name="a",
    )
    return paired.filter(F.col("a").isNotNull()).select(*keys, "a", F.struct(*carried).alias("b"))


def execution_pairs(executions: DataFrame, pairs: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The executions named by ``pairs(a_id, b_id)`` side by side; pairs of an unknown id drop out."""
    side = executions.select("exec_id", F.struct(*carried).alias("s"))
    a = side.select(F.col("exec_id").alias("a_id"), F.col("s").alias("a"))
    b = side.select(F.col("exec_id").alias("b_id"), F.col("s").alias("b"))
    return pairs.join(a, "a_id").join(b, "b_id")


def time_difference_pct() -> Column:
    return round_half_up(ratio(A.total_time_ms - B.total_time_ms, A.total_time_ms) * 100, 1)


def cost_difference_pct() -> Column:
    return round_half_up(ratio(A.query_cost - B.query_cost, A.query_cost) * 100, 1)


def _timed() -> Column:
    return A.total_time_ms.isNotNull() & B.total_time_ms.isNotNull()


def winner() -> Column:
    """Smaller total time; a tie goes to b."""
    return F.when(~_timed(), "unknown").when(A.total_time_ms < B.total_time_ms, "a").otherwise("b")


def perf_diff() -> Column:
    """Differences relative to a; a tie reads ``time_faster = a``."""
    time, cost = time_difference_pct(), cost_difference_pct()
    return F.when(
        _timed(),
        F.struct(
            time.alias("time_difference_pct"),
            cost.alias("cost_difference_pct"),
            F.when(time > 0, "b").otherwise("a").alias("time_faster"),
            F.when(cost > 0, "b").otherwise("a").alias("cost_cheaper"),
        ),
    )


def _shown(value: Column, digits: int = 1) -> Column:
    return F.round(value.cast("decimal(28,10)"), digits).cast(f"decimal(28,{digits})").cast("string")


def slower_gap() -> Column:
    """Difference of the total times in percent of the larger one."""
    larger = F.greatest(A.total_time_ms, B.total_time_ms)
    return F.when(_timed(), ratio(F.abs(A.total_time_ms - B.total_time_ms), larger) * 100)


def _faster() -> Column:
    return F.when(A.total_time_ms < B.total_time_ms, "A").otherwise("B")


def _one_sided(fact_a: Column, fact_b: Column, template: str) -> Column:
    """``template`` filled (B, A) when the fact holds for a only, (A, B) when for b only."""
    return F.when(fact_a & ~fact_b, fill(template, "B", "A")).when(fact_b & ~fact_a, fill(template, "A", "B"))


def comparison_insights() -> Column:
    gap = round_half_up(slower_gap(), 1)
    seq_a, seq_b = (F.coalesce(m.seq_scan_present, F.lit(False)) for m in (A, B))
    return lines(
        F.when(gap > fixed.FASTER_PCT, fill(fixed.PAIR_FASTER, _faster(), _shown(gap))),
        _one_sided(seq_a, seq_b, fixed.PAIR_SCANS),
    )


def pct_difference(a: Column, b: Column) -> Column:
    """``x.x% A|B faster``; NULL when a side is missing or zero, or below one percent."""
    pct = F.abs(ratio(b - a, a)) * 100
    known = (a != 0) & (b != 0) & (a != b) & (pct >= fixed.SMALLEST_DIFFERENCE_PCT)
    return F.when(
        known, F.concat(_shown(pct), F.lit("% "), F.when(a < b, "A").otherwise("B"), F.lit(" faster"))
    )


def metrics_table(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Up to twelve rows per pair: label, both values, difference and what it affects."""

    def side(pct: Column, word: str, better: Column) -> Column:
        text = F.concat(_shown(F.abs(pct)), F.lit("% "), F.upper(better), F.lit(f" {word}"))
        return F.when(pct != 0, text)

    def number(m: Metrics, field: str) -> Column:
        return F.nullif(getattr(m, field).cast("double"), F.lit(0.0))

    def text(value: Column) -> Column:
        return round_half_up(value, 3).cast("string")

    def row(label: str, a: Column, b: Column, difference: Column, impact: Column, shown: Column = F.lit(True)) -> Column:
        made = F.struct(
            F.lit(label).alias("label"),
            a.alias("value_a"),
            b.alias("value_b"),
            F.coalesce(difference, F.lit("Same")).alias("difference"),
            impact.alias("impact"),
        )
        return F.when(shown, made)

    def numeric(label: str, field: str, impact: str, compared: bool, shown: Column = F.lit(True)) -> Column:
        a, b = number(A, field), number(B, field)
        difference = pct_difference(a, b) if compared else F.lit(None).cast("string")
        return row(label, text(a), text(b), difference, F.lit(impact), shown)

    def names(label: str, field: str, impact: str) -> Column:
        def joined(m: Metrics) -> Column:
            return F.nullif(F.array_join(getattr(m, field), ", "), F.lit(""))

        return row(label, joined(A), joined(B), F.lit(None).cast("string"), F.lit(impact), A.any(field) | B.any(field))

    diff = F.col("_diff")
    time, cost = diff["time_difference_pct"], diff["cost_difference_pct"]
    rows = F.array(
        row(
            "Total Time",
            text(number(A, "total_time_ms")),
            text(number(B, "total_time_ms")),
            side(time, "faster", diff["time_faster"]),
            time_impact(time),
        ),
        row(
            "Query Cost",
            text(number(A, "query_cost")),
            text(number(B, "query_cost")),
            side(cost, "cheaper", diff["cost_cheaper"]),
            cost_impact(cost),
        ),
        numeric("Rows Returned", "rows_returned", "Data Volume", False),
        numeric("Planning Time", "planning_time_ms", "Query Complexity", True),
        numeric("Execution Time", "execution_time_ms", "Resource Usage", True),
        numeric("Rows Scanned", "rows_scanned", "I/O Efficiency", True),
        numeric("Peak Memory", "memory_usage_kb", "Resource Usage", True, A.over("memory_usage_kb", 0) | B.over("memory_usage_kb", 0)),
        numeric("Parallel Workers", "workers_launched", "Parallelization", False, A.over("workers_launched", 0) | B.over("workers_launched", 0)),
        numeric("Plan Nodes", "node_count", "Complexity", False),
        names("Scan Methods", "scan_types", "Access Pattern"),
        names("Indexes Used", "index_usage", "Index Efficiency"),
        names("Sort Methods", "sort_methods", "Memory Efficiency"),
    )
    measured = pairs.select(*keys, "a", "b", perf_diff().alias("_diff"))
    return measured.select(*keys, F.inline_outer(F.array_compact(rows))).filter(F.col("label").isNotNull())


def rows_per_ms(m: Metrics) -> Column:
    rows = F.coalesce(F.nullif(m.rows_returned, F.lit(0)), m.rows_scanned, F.lit(0))
    return F.coalesce(F.when(m.total_time_ms > 0, ratio(rows, m.total_time_ms)), F.lit(0.0))


def throughput() -> Column:
    """Which side handles more rows per millisecond, compared as numbers at two decimals."""
    a, b = round_half_up(rows_per_ms(A), 2), round_half_up(rows_per_ms(B), 2)
    return F.when(a == b, "Same").when(a > b, "A more efficient").otherwise("B more efficient")


def score_gap() -> Column:
    a, b = optimization_score(A), optimization_score(B)
    better = F.when(a > b, "A").otherwise("B")
    text = fill("%s: %s points better", better, F.abs(a - b))
    return F.when(F.abs(a - b) > fixed.SCORE_GAP, text).otherwise(fixed.PAIR_SIMILAR)


def _both(finding: Callable[[Metrics, str], list[Column] | Column]) -> list[Column]:
    """A finding for a, then for b."""
    found = []
    for m, name in ((A, "A"), (B, "B")):
        made = finding(m, name)
        found += made if isinstance(made, list) else [made]
    return found


def performance_findings() -> Column:
    def of(m: Metrics, name: str) -> list[Column]:
        ms = round_half_up(m.total_time_ms, 3)
        workers = fill(fixed.PAIR_WORKERS, name, m.workers_launched, m.workers_planned)
        large = m.seq & m.over("rows_scanned", fixed.LARGE_SCAN_ROWS)
        return [
            slow_text(m, fill(fixed.PAIR_VERY_SLOW, name, ms), fill(fixed.PAIR_SLOW, name, ms)),
            F.when(m.over("memory_usage_kb", fixed.HIGH_MEMORY_KB), fill(fixed.PAIR_MEMORY, name, m.memory_usage_kb)),
            F.when(m.disk_sort, fill(fixed.PAIR_DISK_SORT, name)),
            F.when(m.short_of_workers, workers),
            F.when(large, fill(fixed.PAIR_LARGE_SCAN, name, m.rows_scanned)),
        ]

    return lines(*_both(of), empty=fixed.TEXT_NO_ISSUES)


def index_findings() -> Column:
    def of(m: Metrics, name: str) -> Column:
        used = fill(fixed.PAIR_INDEXES, name, m.index_count, F.array_join(m.index_usage, ", "))
        return F.when(m.any("index_usage"), used).otherwise(fill(fixed.PAIR_NO_INDEXES, name))

    neither = F.when(~A.seq & ~B.seq, fixed.PAIR_BOTH_INDEXED)
    return lines(*_both(of), F.coalesce(_one_sided(A.seq, B.seq, fixed.PAIR_BETTER_INDEXES), neither))


def opportunities() -> Column:
    a_slower = A.total_time_ms > B.total_time_ms
    strategy = F.when(a_slower, fill(fixed.PAIR_STRATEGY, "A", "B")).otherwise(fill(fixed.PAIR_STRATEGY, "B", "A"))
    kb_a, kb_b = A.memory_usage_kb, B.memory_usage_kb
    return lines(
        F.when(slower_gap() > fixed.STRATEGY_PCT, strategy),
        F.when(kb_a > kb_b * 2, fill(fixed.PAIR_MORE_MEMORY, "A")).when(kb_b > kb_a * 2, fill(fixed.PAIR_MORE_MEMORY, "B")),
        *_both(
            lambda m, name: F.when(
                (m.workers_launched == 0) & m.over("total_time_ms", fixed.SLOW_MS), fill(fixed.PAIR_PARALLEL, name)
            )
        ),
        *_both(lambda m, name: F.when(m.disk_sort, fill(fixed.PAIR_WORK_MEM, name))),
        *_both(
            lambda m, name: F.when(m.seq & m.over("rows_scanned", fixed.SCANNED_ROWS), fill(fixed.PAIR_ADD_INDEXES, name))
        ),
        empty=fixed.PAIR_OPTIMIZED,
    )


def comparison_recommendations() -> Column:
    """array<struct(priority, text)>, most urgent first."""
    slow = A.over("total_time_ms", fixed.SLOW_MS) | B.over("total_time_ms", fixed.SLOW_MS)
    apart = F.abs(A.total_time_ms - B.total_time_ms) > fixed.SLOWER_BY_MS
    found = (
        ("HIGH", slow, F.lit(fixed.PAIR_HIGH)),
        ("MEDIUM", apart, fill(fixed.PAIR_MEDIUM, _faster())),
        ("LOW", F.lit(True), F.lit(fixed.PAIR_LOW)),
    )
    items = [F.when(hit, F.struct(F.lit(p).alias("priority"), text.alias("text"))) for p, hit, text in found]
    return F.array_compact(F.array(*items))


COMPARISONS: dict[str, Callable[[], Column]] = {
    "performance": perf_diff,
    "winner": winner,
    "insights": comparison_insights,
    "time_impact": lambda: time_impact(time_difference_pct()),
    "cost_impact": lambda: cost_impact(cost_difference_pct()),
    "throughput": throughput,
    "efficiency_a": lambda: efficiency_label(A),
    "efficiency_b": lambda: efficiency_label(B),
    "bottlenecks_a": lambda: bottlenecks(A),
    "bottlenecks_b": lambda: bottlenecks(B),
    "score_a": lambda: optimization_score(A),
    "score_b": lambda: optimization_score(B),
    "grade_a": lambda: score_grade(optimization_score(A)),
    "grade_b": lambda: score_grade(optimization_score(B)),
    "score_gap": score_gap,
    "performance_findings": performance_findings,
    "index_findings": index_findings,
    "opportunities": opportunities,
    "recommendations": comparison_recommendations,
}


def compare_executions(pairs: DataFrame, names: Sequence[str] = tuple(COMPARISONS)) -> DataFrame:
    """Add the named comparisons of each pair as columns."""
    return pairs.select("*", *[COMPARISONS[n]().alias(n) for n in names])


def comparison_document() -> Column:
    """One nested document per pair: both executions and their comparison."""
    return F.to_json(
        F.struct(
            F.struct("a", "b").alias("executions"),
            F.struct("performance", "winner", "insights").alias("comparison"),
        )
    )


def plan_node_diff(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per pair and (node type, relation): how often it occurs in a and in b, and where.

    Both node arrays lie in the pair's row, so they are matched and counted there,
    and only the counts leave it.
    """

    def labels(side: str) -> Column:
        return F.transform(F.col(f"{side}.nodes"), lambda n: F.struct(n["node_type"], n["relation_name"]))

    def counted(key: Column) -> Column:
        def times(array: str) -> Column:
            return F.size(F.filter(array, lambda x: x.eqNullSafe(key))).cast("long")

        return F.struct(
            key["node_type"].alias("node_type"),
            key["relation_name"].alias("relation_name"),
            times("_a").alias("count_a"),
            times("_b").alias("count_b"),
        )

    listed = pairs.select(*keys, labels("a").alias("_a"), labels("b").alias("_b"))
    counts = F.transform(F.array_distinct(F.concat("_a", "_b")), counted)
    each = listed.select(*keys, F.inline_outer(counts)).filter(F.col("count_a").isNotNull())
    place = F.when(F.col("count_b") == 0, "only a").when(F.col("count_a") == 0, "only b").otherwise("common")
    return each.withColumn("place", place)
