"""Scores, labels and findings of single executions: projections over ``plan_metrics`` rows.

Bands, points, limits and texts are the fixed values of ``fleetpulse.constants``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse import constants as fixed
from fleetpulse.functions import ladders
from fleetpulse.functions.ladders import above, at_least, below, clamp_score, upto
from fleetpulse.functions.numbers import format_memory, ratio, round_half_up, timing_percentage


class Metrics:
    """Columns of one execution's metrics, plain or inside a struct (``side``), and facts read from them."""

    def __init__(self, side: str = "") -> None:
        self.prefix = f"{side}." if side else ""

    def __getattr__(self, name: str) -> Column:
        return F.col(self.prefix + name)

    def has(self, field: str, value: str) -> Column:
        return F.coalesce(F.array_contains(getattr(self, field), value), F.lit(False))

    def any(self, field: str) -> Column:
        return F.coalesce(F.size(getattr(self, field)) > 0, F.lit(False))

    def over(self, field: str, bound: float) -> Column:
        return F.coalesce(getattr(self, field) > bound, F.lit(False))

    @property
    def seq(self) -> Column:
        return self.has("scan_types", fixed.SEQ_SCAN)

    @property
    def index(self) -> Column:
        return F.coalesce(F.exists(self.scan_types, lambda t: t.contains("Index")), F.lit(False))

    @property
    def disk_sort(self) -> Column:
        return self.has("sort_methods", fixed.DISK_SORT)

    @property
    def short_of_workers(self) -> Column:
        return F.coalesce(self.workers_planned > self.workers_launched, F.lit(False))

    @property
    def index_count(self) -> Column:
        return F.greatest(F.coalesce(F.size(self.index_usage), F.lit(0)), F.lit(0))

    @property
    def selectivity(self) -> Column:
        return ratio(self.rows_returned, self.rows_scanned)


def scored(*parts: Column) -> Column:
    """100 with all parts added."""
    return sum(parts, F.lit(100))


def points(table: dict[str, int], **facts: Column) -> Column:
    """Points of the facts that hold."""
    return sum((F.when(fact, table[name]).otherwise(0) for name, fact in facts.items()), F.lit(0))


def lines(*texts: Column, empty: str | None = None) -> Column:
    """Array of the texts that apply; ``empty`` is the single line when none does."""
    found = F.array_compact(F.array(*texts))
    return found if empty is None else F.when(F.size(found) == 0, F.array(F.lit(empty))).otherwise(found)


def plan_efficiency_score(m: Metrics) -> Column:
    io = F.when(m.rows_scanned > 0, below(m.selectivity * 100, fixed.PLAN_IO_BELOW)).otherwise(0)
    facts = points(
        fixed.PLAN_POINTS,
        index=m.any("index_usage"),
        large_seq_scan=m.seq & m.over("rows_scanned", fixed.SCANNED_ROWS),
        disk_sort=m.disk_sort,
        workers=m.over("workers_launched", 0),
    )
    label = at_least(clamp_score(scored(io, facts)), fixed.PLAN_EFFICIENCY_LOWER)
    return F.when(m.rows_returned.isNull() | m.rows_scanned.isNull(), "N/A").otherwise(label)


def overall_score(m: Metrics) -> Column:
    facts = points(
        fixed.OVERALL_POINTS,
        index=m.any("index_usage"),
        workers=m.over("workers_launched", 0),
        disk_sort=m.disk_sort,
    )
    score = scored(above(m.total_time_ms, fixed.OVERALL_TIME_ABOVE), above(m.query_cost, fixed.OVERALL_COST_ABOVE), facts)
    unknown = m.total_time_ms.isNull() | m.query_cost.isNull()
    return F.when(unknown, fixed.OVERALL_UNKNOWN).otherwise(clamp_score(score))


def efficiency_label(m: Metrics) -> Column:
    """The comparison view's own efficiency label."""
    facts = points(
        fixed.COMPARED_POINTS,
        workers=m.over("workers_launched", 0),
        memory=m.over("memory_usage_kb", fixed.COMPARED_MEMORY_KB),
        index=m.any("index_usage"),
        seq_scan=m.seq,
        disk_sort=m.disk_sort,
    )
    score = clamp_score(scored(above(m.total_time_ms, fixed.COMPARED_TIME_ABOVE), facts))
    timed = F.coalesce(m.total_time_ms != 0, F.lit(False))
    return F.when(timed, at_least(score, fixed.COMPARED_EFFICIENCY_LOWER)).otherwise("N/A")


def optimization_score(m: Metrics) -> Column:
    bound, penalty = fixed.OPTIMIZATION_THIN
    thin = (m.rows_returned > 0) & (m.total_time_ms > 0) & (ratio(m.rows_returned, m.total_time_ms) < bound)
    score = scored(
        above(m.total_time_ms, fixed.OPTIMIZATION_TIME_ABOVE),
        above(m.query_cost, fixed.OPTIMIZATION_COST_ABOVE),
        F.when(thin, penalty).otherwise(0),
    )
    return F.greatest(F.lit(0), score)


def bottlenecks(m: Metrics) -> Column:
    facts = {
        "seq_scan": m.seq,
        "disk_sort": m.disk_sort,
        "memory": m.over("memory_usage_kb", fixed.HIGH_MEMORY_KB),
        "workers": m.short_of_workers,
        "indexes": ~m.any("index_usage") & m.over("rows_scanned", fixed.SCANNED_ROWS),
    }
    named = [F.when(fact, fixed.BOTTLENECK_NAMES[name]) for name, fact in facts.items()]
    return F.array_join(lines(*named, empty="None"), ", ")


def io_efficiency(m: Metrics) -> Column:
    known = m.rows_returned.isNotNull() & (m.rows_scanned > 0)
    return F.when(known, at_least(m.selectivity * 100, fixed.IO_LOWER)).otherwise("N/A")


def memory_efficiency(m: Metrics) -> Column:
    known = m.memory_usage_kb.isNotNull() & (m.rows_returned > 0)
    per_row = ratio(m.memory_usage_kb, m.rows_returned)
    return F.when(known, upto(per_row, fixed.MEMORY_PER_ROW_UPPER)).otherwise("N/A")


def parallelization(m: Metrics) -> Column:
    used = ratio(m.workers_launched, m.workers_planned) * 100
    label = F.when(m.workers_launched != 0, at_least(used, fixed.PARALLEL_LOWER)).otherwise("None")
    return F.when(m.workers_planned > 0, label).otherwise("N/A")


def _index_use(m: Metrics, labels: dict[str, str], nothing: str) -> Column:
    return (
        F.when(m.index & ~m.seq, labels["only"]).when(m.index, labels["mixed"]).when(m.seq, labels["seq"]).otherwise(nothing)
    )


def index_utilization(m: Metrics) -> Column:
    return _index_use(m, fixed.INDEX_USE_LABELS, "N/A")


def index_impact(m: Metrics) -> Column:
    text = _index_use(m, fixed.INDEX_USE_IMPACT, fixed.INDEX_USE_IMPACT["none"])
    return F.when(m.any("scan_types"), text).otherwise("N/A")


def io_impact(m: Metrics) -> Column:
    """Selectivity text; more rows returned than scanned counts as poor."""
    poor = fixed.IO_IMPACT_LOWER[-1]
    text = F.when(m.selectivity > 1, poor).otherwise(at_least(m.selectivity, fixed.IO_IMPACT_LOWER))
    return F.when(m.rows_returned.isNull() | m.rows_scanned.isNull(), "N/A").otherwise(text)


def memory_impact(m: Metrics) -> Column:
    text = upto(ratio(m.memory_usage_kb, m.rows_returned), fixed.MEMORY_IMPACT_UPPER)
    return F.when(m.memory_usage_kb.isNull() | m.rows_returned.isNull(), "N/A").otherwise(text)


def parallel_impact(m: Metrics) -> Column:
    text = fixed.PARALLEL_IMPACT
    all_used = m.workers_launched == m.workers_planned
    used = F.when(m.workers_launched == 0, text["none"]).when(all_used, text["full"]).otherwise(text["part"])
    return F.when(m.workers_planned.isNotNull(), used).otherwise("N/A")


def slow_text(m: Metrics, very_slow: Column | str, slow: Column | str) -> Column:
    too_slow = m.total_time_ms > fixed.VERY_SLOW_MS
    return F.when(too_slow, very_slow).when(m.total_time_ms > fixed.SLOW_MS, slow)


def performance_issues(m: Metrics) -> Column:
    return lines(
        slow_text(m, fixed.TEXT_VERY_SLOW, fixed.TEXT_SLOW),
        F.when(m.over("memory_usage_kb", fixed.HIGH_MEMORY_KB), fixed.TEXT_MEMORY),
        F.when(m.disk_sort, fixed.TEXT_DISK_SORT),
        F.when(m.seq & m.over("rows_scanned", fixed.LARGE_SCAN_ROWS), fixed.TEXT_LARGE_SCAN),
        F.when(m.short_of_workers, fixed.TEXT_WORKERS),
        empty=fixed.TEXT_NO_ISSUES,
    )


def plan_optimizations(m: Metrics) -> Column:
    idle = F.coalesce(m.workers_launched, F.lit(0)) == 0
    unindexed = ~m.any("index_usage") & m.over("rows_scanned", fixed.SCANNED_ROWS)
    return lines(
        F.when(m.seq, fixed.TEXT_ADD_INDEXES),
        F.when(m.disk_sort, fixed.TEXT_WORK_MEM),
        F.when(idle & m.over("total_time_ms", fixed.SLOW_MS), fixed.TEXT_PARALLEL),
        F.when(unindexed, fixed.TEXT_INDEXES),
        F.when(m.any("join_types") & m.over("total_time_ms", fixed.JOIN_REVIEW_MS), fixed.TEXT_JOINS),
        empty=fixed.TEXT_OPTIMIZED,
    )


def cost_per_row(m: Metrics) -> Column:
    """Cost per result row; the plan's row count stands in when no result rows are known."""
    rows = F.coalesce(F.nullif(m.result_rows_count, F.lit(0)), m.rows_returned)
    return round_half_up(F.when(rows > 0, ratio(m.query_cost, rows)), 2)


def worker_utilisation(m: Metrics) -> Column:
    used = round_half_up(ratio(m.workers_launched, m.workers_planned) * 100, 0)
    return F.when(m.workers_launched > 0, used)


def rows_per_ms(m: Metrics) -> Column:
    return round_half_up(F.when(m.total_time_ms > 0, ratio(m.rows_returned, m.total_time_ms)), 4)


SCORES: dict[str, Callable[[Metrics], Column]] = {
    "performance_class": lambda m: ladders.performance_class(m.total_time_ms),
    "performance_rating": lambda m: ladders.performance_rating(m.total_time_ms),
    "benchmark": lambda m: ladders.benchmark_text(m.total_time_ms),
    "cost_level": lambda m: ladders.cost_level(m.query_cost),
    "memory_level": lambda m: ladders.memory_level(m.memory_usage_kb),
    "memory_text": lambda m: format_memory(m.memory_usage_kb),
    "plan_efficiency": plan_efficiency_score,
    "overall_score": overall_score,
    "optimization_score": optimization_score,
    "score_grade": lambda m: ladders.score_grade(optimization_score(m)),
    "efficiency_label": efficiency_label,
    "bottlenecks": bottlenecks,
    "io_efficiency": io_efficiency,
    "memory_efficiency": memory_efficiency,
    "parallelization": parallelization,
    "index_utilization": index_utilization,
    "io_impact": io_impact,
    "memory_impact": memory_impact,
    "parallel_impact": parallel_impact,
    "index_impact": index_impact,
    "planning_insight": lambda m: ladders.planning_ratio_insight(m.planning_time_ms, m.execution_time_ms),
    "planning_pct": lambda m: timing_percentage(m.planning_time_ms, m.total_time_ms),
    "execution_pct": lambda m: timing_percentage(m.execution_time_ms, m.total_time_ms),
    "cost_per_row": cost_per_row,
    "io_efficiency_pct": lambda m: round_half_up(m.selectivity * 100, 1),
    "worker_utilisation": worker_utilisation,
    "rows_per_ms": rows_per_ms,
    "performance_issues": performance_issues,
    "plan_optimizations": plan_optimizations,
}


def score_executions(df: DataFrame, names: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """The named scores and labels of each execution in one projection; no shuffle."""
    m = Metrics()
    return df.select("*", *[SCORES[n](m).alias(n) for n in names])


def recommendation_priority(text: Column, position: Column) -> Column:
    """By what the suggestion is about, else by its place in the list."""
    t = F.lower(text)
    place = F.when(position == 0, "HIGH").when(position <= 2, "MEDIUM").otherwise("LOW")
    about_index = t.contains("index") & t.rlike("avoid|eliminate")
    return F.when(about_index, "HIGH").when(t.rlike("work_mem|memory"), "MEDIUM").otherwise(place)


def recommendation_impact(text: Column) -> Column:
    return ladders.by_words(text, fixed.RECOMMENDATION_IMPACTS)


def recommendation_hint(text: Column) -> Column:
    return ladders.by_words(text, fixed.RECOMMENDATION_HINTS)


def recommendations(df: DataFrame, keys: tuple[str, ...] = ("exec_id",), source: str = "suggestions") -> DataFrame:
    """One row per suggestion with its priority, expected gain and hint."""
    rows = df.select(*keys, F.posexplode_outer(source).alias("position", "suggestion")).filter(
        F.col("suggestion").isNotNull()
    )
    text, position = F.col("suggestion"), F.col("position")
    return rows.select(
        "*",
        recommendation_priority(text, position).alias("priority"),
        recommendation_impact(text).alias("impact"),
        recommendation_hint(text).alias("hint"),
    )
