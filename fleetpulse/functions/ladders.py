"""Step functions: a value falls into the first band whose bound holds.

The bands are tables of fixed values; a table ends in the label for the rest.
Bands are contiguous, so no decimal value falls between two of them.  Where a
label carries a mark in the original wording, only the word is kept.
"""

from __future__ import annotations

from functools import reduce
from operator import ge, gt, le, lt

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse import constants as fixed
from fleetpulse.functions.numbers import ratio


def _ladder(tests: list[tuple[Column, object]], rest: object) -> Column:
    (first, label), *others = tests
    return reduce(lambda steps, t: steps.when(*t), others, F.when(first, label)).otherwise(rest)


def _banded(compare):
    def band(value: Column, table: tuple, missing: str | None = None) -> Column:
        *bounds, rest = table
        steps = _ladder([(compare(value, bound), label) for bound, label in bounds], rest)
        return steps if missing is None else F.when(value.isNull(), missing).otherwise(steps)

    return band


upto = _banded(le)
below = _banded(lt)
at_least = _banded(ge)
above = _banded(gt)


def by_pattern(text: Column, table: tuple) -> Column:
    *patterns, rest = table
    return _ladder([(text.rlike(pattern), label) for pattern, label in patterns], rest)


def by_words(text: Column, table: tuple) -> Column:
    """Label of the first entry all of whose words occur in the lower-case text."""
    *entries, rest = table
    lower = F.lower(text)
    tests = [(reduce(lambda a, b: a & b, [lower.contains(w) for w in words]), label) for words, label in entries]
    return _ladder(tests, rest)


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def performance_class(total_ms: Column) -> Column:
    return below(total_ms, fixed.CLASS_BELOW, "performance-unknown")


def performance_rating(total_ms: Column) -> Column:
    return upto(total_ms, fixed.RATING_UPPER, "Unknown")


def benchmark_text(total_ms: Column) -> Column:
    return upto(total_ms, fixed.BENCHMARK_UPPER, "")


def cost_level(cost: Column) -> Column:
    return upto(cost, fixed.COST_UPPER, "")


def memory_level(kb: Column) -> Column:
    return upto(kb, fixed.MEMORY_UPPER, "")


def planning_ratio_insight(planning_ms: Column, execution_ms: Column) -> Column:
    share = ratio(planning_ms, execution_ms)
    small, efficient, balanced = fixed.PLANNING_SHARE_SMALL
    rest = F.when(share < small, efficient).otherwise(balanced)
    label = above(share, (*fixed.PLANNING_SHARE_ABOVE, rest))
    return F.when(planning_ms.isNotNull() & (execution_ms > 0), label).otherwise("")


def metric_category(name: Column) -> Column:
    return by_pattern(name, fixed.METRIC_CATEGORIES)


def metric_status(name: Column, value: Column) -> Column:
    return (
        F.when(name.rlike("rate|hit"), above(value, fixed.HIT_STATUS_ABOVE))
        .when(name.contains("time"), below(value, fixed.TIME_STATUS_BELOW))
        .otherwise("neutral")
    )


def bloat_severity(dead_pct: Column) -> Column:
    return F.when(dead_pct > fixed.DANGEROUS_BLOAT_PCT, "danger").otherwise("warning")


def time_impact(diff_pct: Column) -> Column:
    known = F.coalesce(diff_pct != 0, F.lit(False))
    return F.when(known, above(F.abs(diff_pct), fixed.TIME_IMPACT_ABOVE)).otherwise("Negligible")


def cost_impact(diff_pct: Column) -> Column:
    known = F.coalesce(diff_pct != 0, F.lit(False))
    return F.when(known, above(F.abs(diff_pct), fixed.COST_IMPACT_ABOVE)).otherwise("Same")


def score_grade(score: Column) -> Column:
    return at_least(score, fixed.GRADE_LOWER)
