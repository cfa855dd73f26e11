"""Node store: every distinct plan of a log parsed once, found again by its hash.

Executions repeat plans, and queries repeat over the same log.  ``add`` parses
the plans that the store does not have yet and appends their nodes; afterwards a
query joins its executions to them by ``plan_key`` and reads only the node fields
it asks for, since each field is an array column of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.plans.tree import ALL_FIELDS, NODE_KEYS, SORT_KEY, with_nodes
from fleetpulse.sources.commits import CommittedTable

_KINDS = {f: kind for f, _, kind in (*NODE_KEYS, SORT_KEY)}
_PLACE = {"path": "array<array<int>>", "level": "array<int>"}
SCHEMA = ", ".join(
    ["plan_key string", "plan_state string", "planning_time double", "execution_time double"]
    + [f"{name} {kind}" for name, kind in _PLACE.items()]
    + [f"{f} array<{kind}>" for f, kind in _KINDS.items()]
    + ["shard string"]
)


def plan_key(plan: Column) -> Column:
    """Key of a plan's text; NULL where there is none."""
    return F.when(F.trim(plan) != "", F.sha2(plan, 256))


def keyed(executions: DataFrame, plan: str = "execution_plan") -> DataFrame:
    """The log with ``plan_key`` in the place of the plan's text."""
    return executions.withColumn("plan_key", plan_key(F.col(plan))).drop(plan)


class PlanStore:
    """The parsed plans below a folder; one shard per first digit of the key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = CommittedTable(spark, path, ["shard"])

    def plans(self) -> DataFrame:
        return self.table.read(SCHEMA)

    def add(self, executions: DataFrame, plan: str = "execution_plan", run: str | None = None) -> int:
        """Parse the plans that are not in the store yet; how many there were."""
        texts = executions.select(plan_key(F.col(plan)).alias("plan_key"), F.col(plan).alias("_plan")).filter("plan_key IS NOT NULL")
        before = self.table.manifest()
        if before.folders:
            texts = texts.join(self.plans().select("plan_key"), "plan_key", "left_anti")
        parsed = with_nodes(texts.groupBy("plan_key").agg(F.first("_plan").alias("_plan")), "_plan")
        arrays = [F.col(f"nodes.{f}").alias(f) for f in (*_PLACE, *_KINDS)]
        shard = F.substring("plan_key", 1, 1).alias("shard")
        self.table.append(parsed.select("plan_key", "plan_state", "planning_time", "execution_time", *arrays, shard), run)
        return sum(self.table.manifest().folders.values()) - sum(before.folders.values())

    def with_nodes(self, executions: DataFrame, fields: Sequence[str] = ALL_FIELDS) -> DataFrame:
        """Like ``tree.with_nodes`` for a ``keyed`` log.  An execution whose plan was not added has the state ``unread``.

        A plan that many executions share is a skewed side of the join, which Spark splits.
        """
        nodes = F.arrays_zip(*[F.col(c) for c in (*_PLACE, *fields)]).alias("nodes")
        parsed = self.plans().select("plan_key", "plan_state", "planning_time", "execution_time", nodes)
        state = F.when(F.col("plan_key").isNull(), "absent").otherwise(F.coalesce("plan_state", F.lit("unread")))
        return executions.join(parsed, "plan_key", "left").withColumn("plan_state", state)
