"""Plan JSON -> nodes, inside the row.

A plan is one JSON value in one row, so its nodes are taken apart there: no
shuffle and no repeated scan per level.  ``aggregate`` walks one tree level per
step; a plan has at most as many levels as its text has ``"Plans"`` keys, plus
one, so that many steps always suffice.  The JSON parser reads 1,000 nested
values, which is about 490 levels; a deeper plan has a state of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.constants import NODE_CLASSES, PLAN_UNREADABLE
from fleetpulse.functions.ladders import by_pattern

# Fixed keys of a plan node: output field, key, type.
NODE_KEYS = (
    ("node_type", "Node Type", "string"),
    ("relation_name", "Relation Name", "string"),
    ("startup_cost", "Startup Cost", "double"),
    ("total_cost", "Total Cost", "double"),
    ("plan_rows", "Plan Rows", "bigint"),
    ("plan_width", "Plan Width", "bigint"),
    ("actual_time", "Actual Total Time", "double"),
    ("actual_rows", "Actual Rows", "bigint"),
    ("actual_loops", "Actual Loops", "bigint"),
    ("filter", "Filter", "string"),
    ("index_cond", "Index Cond", "string"),
    ("hash_cond", "Hash Cond", "string"),
    ("join_filter", "Join Filter", "string"),
    ("join_type", "Join Type", "string"),
    ("index_name", "Index Name", "string"),
    ("sort_method", "Sort Method", "string"),
    ("peak_memory", "Peak Memory Usage", "bigint"),
    ("workers_planned", "Workers Planned", "bigint"),
    ("workers_launched", "Workers Launched", "bigint"),
    ("shared_hit_blocks", "Shared Hit Blocks", "bigint"),
    ("shared_read_blocks", "Shared Read Blocks", "bigint"),
    ("shared_dirtied_blocks", "Shared Dirtied Blocks", "bigint"),
    ("local_hit_blocks", "Local Hit Blocks", "bigint"),
    ("local_read_blocks", "Local Read Blocks", "bigint"),
    ("temp_read_blocks", "Temp Read Blocks", "bigint"),
    ("temp_written_blocks", "Temp Written Blocks", "bigint"),
)
SORT_KEY = ("sort_key", "Sort Key", "array<string>")
BUFFER_FIELDS = tuple(f for f, _, _ in NODE_KEYS if f.endswith("_blocks"))

ALL_FIELDS = (*(f for f, _, _ in NODE_KEYS), "sort_key")
#: A tree with so many levels may be nested deeper than the JSON parser reads (1,000 values, two a level).
DEEP_LEVELS = 450

_EDGE = "array<struct<path:array<int>,node:variant>>"


def _typed(fields: Sequence[str]) -> str:
    """SQL type of the chosen keys of a node."""
    known = {f: (key, kind) for f, key, kind in (*NODE_KEYS, SORT_KEY)}
    return "struct<" + ",".join(f"`{known[f][0]}`:{known[f][1]}" for f in fields) + ">"


def _tree(fields: Sequence[str]) -> str:
    """SQL for the array of (path, typed fields) of the tree under ``_root``.

    Only the level at hand keeps its subtrees; a finished node keeps its fields.
    """
    typed = _typed(fields)
    children = """flatten(transform(s.edge, e -> transform(
        coalesce(try_variant_get(e.node, '$.Plans', 'array<variant>'), cast(array() AS array<variant>)),
        (c, k) -> named_struct('path', concat(e.path, array(k)), 'node', c))))"""
    read = f"transform(s.edge, e -> named_struct('path', e.path, 'f', try_variant_get(e.node, '$', '{typed}')))"
    return f"""aggregate(
        sequence(0, regexp_count(_plan_text, '"Plans"')),
        named_struct('done', cast(array() AS array<struct<path:array<int>,f:{typed}>>),
                     'edge', array(named_struct('path', cast(array() AS array<int>), 'node', _root))),
        (s, i) -> CASE WHEN size(s.edge) = 0 THEN s
                  ELSE named_struct('done', concat(s.done, {read}), 'edge', {children}) END,
        s -> s.done)"""


def _named(fields: Sequence[str]) -> str:
    """SQL from (path, typed fields) to the node struct."""
    keys = {f: key for f, key, _ in (*NODE_KEYS, SORT_KEY)}
    shown = ", ".join(f"'{f}', x.f.`{keys[f]}`" for f in fields)
    return f"transform(_tree, x -> named_struct('path', x.path, 'level', size(x.path), {shown}))"


def _with(executions: DataFrame, plan: str, fields: Sequence[str], tree: str) -> DataFrame:
    text = F.col(plan)
    document = F.try_parse_json(text)
    first = F.coalesce(F.try_variant_get("_doc", "$[0]", "variant"), F.col("_doc"))
    blank = text.isNull() | (F.trim(text) == "")
    deep = F.regexp_count(text, F.lit('"Plans"')) >= DEEP_LEVELS
    parsed = (
        executions.withColumn("_plan_text", text)
        .withColumn("_doc", document)
        .withColumn("_first", first)
        .withColumn("_root", F.try_variant_get("_first", "$.Plan", "variant"))
        .withColumn("_root", F.when(~F.is_variant_null("_root"), F.col("_root")))
    )
    unread = F.col("_doc").isNull()
    state = (
        F.when(blank, "absent")
        .when(unread & deep, "too_deep")
        .when(unread, "malformed")
        .when(F.col("_root").isNull(), "empty")
        .otherwise("ok")
    )
    return (
        parsed.withColumn("plan_state", state)
        .withColumn("planning_time", F.try_variant_get("_first", '$["Planning Time"]', "double"))
        .withColumn("execution_time", F.try_variant_get("_first", '$["Execution Time"]', "double"))
        .withColumn("_tree", F.expr(f"CASE WHEN _root IS NOT NULL THEN {tree} END"))
        .withColumn("nodes", F.sort_array(F.expr(_named(fields))))
        .drop("_plan_text", "_doc", "_first", "_root", "_tree")
    )


def with_nodes(executions: DataFrame, plan: str = "execution_plan", fields: Sequence[str] = ALL_FIELDS) -> DataFrame:
    """Add ``plan_state``, ``planning_time``, ``execution_time`` and ``nodes`` (pre-order) with the chosen ``fields``.

    ``plan_state`` is ``absent`` (no text), ``malformed`` (not JSON), ``too_deep``
    (not read, with ``DEEP_LEVELS`` levels or more: the parser stops at 1,000
    nested values), ``empty`` (JSON without a plan) or ``ok``; every row is kept.
    The plan may be an object or a list of one object.
    """
    return _with(executions, plan, fields, _tree(fields))


def with_root(executions: DataFrame, plan: str = "execution_plan", fields: Sequence[str] = ALL_FIELDS) -> DataFrame:
    """Like ``with_nodes``, but ``nodes`` holds the root alone and no other node is read."""
    root_only = f"array(named_struct('path', cast(array() AS array<int>), 'f', try_variant_get(_root, '$', '{_typed(fields)}')))"
    return _with(executions, plan, fields, root_only)


def flatten_plan(with_nodes_df: DataFrame, keys: tuple[str, ...] = ("exec_id",)) -> DataFrame:
    """One row per plan node in pre-order position ``ord``.

    The outer generator with a filter behind it keeps Spark from testing the
    array's size ahead of the generator, which would parse every plan again.
    """
    each = with_nodes_df.select(*keys, F.posexplode_outer("nodes").alias("ord", "node"))
    return each.filter(F.col("node").isNotNull()).select(*keys, "ord", "node.*")


def root() -> Column:
    return F.try_element_at(F.col("nodes"), F.lit(1))


def plan_error_document(plan: str = "execution_plan") -> Column:
    """What a malformed plan is replaced with."""
    return F.when(
        F.col("plan_state") == "malformed",
        F.to_json(F.struct(F.lit(PLAN_UNREADABLE).alias("error"), F.col(plan).alias("raw_output"))),
    )


def node_class(node_type: Column) -> Column:
    """Operation class of a node type; the first matching pattern decides."""
    return by_pattern(F.lower(node_type), NODE_CLASSES)
