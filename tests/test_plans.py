"""Plan mining on golden plans."""

import json

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import history
from fleetpulse.plans import compare, metrics, scores, store, tree


def log(spark, *plans, **columns):
    """Executions with the given plans (dicts become EXPLAIN lists, text stays as it is)."""
    rows = []
    for i, plan in enumerate(plans):
        text = plan if plan is None or isinstance(plan, str) else json.dumps([{"Plan": plan, "Planning Time": 1.5, "Execution Time": 10.25}])
        rows.append((i, text))
    return spark.createDataFrame(rows, "exec_id bigint, execution_plan string")


def issues(spark, *plans):
    rows = metrics.with_issues(tree.with_nodes(log(spark, *plans))).orderBy("exec_id").collect()
    return [(r.slow_operations, r.suggestions, r.missing_indexes, r.issues_detected) for r in rows]


def test_rules_at_their_thresholds(spark):
    scan = {"Node Type": "Seq Scan", "Relation Name": "t"}
    got = issues(
        spark,
        {**scan, "Actual Rows": 1001},
        {**scan, "Actual Rows": 1000},
        {"Node Type": "Seq Scan", "Actual Rows": 5000},
        {"Node Type": "Sort", "Actual Total Time": 100.0},
        {"Node Type": "Sort", "Actual Total Time": 100.126},
        {"Node Type": "Nested Loop", "Actual Total Time": 50},
        {"Node Type": "Nested Loop", "Actual Total Time": 50.1},
        {"Node Type": "Hash Join", "Temp Written Blocks": 0},
        {"Node Type": "Hash Join", "Temp Written Blocks": 1},
        {"Node Type": "Hash Join"},
    )
    assert got[0] == (["Sequential scan on t (1001 rows)"], ["Consider adding an index on t to avoid full table scan"], ["t"], True)
    assert got[2][2] == [] and got[2][3]
    assert got[4][0] == ["Expensive sort operation (100.13ms)"]
    assert got[6][0] == ["Potentially expensive nested loop join"]
    assert got[8][0] == ["Hash join spilling to disk"]
    for i in (1, 3, 5, 7, 9):
        assert got[i] == ([], [], [], False)


def test_every_kind_of_text_keeps_its_row(spark):
    node = {"Node Type": "Limit", "Actual Rows": 3}
    plans = [json.dumps({"Plan": node}), json.dumps([{"Plan": node}]), "[]", "{}", "", None, '[{"Plan": {', "null", '[{"Plan": null}]']
    rows = metrics.plan_metrics(tree.with_nodes(log(spark, *plans))).orderBy("exec_id").collect()
    assert [r.plan_state for r in rows] == ["ok", "ok", "empty", "empty", "absent", "absent", "malformed", "empty", "empty"]
    assert [r.node_count for r in rows] == [1, 1] + [None] * 7
    errors = tree.with_nodes(log(spark, *plans)).select(tree.plan_error_document().alias("e")).collect()
    assert [r.e is not None for r in errors].count(True) == 1


def test_any_depth_in_pre_order(spark):
    """A chain of 150 levels with a bush at every tenth; node count equals the "Node Type" keys of the text."""
    plan = {"Node Type": "Result", "Actual Rows": 1}
    for level in range(150):
        children = [plan]
        if level % 10 == 0:
            children = [{"Node Type": f"L{level}", "Actual Rows": 1}, plan, {"Node Type": f"R{level}", "Actual Rows": 1}]
        plan = {"Node Type": f"N{level}", "Plans": children}

    def walk(node, level=0):
        yield node["Node Type"], level
        for child in node.get("Plans", []):
            yield from walk(child, level + 1)

    rows = tree.flatten_plan(tree.with_nodes(log(spark, plan))).orderBy("ord").collect()
    assert [(r.node_type, r.level) for r in rows] == list(walk(plan))
    assert len(rows) == json.dumps(plan).count('"Node Type"')


PLAN = {
    "Node Type": "Gather", "Total Cost": 100.5, "Actual Rows": 10, "Actual Total Time": 9.876, "Workers Planned": 4, "Workers Launched": 2,
    "Shared Hit Blocks": 7, "Shared Dirtied Blocks": 3,
    "Plans": [
        {
            "Node Type": "Nested Loop", "Join Type": "Left", "Actual Rows": 20,
            "Plans": [
                {"Node Type": "Index Scan", "Index Name": "i1", "Relation Name": "a", "Actual Rows": 30},
                {
                    "Node Type": "Hash Join", "Join Type": "Inner", "Peak Memory Usage": 2048,
                    "Plans": [
                        {"Node Type": "Sort", "Sort Method": "external merge", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "b", "Actual Rows": 40}]},
                        {"Node Type": "Index Scan", "Index Name": "i1", "Relation Name": "a", "Actual Rows": 5},
                    ],
                },
            ],
        }
    ],
}


def test_metrics_of_one_plan(spark):
    df = metrics.plan_metrics(tree.with_nodes(log(spark, PLAN)))
    r = df.withColumn("summary", metrics.plan_summary()).withColumn("depth", metrics.depth_estimate()).collect()[0]
    assert (r.rows_returned, r.rows_scanned, r.total_rows, r.node_count, r.max_level, r.depth) == (10, 75, 105, 7, 4, 3)
    assert (r.workers_planned, r.workers_launched, r.memory_usage_kb) == (4, 2, 2048)
    assert (r.sort_methods, r.index_usage, r.scan_types) == (["external merge"], ["i1"], ["Index Scan", "Seq Scan"])
    assert r.join_types == ["Inner Hash Join"] and r.seq_scan_present
    assert (r.planning_time_ms, r.execution_time_ms, r.total_time_ms, r.query_cost) == (1.5, 10.25, 11.75, 100.5)
    assert r.summary == "Gather (cost=100.5) rows=10 time=9.88ms"
    with_loops = df.select(metrics.join_types(include_nested_loop=True).alias("j")).collect()[0].j
    assert with_loops == ["Left Nested Loop", "Inner Hash Join"]
    buffers = metrics.plan_buffer_stats(df).collect()[0]
    assert (buffers.shared_hit_blocks, buffers.shared_dirtied_blocks, buffers.temp_read_blocks) == (7, 3, None)


def test_scoring_a_log_needs_no_shuffle(spark):
    df = metrics.with_issues(metrics.plan_metrics(tree.with_nodes(log(spark, PLAN))))
    df = df.withColumn("result_rows_count", F.lit(None).cast("bigint"))
    out = scores.score_executions(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.collect()[0]
    assert (r.overall_score, r.plan_efficiency, r.parallelization, r.index_utilization) == (100, "Good", "Fair", "Good")
    assert r.bottlenecks == "Sequential Scans, Disk Sorting, Worker Shortage"
    assert (r.cost_per_row, r.io_efficiency_pct, r.worker_utilisation) == (10.05, 13.3, 50.0)


SIDE = """struct<exec_id:bigint,total_time_ms:double,planning_time_ms:double,execution_time_ms:double,query_cost:double,rows_returned:bigint,
    rows_scanned:bigint,workers_planned:bigint,workers_launched:bigint,memory_usage_kb:bigint,sort_methods:array<string>,
    index_usage:array<string>,scan_types:array<string>,join_types:array<string>,node_count:bigint,seq_scan_present:boolean>"""


def side(time, cost=10.0, rows=100, seq=False):
    return (1, time, 1.0, time, cost, rows, rows, 0, 0, 0, [], ["i"], ["Seq Scan"] if seq else ["Index Scan"], [], 2, seq)


def compared(spark, a, b):
    return compare.compare_executions(spark.createDataFrame([(a, b)], f"a {SIDE}, b {SIDE}")).collect()[0]


def test_tie_and_zero(spark):
    tie = compared(spark, side(10.0), side(10.0))
    assert (tie.winner, tie.performance.time_faster, tie.insights) == ("b", "a", [])
    zero = compared(spark, side(0.0, 0.0), side(10.0))
    assert (zero.performance.time_difference_pct, zero.performance.cost_difference_pct, zero.winner) == (None, None, "a")
    unknown = compared(spark, side(None), side(10.0))
    assert (unknown.winner, unknown.performance) == ("unknown", None)


def test_comparison_texts(spark):
    r = compared(spark, side(4000.0, 100.0, seq=True), side(1000.0, 50.0))
    assert tuple(r.performance) == (75.0, 50.0, "b", "b")
    assert r.insights == ["Query B is 75.0% faster in execution time", "Query B uses index scans while Query A uses sequential scans"]
    assert (r.time_impact, r.cost_impact, r.winner) == ("Critical", "Moderate", "b")
    assert [x.priority for x in r.recommendations] == ["HIGH", "MEDIUM", "LOW"]


def test_throughput_is_compared_as_numbers(spark):
    assert compared(spark, side(10.0, rows=90), side(10.0, rows=100)).throughput == "B more efficient"


def test_difference_below_one_percent_is_none(spark):
    df = spark.createDataFrame([(100.0, 100.5), (100.0, 150.0), (0.0, 5.0), (None, 5.0)], "a double, b double")
    got = [r.d for r in df.select(compare.pct_difference(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [None, "50.0% A faster", None, None]


def test_node_diff_counts_and_matches_null_relations(spark):
    a = {"Node Type": "Hash Join", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "t"}, {"Node Type": "Seq Scan", "Relation Name": "t"}]}
    b = {"Node Type": "Hash Join", "Plans": [{"Node Type": "Index Scan", "Relation Name": "t"}, {"Node Type": "Seq Scan", "Relation Name": "t"}]}
    nodes = tree.with_nodes(log(spark, a, b)).select("exec_id", "nodes")
    wanted = spark.createDataFrame([(0, 1), (0, 99)], "a_id bigint, b_id bigint")
    both = compare.execution_pairs(nodes, wanted, ["nodes"])
    rows = compare.plan_node_diff(both, ["a_id", "b_id"]).collect()
    got = {(r.node_type, r.relation_name, r.count_a, r.count_b, r.place) for r in rows}
    assert got == {("Hash Join", None, 1, 1, "common"), ("Seq Scan", "t", 2, 1, "common"), ("Index Scan", "t", 0, 1, "only b")}


@pytest.mark.parametrize(
    "kind, want",
    [("Seq Scan", "seq-scan"), ("Bitmap Index Scan", "index-scan"), ("Hash Join", "hash"), ("Incremental Sort", "sort"), ("HashAggregate", "hash"), ("Aggregate", "aggregate"), ("Merge Join", "join"), ("Nested Loop", "other")],
)
def test_node_class(spark, kind, want):
    assert spark.createDataFrame([(kind,)], "t string").select(tree.node_class(F.col("t")).alias("c")).collect()[0].c == want


def chain(levels: int) -> str:
    return '{"Plan":' + '{"Node Type":"Nest","Plans":[' * (levels - 1) + '{"Node Type":"Leaf"}' + "]}" * (levels - 1) + "}"


def test_deep_plans_are_read_and_deeper_ones_have_their_own_state(spark):
    rows = tree.with_nodes(log(spark, chain(400), chain(900), chain(3)[:-4]), fields=("node_type",)).orderBy("exec_id").collect()
    assert [r.plan_state for r in rows] == ["ok", "too_deep", "malformed"]
    assert len(rows[0].nodes) == 400 and rows[0].nodes[-1].level == 399 and rows[0].nodes[-1].node_type == "Leaf"


def test_root_alone_equals_the_first_node(spark):
    fields = ("node_type", "total_cost", "shared_hit_blocks")
    whole = tree.with_nodes(log(spark, PLAN, None, "[]"), fields=fields).orderBy("exec_id").collect()
    alone = tree.with_root(log(spark, PLAN, None, "[]"), fields=fields).orderBy("exec_id").collect()
    assert [(r.plan_state, r.planning_time, (r.nodes or [None])[0]) for r in whole] == [
        (r.plan_state, r.planning_time, (r.nodes or [None])[0]) for r in alone
    ]
    assert len(alone[0].nodes) == 1


# --- node store


def test_stored_nodes_equal_parsed_ones(spark, tmp_path):
    texts = [json.dumps({"Plan": PLAN}), None, "", "  ", "[]", '[{"Plan": {', json.dumps([{"Plan": PLAN, "Execution Time": 2.5}]), chain(500)]
    executions = log(spark, *(texts + texts))
    plans = store.PlanStore(spark, str(tmp_path / "plans"))
    assert plans.add(executions) == 5
    columns = ["exec_id", "plan_state", "planning_time", "execution_time", "nodes"]
    for fields in (("node_type", "actual_rows"), tree.ALL_FIELDS):
        got = plans.with_nodes(store.keyed(executions), fields).select(columns).orderBy("exec_id").collect()
        want = tree.with_nodes(executions, fields=fields).select(columns).orderBy("exec_id").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_a_log_without_plan_texts_tells_who_has_a_plan(spark, tmp_path):
    texts = [json.dumps({"Plan": PLAN}), None, "", "[]", "null", '[{"Plan": {']
    rows = log(spark, *texts).selectExpr(
        "*", "'completed' AS status", "'both' AS execution_type", "'' AS error_message", "NULL AS result_rows_count",
        "1.0 AS planning_time_ms", "1.0 AS execution_time_ms",
    )
    plans = store.PlanStore(spark, str(tmp_path / "plans"))
    plans.add(rows)
    stored = plans.with_nodes(store.keyed(rows), ("node_type",))
    flags = [[r.has_plan_data for r in history.execution_flags(x).orderBy("exec_id").collect()] for x in (rows, stored)]
    assert flags[0] == flags[1] == [True, False, False, False, False, True]
    assert history.analyzable_executions(store.keyed(rows)).count() == 4


def test_a_plan_is_parsed_once_and_new_ones_are_added(spark, tmp_path):
    node = {"Node Type": "Limit", "Actual Rows": 3}
    first, second = {**node, "Plan Rows": 1}, {**node, "Plan Rows": 2}
    plans = store.PlanStore(spark, str(tmp_path / "plans"))
    old = log(spark, first, first, None)
    assert plans.add(old) == 1 and plans.add(old) == 0
    both = log(spark, first, second, second)
    assert [r.plan_state for r in plans.with_nodes(store.keyed(both)).orderBy("exec_id").collect()] == ["ok", "unread", "unread"]
    assert plans.add(both) == 1 and plans.plans().count() == 2
    rows = plans.with_nodes(store.keyed(both), ("node_type",))
    assert [r.plan_state for r in rows.collect()] == ["ok"] * 3
    # Queries read the store and parse nothing, and only the columns they ask for.
    for made in (metrics.plan_metrics(plans.with_nodes(store.keyed(old), metrics.METRIC_FIELDS)), rows):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "parse_json" not in plan
    assert "sort_method" not in plan and "node_type" in plan
