"""Execution log and saved-query catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import history
from fleetpulse.plans.metrics import METRIC_FIELDS, plan_metrics
from fleetpulse.plans.tree import with_nodes
from fleetpulse.session import shared_folder
from registry.base import joined, plain, register, rnd, sec, seconds
from registry.fixtures import executions, view, with_parsed_nodes

# Times and cost of an execution as an analysis would find them.
ANALYSED = """analysed AS (SELECT *, CASE WHEN plan_state = 'plan' THEN planning_part END AS planning_time_ms,
  CASE WHEN plan_state = 'plan' THEN execution_part END AS execution_time_ms,
  CASE plan_state WHEN 'plan' THEN planning_part + execution_part WHEN 'absent' THEN execution_part END AS total_time_ms,
  CASE WHEN plan_state = 'plan' THEN cost_part END AS query_cost FROM v_executions)"""
CLASS = """CASE WHEN total_time_ms IS NULL THEN 'performance-unknown' WHEN total_time_ms < 50 THEN 'performance-excellent'
  WHEN total_time_ms < 200 THEN 'performance-good' WHEN total_time_ms < 1000 THEN 'performance-fair' ELSE 'performance-poor' END"""
DURATION = f"CASE WHEN total_time_ms < 1000 THEN concat({plain('total_time_ms', 2)}, 'ms') WHEN total_time_ms >= 1000 THEN concat({plain('total_time_ms / 1000', 2)}, 's') END"
COST = f"CASE WHEN query_cost < 1000 THEN {plain('query_cost', 2)} WHEN query_cost >= 1000 THEN concat({plain('query_cost / 1000', 1)}, 'K') END"
SUMMARY = f"""concat_ws(' • ', {DURATION}, CASE WHEN query_cost IS NOT NULL THEN concat('Cost: ', {COST}) END,
  CASE WHEN result_rows_count IS NOT NULL THEN concat(result_rows_count, ' rows') END)"""
TITLE = "CASE WHEN length(sql_text) > 50 THEN concat(substring(sql_text, 1, 47), '...') ELSE sql_text END"


def analysed(spark, sf):
    return plan_metrics(with_parsed_nodes(spark, sf, METRIC_FIELDS))


@register(
    "query_history",
    f"""SELECT exec_id, {TITLE} AS title, {SUMMARY} AS summary, {CLASS} AS performance_class,
      strftime(created_at, '%m/%d %H:%M') AS created_at, total_time_ms, query_cost, sql_text
    FROM analysed WHERE status = 'completed' AND execution_type <> 'execute'
    ORDER BY analysed.created_at DESC, exec_id DESC LIMIT 10""",
    extra=(ANALYSED,),
)
def query_history(spark, sf):
    """The ten newest are chosen first; only their plans are parsed."""
    newest = history.analyzable_executions(executions(spark, sf)).orderBy(
        F.col("created_at").desc_nulls_first(), F.col("exec_id").desc()
    ).limit(10)
    return history.query_history(plan_metrics(with_nodes(newest, fields=METRIC_FIELDS)))


@register(
    "execution_listing",
    f"""SELECT exec_id, {TITLE} AS title, {SUMMARY} AS summary, {CLASS} AS performance_class,
      CASE WHEN result_rows_count IS NOT NULL THEN concat(result_rows_count, CASE WHEN result_rows_count = 1 THEN ' row' ELSE ' rows' END,
        ' • ', result_columns_count, CASE WHEN result_columns_count = 1 THEN ' column' ELSE ' columns' END) END AS result_summary
    FROM analysed""",
    extra=(ANALYSED,),
)
def execution_listing(spark, sf):
    from fleetpulse.functions.ladders import performance_class

    return analysed(spark, sf).select(
        "exec_id",
        history.display_title().alias("title"),
        history.display_summary().alias("summary"),
        performance_class(F.col("total_time_ms")).alias("performance_class"),
        history.result_summary().alias("result_summary"),
    )


@register(
    "execution_flags",
    """SELECT exec_id, status = 'pending' AS is_pending, status = 'running' AS is_running, status = 'completed' AS is_completed,
      status = 'failed' AS is_failed, status = 'completed' AND error_message IS NULL AS is_success,
      execution_type <> 'analyze' AS includes_execution, execution_type <> 'execute' AS includes_analysis,
      planning_time_ms IS NOT NULL AS has_timing_data, plan_state IN ('plan', 'malformed') AS has_plan_data,
      result_rows_count IS NOT NULL AS has_result_data FROM analysed""",
    extra=(ANALYSED,),
)
def execution_flags(spark, sf):
    flags = history.execution_flags(analysed(spark, sf))
    return flags.select("exec_id", *[c for c in flags.columns if c.startswith(("is_", "includes_", "has_"))])


@register(
    "analyzable_executions",
    """SELECT database_id, COUNT(*) AS analyzable FROM v_executions
    WHERE status = 'completed' AND execution_type IN ('analyze', 'both') GROUP BY database_id""",
)
def analyzable_executions(spark, sf):
    rows = history.analyzable_executions(executions(spark, sf))
    return rows.groupBy("database_id").agg(F.count("*").alias("analyzable"))


@register(
    "execution_query_join",
    """SELECT exec_id, query_id, q.name AS query_name, q.category AS query_category FROM v_executions
    LEFT JOIN v_saved_queries q ON query_id = q.id""",
)
def execution_query_join(spark, sf):
    log = view(spark, sf, "v_executions").select("exec_id", "query_id")
    return history.execution_query_join(log, view(spark, sf, "v_saved_queries"))


ORACLE_OF_STATES = f"""SELECT exec_id, status, error_message, {sec("CASE WHEN status <> 'pending' THEN created_at + INTERVAL 2 SECOND END")} AS started_at,
      {sec("CASE WHEN status IN ('completed', 'failed') THEN created_at + INTERVAL 5 SECOND END")} AS completed_at,
      CASE WHEN status IN ('completed', 'failed') THEN CAST(3000 AS DOUBLE) END AS duration_ms FROM v_executions"""


@register("execution_state", ORACLE_OF_STATES)
def execution_state(spark, sf):
    """Lifecycle events of every execution reduced to its current state."""
    return _states(history.execution_state(_steps(view(spark, sf, "v_executions"))))


def _steps(log):
    reached = F.expr(
        """CASE status WHEN 'pending' THEN array(struct('pending' AS status, 0 AS after))
        WHEN 'running' THEN array(struct('pending' AS status, 0 AS after), struct('running' AS status, 2 AS after))
        ELSE array(struct('pending' AS status, 0 AS after), struct('running' AS status, 2 AS after), struct(status AS status, 5 AS after)) END"""
    )
    steps = log.select("exec_id", "created_at", "error_message", F.explode(reached).alias("step"))
    return steps.select(
        "exec_id",
        "step.status",
        F.expr("created_at + INTERVAL '1' SECOND * step.after").alias("at"),
        F.when(F.col("step.status") == "failed", F.col("error_message")).alias("error_message"),
    )


def _states(out):
    return out.select("exec_id", "status", "error_message", *seconds("started_at", "completed_at"), "duration_ms")


@register("append_execution", ORACLE_OF_STATES)
def append_execution(spark, sf):
    """Append the events to a log in three runs, the ends first, and read the states back from it."""
    steps = _steps(view(spark, sf, "v_executions"))
    path = shared_folder(spark, "execution-log")
    for statuses in (("completed", "failed"), ("pending",), ("running",), ("pending",)):
        # The last run is a repeated one, which changes nothing.
        history.append_execution(steps.filter(F.col("status").isin(*statuses)), path, run=statuses[0])
    return _states(history.execution_state(history.read_executions(spark, path)))


BUILT_IN = """SELECT CAST(n_nationkey AS STRING) AS id, concat('Size of ', n_name) AS name,
  concat('SELECT * FROM ', lower(n_name)) AS sql, 'Built in' AS description, 'database' AS category FROM nation"""


@register(
    "query_catalog",
    f"""{BUILT_IN} UNION ALL SELECT CAST(id AS STRING), name, sql, description, COALESCE(category, 'saved') FROM v_saved_queries""",
)
def query_catalog(spark, sf):
    from registry.fixtures import table

    nation = table(spark, sf, "nation")
    built_in = nation.select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.concat(F.lit("Size of "), "n_name").alias("name"),
        F.concat(F.lit("SELECT * FROM "), F.lower("n_name")).alias("sql"),
        F.lit("Built in").alias("description"),
        F.lit("database").alias("category"),
    )
    return history.query_catalog(built_in, view(spark, sf, "v_saved_queries"))


@register(
    "saved_queries_ordered",
    f"SELECT id, name, {sec('updated_at')} AS updated_at FROM v_saved_queries ORDER BY v_saved_queries.updated_at DESC, id",
)
def saved_queries_ordered(spark, sf):
    rows = history.saved_queries_ordered(view(spark, sf, "v_saved_queries"))
    return rows.select("id", "name", *seconds("updated_at"))


@register(
    "name_dedup",
    f"""SELECT name_key, copies, id, name, {sec('updated_at')} AS updated_at FROM (SELECT lower(name) AS name_key, id, name, updated_at,
      COUNT(*) OVER (PARTITION BY lower(name)) AS copies,
      row_number() OVER (PARTITION BY lower(name) ORDER BY updated_at DESC, id DESC) AS n FROM v_saved_queries) t WHERE n = 1""",
)
def name_dedup(spark, sf):
    out = history.name_dedup(view(spark, sf, "v_saved_queries"))
    return out.select("name_key", "copies", "id", "name", *seconds("updated_at"))


@register(
    "saved_query_validation",
    """SELECT id, concat_ws(' | ', CASE WHEN sql = '' THEN 'sql can''t be blank' END,
      CASE WHEN length(description) > 500 THEN 'description is too long (maximum is 500 characters)' END,
      CASE WHEN category IS NULL THEN 'category can''t be blank' END) AS reasons
    FROM v_saved_queries WHERE sql = '' OR length(description) > 500 OR category IS NULL""",
)
def saved_query_validation(spark, sf):
    return history.saved_query_validation(view(spark, sf, "v_saved_queries")).select("id", joined("reasons"))
