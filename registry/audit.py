"""Audit of a statement log and the guarded ad-hoc query."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import audit
from registry.base import register
from registry.fixtures import table

# A log with allowed and refused statements, one per event.
LOG = """log AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN concat('  SELECT * FROM ', event_type, ' ')
  WHEN 1 THEN concat('DELETE FROM ', event_type) WHEN 2 THEN concat('select 1; select ', user_id)
  WHEN 3 THEN concat('SELECT * FROM t WHERE note = ''update', ' me''') WHEN 4 THEN '   '
  WHEN 5 THEN concat('Select  updated_at   FROM ', event_type) WHEN 6 THEN concat('SELECT * FROM ', event_type, ' limit  ', user_id % 10)
  WHEN 7 THEN concat('with x as (select 1) select ', user_id % 10) ELSE NULL END AS sql_text FROM events)"""


def log(spark, sf):
    text = LOG[LOG.index("(") + 1 : -1].replace("FROM events", "FROM {events}")
    return spark.sql(text, events=table(spark, sf, "events"))


@register(
    "read_only_audit",
    """SELECT reason, read_only, COUNT(*) AS statements FROM (SELECT CASE event_id % 9 WHEN 1 THEN 'Only SELECT statements are allowed'
      WHEN 2 THEN 'Semicolons (;) are not allowed. Please use a single SELECT statement only.'
      WHEN 3 THEN 'UPDATE statements are not allowed. Only SELECT queries are permitted.' WHEN 4 THEN 'Please enter a SQL query'
      WHEN 7 THEN 'Only SELECT statements are allowed' WHEN 8 THEN 'Please enter a SQL query' ELSE 'allowed' END AS reason,
      event_id % 9 IN (0, 5, 6) AS read_only FROM events) e GROUP BY 1, 2""",
)
def read_only_audit(spark, sf):
    return audit.read_only_audit(log(spark, sf))


@register(
    "normalize_sql",
    """SELECT statement, COUNT(*) AS runs, regexp_matches(statement, 'limit\\s+[0-9]+', 'i') AS has_limit,
      CASE WHEN regexp_matches(statement, 'limit\\s+[0-9]+', 'i') THEN statement ELSE statement || ' LIMIT 1000' END AS capped
    FROM (SELECT regexp_replace(trim(sql_text), '\\s+', ' ', 'g') AS statement FROM log) s GROUP BY statement""",
    extra=(LOG,),
)
def normalize_sql(spark, sf):
    return audit.normalise_log(log(spark, sf))


@register(
    "run_select",
    """SELECT o_orderpriority, COUNT(*) AS orders, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 1000""",
)
def run_select(spark, sf):
    sql = """SELECT o_orderpriority, COUNT(*) AS orders, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents
        FROM {orders} GROUP BY o_orderpriority ORDER BY o_orderpriority"""
    return audit.run_select(spark, sql, orders=table(spark, sf, "orders"))
