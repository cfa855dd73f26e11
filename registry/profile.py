"""Profiles of result sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import profile
from registry.base import register, rnd
from registry.fixtures import table, view


def messy(spark, sf):
    """A result of mixed cells: prices as text, names, sizes, blanks and dates."""
    return table(spark, sf, "part").select(
        F.col("p_name").alias("label"),
        F.expr("concat('$', format_number(p_retailprice, 2))").alias("price"),
        F.expr("CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN '  ' ELSE CAST(p_size AS STRING) END").alias("size"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN repeat(p_brand, 9) ELSE CAST(-p_size AS STRING) END").alias("note"),
        "p_partkey",
    )


PRICES = """messy AS (SELECT p_name AS label, p_retailprice AS price,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN '  ' ELSE CAST(p_size AS VARCHAR) END AS size,
  CASE WHEN p_partkey % 3 = 0 THEN repeat(p_brand, 9) ELSE CAST(-p_size AS VARCHAR) END AS note, p_partkey FROM part)"""


def _stat(name: str, value: str) -> str:
    exact = f"CAST({value} AS DECIMAL(30,6))"
    return f"""SELECT '{name}' AS "column", COUNT(*) AS total_rows, COUNT({value}) AS numeric_cells, {rnd(f'SUM({exact})', 2)} AS sum,
      {rnd(f'CAST(SUM({exact}) AS DOUBLE) / COUNT({value})', 2)} AS avg, CAST(MAX({value}) AS DOUBLE) AS max, CAST(MIN({value}) AS DOUBLE) AS min,
      CAST(5 AS BIGINT) AS columns FROM messy"""


@register(
    "result_column_stats",
    " UNION ALL ".join(
        [
            _stat("price", "price"),
            _stat("size", "TRY_CAST(NULLIF(trim(size), '') AS INT)"),
            _stat("p_partkey", "p_partkey"),
        ]
    ),
    extra=(PRICES,),
)
def result_column_stats(spark, sf):
    return profile.result_column_stats(messy(spark, sf))


@register(
    "numeric_result_stats",
    f"""SELECT 'o_totalprice' AS "column", COUNT(*) AS total_rows, COUNT(o_totalprice) AS numeric_cells,
      {rnd('SUM(CAST(o_totalprice AS DECIMAL(30,6)))', 2)} AS sum,
      {rnd('CAST(SUM(CAST(o_totalprice AS DECIMAL(30,6))) AS DOUBLE) / COUNT(*)', 2)} AS avg, MAX(o_totalprice) AS max, MIN(o_totalprice) AS min,
      CAST(2 AS BIGINT) AS columns FROM orders""",
)
def numeric_result_stats(spark, sf):
    return profile.result_column_stats(table(spark, sf, "orders").select("o_orderstatus", "o_totalprice"))


def _type(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    number = f"regexp_full_match({text}, '-?[0-9]+([.][0-9]+)?')"
    day = f"regexp_matches({text}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"
    return f"""SELECT '{name}' AS "column", CASE WHEN COUNT(*) FILTER (WHERE {number}) > 0.7 * COUNT(*) THEN 'number'
      WHEN COUNT(*) FILTER (WHERE {day} AND NOT {number}) > 0.7 * COUNT(*) THEN 'date' ELSE 'text' END AS inferred_type
    FROM mixed"""


# Columns whose first rows look like another type than the whole.
MIXED = """SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority,
  CASE WHEN o_orderkey <= 40 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS late_number,
  CASE WHEN o_orderkey <= 40 THEN CAST(o_custkey AS STRING) ELSE o_orderpriority END AS late_text FROM {orders}"""


@register(
    "infer_column_type",
    " UNION ALL ".join(
        _type(c) for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "late_number", "late_text")
    ),
    extra=(f"mixed AS ({MIXED.format(orders='orders')})",),
)
def infer_column_type(spark, sf):
    return profile.infer_column_type(spark.sql(MIXED, orders=table(spark, sf, "orders")))


def _classes(name: str, empty: str, number: str, long: str) -> str:
    return f"""SELECT '{name}' AS "column", CASE WHEN {name} IS NULL THEN 'null-value' WHEN {empty} THEN 'empty-value'
      WHEN {number} THEN 'numeric-value' WHEN {long} THEN 'long-text' ELSE 'text-value' END AS cell_class FROM messy"""


@register(
    "cell_class_profile",
    """SELECT "column", cell_class, COUNT(*) AS cells FROM ("""
    + " UNION ALL ".join(
        [
            _classes("label", "false", "false", "length(label) > 50"),
            _classes("price", "false", "false", "false"),
            _classes("size", "trim(size) = ''", "regexp_full_match(size, '[0-9]+')", "false"),
            _classes("note", "false", "regexp_full_match(note, '[0-9]+')", "length(note) > 50"),
            _classes("p_partkey", "false", "true", "false"),
        ]
    )
    + ") c GROUP BY 1, 2",
    extra=(PRICES,),
)
def cell_class_profile(spark, sf):
    return profile.cell_class_profile(messy(spark, sf))


@register(
    "chart_series",
    """SELECT query AS label, CASE WHEN length(query) > 30 THEN concat(substring(query, 1, 27), '...') ELSE query END AS short_label,
      CAST(calls AS DOUBLE) AS value FROM v_statements""",
)
def chart_series(spark, sf):
    return profile.chart_series(view(spark, sf, "v_statements").select("query", "calls"))


@register(
    "chart_eligible",
    """SELECT 'nation' AS result, COUNT(*) AS "rows", CAST(3 AS BIGINT) AS columns, COUNT(*) > 0 AS has_number, COUNT(*) BETWEEN 1 AND 50 AS eligible FROM nation
    UNION ALL SELECT 'customer', COUNT(*), CAST(2 AS BIGINT), bool_or(regexp_full_match(c_name, '[0-9]+') OR regexp_full_match(c_mktsegment, '[0-9]+')), false FROM customer
    UNION ALL SELECT 'supplier', COUNT(*), CAST(4 AS BIGINT), true, COUNT(*) BETWEEN 1 AND 50 FROM supplier""",
)
def chart_eligible(spark, sf):
    results = {
        "nation": table(spark, sf, "nation"),
        "customer": table(spark, sf, "customer").select("c_name", "c_mktsegment"),
        "supplier": table(spark, sf, "supplier"),
    }
    out = None
    for name, df in results.items():
        row = profile.chart_eligible(df).withColumn("result", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "result_to_document",
    """SELECT concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_nationkey":', c_nationkey, '}') AS row, 3 AS fields FROM customer""",
)
def result_to_document(spark, sf):
    out = profile.result_to_document(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))
    return out.select("row", F.json_array_length(F.get_json_object("column_types", "$.fields")).alias("fields"))
