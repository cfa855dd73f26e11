"""Mixing sources to target weights, with DataFrame functions only.

Documents form a tree: domain, language, source.  The token budget flows down
from the root: the children of a node share its budget by weight, a child that
has too few tokens keeps all it has, and what it leaves goes to its siblings by
weight.  A node's capacity is the sum of its children's, so a shortage reaches
the ancestors only when the siblings are used up.  Each leaf then takes whole
epochs of its documents and of the next epoch, in a seeded order of its own,
the longest prefix that fits.

All sums are integers: the budget is met to the token, whatever the order of
summation.  A leaf may hold a third of all documents: its prefix sums go over
4,096 slices of the seeded order, and only the slice in which the budget ends is
summed row by row.

Defined cases: null language or source is the name ``unknown``; a null or blank
text has no tokens and fills no budget; a leaf without tokens or weight gets
none; an empty table gives no rows; repeated rows count and are chosen row by
row, in an order that ties leave free only between equal rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, with_row_key, written

LEVELS = ("domain", "language", "source_name")
DOMAIN_WEIGHTS = {"domain0": 2, "domain1": 1, "domain2": 1}
LANGUAGE_WEIGHTS = {"en": 3, "de": 2, "fr": 2, "es": 2}
BUDGET_PERCENT = 70
MAX_EPOCHS = 4
SEED = 17

_SLICE_DIGITS = 3  # hex digits of the order key


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The tables have no domain, so the number at the end of a source's name decides it."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int")
    return F.concat(F.lit("domain"), F.coalesce(number % 3, F.lit(0)))


def weight_of(name: Column, weights: Mapping[str, int], otherwise: int = 1) -> Column:
    known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else None
    return F.lit(otherwise) if known is None else F.coalesce(known[name], F.lit(otherwise))


def _exact(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(19,0)")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share ``budget`` of each parent among its children by ``weight`` up to ``capacity``; adds ``granted``.

    Children fill up in the order of capacity per weight.  A child is full if
    its share of what the fuller ones leave is no less than its capacity.  The
    others split the rest by cumulative rounding, which never exceeds a capacity
    and leaves no token over.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    weighed = children.withColumn("ratio", F.col("capacity").cast("double") / F.nullif(F.col("weight"), F.lit(0)))
    weighed = weighed.where("ratio IS NOT NULL")
    sums = weighed.withColumns(
        {
            "before": F.sum("capacity").over(upto) - F.col("capacity"),
            "onward": F.sum("weight").over(onward),
        }
    )
    left = F.col("budget") - F.col("before")
    full = _exact("capacity") * _exact("onward") <= _exact(left) * _exact("weight")
    split = sums.withColumn("full", full).withColumns(
        {
            "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)),
            "open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole),
            "cum": F.sum(F.when(~F.col("full"), F.col("weight"))).over(upto),
        }
    )
    granted = F.expr(
        """CASE WHEN full THEN capacity
           ELSE (CAST(rest AS DECIMAL(19,0)) * CAST(cum AS DECIMAL(19,0)) DIV open)
              - (CAST(rest AS DECIMAL(19,0)) * CAST(cum - weight AS DECIMAL(19,0)) DIV open) END"""
    )
    return split.withColumn("granted", granted).select(*children.columns, "granted")


def leaf_budgets(leaves: DataFrame, budget_percent: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, a weight for each level) with ``budget``, given down the tree."""
    capacity = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    granted = None
    for depth, name in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = capacity.groupBy(*path).agg(
            F.sum("tokens").alias("tokens"),
            F.sum("capacity").alias("capacity"),
            F.max(f"{name}_weight").cast("long").alias("weight"),
        )
        if granted is None:
            parent = ["root"]
            root = Window.partitionBy("root")
            wanted = _exact(F.sum("tokens").over(root)) * budget_percent
            # The root cannot give more than there is.
            nodes = nodes.withColumn("root", F.lit(0)).withColumn("wanted", wanted)
            nodes = nodes.withColumn("budget", F.least(F.expr("wanted DIV 100"), F.sum("capacity").over(root)))
        else:
            nodes = nodes.join(granted.withColumnRenamed("granted", "budget"), path[:-1])
            parent = path[:-1]
        granted = share(nodes, parent, name).select(*path, "granted")
    return leaves.join(granted.withColumnRenamed("granted", "budget"), list(LEVELS), "left").withColumn(
        "budget", F.coalesce("budget", F.lit(0).cast("long"))
    )


def mixed(
    docs: DataFrame,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    language_weights: Mapping[str, int] = LANGUAGE_WEIGHTS,
    source_weights: Mapping[str, int] | None = None,
    row: str | None = None,
) -> DataFrame:
    """For every row of ``docs``: doc_id, its leaf, tokens, the leaf's budget, and how many copies the mix takes.

    ``row`` names a column that tells rows apart; it is carried along, and rows
    without an id take their place in the order by their text.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    carried = ["doc_id"] if row is None else ["doc_id", row]
    source = F.coalesce("source", F.lit("unknown"))
    rows = written(
        docs.select(
            *carried,
            key.alias("key"),
            domain_of(source).alias("domain"),
            F.coalesce("lang", F.lit("unknown")).alias("language"),
            source.alias("source_name"),
            word_count(F.col("text")).alias("tokens"),
        ),
        "mixing-rows",
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumns(
        {
            "domain_weight": weight_of(F.col("domain"), domain_weights),
            "language_weight": weight_of(F.col("language"), language_weights),
            "source_name_weight": weight_of(F.col("source_name"), source_weights or {}),
        }
    )
    budgets = written(
        leaf_budgets(leaves, budget_percent, max_epochs).select(
            *LEVELS,
            F.col("budget").alias("leaf_budget"),
            F.expr("CASE WHEN tokens > 0 THEN budget DIV tokens ELSE 0 END").alias("epochs"),
            F.expr("CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END").alias("rest"),
        ),
        "mixing-budgets",
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("key")))
    keyed = rows.join(budgets, list(LEVELS)).withColumn("order", order)
    keyed = keyed.withColumn("slice", F.substring("order", 1, _SLICE_DIGITS))

    slices = keyed.groupBy(*LEVELS, "slice", "rest").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("upto", F.sum("sum").over(upto))
    # Only slices that are taken whole, or in which the budget ends, matter further.
    taken = slices.where(F.expr("rest > 0 AND upto - sum <= rest")).select(
        *LEVELS, "slice", (F.col("upto") - F.col("sum")).alias("before"), (F.col("upto") > F.col("rest")).alias("last")
    )
    placed = keyed.join(taken, [*LEVELS, "slice"], "left")
    whole = placed.where("last IS NULL OR NOT last").withColumn("chosen", F.expr("last IS NOT NULL"))
    in_slice = Window.partitionBy(*LEVELS, "slice").orderBy("order", "doc_id", "tokens", *carried[1:])
    running = F.sum("tokens").over(in_slice.rowsBetween(Window.unboundedPreceding, 0))
    ends = placed.where("last").withColumn("chosen", F.col("before") + running <= F.col("rest"))
    copies = (F.col("epochs") + F.col("chosen").cast("long")).cast("long").alias("copies")
    return whole.unionByName(ends).select(*carried, *LEVELS, "tokens", "leaf_budget", copies)


def mix_documents(docs: DataFrame, budget_percent: int, **options) -> DataFrame:
    """The rows of ``docs`` that a mix of at most one epoch takes, each row for itself."""
    rows, row = with_row_key(docs, "mixing-documents")
    taken = mixed(rows, budget_percent, max_epochs=1, row=row, **options).where("copies > 0").select(row)
    return rows.join(taken, row, "left_semi").select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def _case(column: str, weights: Mapping[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _shared_sql(children: str, parent: str, name: str) -> str:
    """``share`` as SQL over the relation ``children``."""
    return f"""(
      SELECT *, CASE WHEN isfull THEN capacity
             ELSE (rest * cum) // opened - (rest * (cum - weight)) // opened END AS granted
      FROM (SELECT *, budget - coalesce(sum(CASE WHEN isfull THEN capacity END) OVER (PARTITION BY {parent}), 0) AS rest,
              sum(CASE WHEN NOT isfull THEN weight END) OVER (PARTITION BY {parent}) AS opened,
              sum(CASE WHEN NOT isfull THEN weight END) OVER
                (PARTITION BY {parent} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) AS cum
            FROM (SELECT *, capacity * onward <= (budget - before) * weight AS isfull
                  FROM (SELECT *, sum(capacity) OVER
                            (PARTITION BY {parent} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) - capacity AS before,
                          sum(weight) OVER (PARTITION BY {parent} ORDER BY ratio, {name}
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
                        FROM (SELECT *, capacity::DOUBLE / weight AS ratio FROM ({children}))))))"""


def _oracle() -> str:
    rows = r"""SELECT doc_id, 'domain' || coalesce(try_cast(regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1)
        AS INTEGER) % 3, 0) AS domain, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS source_name,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents"""
    domains = f"""SELECT domain, 0 AS root, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity,
        ({_case("domain", DOMAIN_WEIGHTS)})::HUGEINT AS weight,
        least((SELECT sum(tokens)::HUGEINT * {BUDGET_PERCENT} // 100 FROM d),
              (SELECT sum(tokens)::HUGEINT * {MAX_EPOCHS} FROM d)) AS budget FROM d GROUP BY domain"""
    languages = f"""SELECT d.domain, d.language, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity,
        ({_case("d.language", LANGUAGE_WEIGHTS)})::HUGEINT AS weight, any_value(g.granted) AS budget
        FROM d JOIN g1 g ON d.domain = g.domain GROUP BY d.domain, d.language"""
    sources = f"""SELECT d.domain, d.language, d.source_name, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity,
        1::HUGEINT AS weight, any_value(g.granted) AS budget, sum(tokens)::HUGEINT AS tokens
        FROM d JOIN g2 g ON d.domain = g.domain AND d.language = g.language
        GROUP BY d.domain, d.language, d.source_name"""
    return f"""
    WITH d AS ({rows}),
    g1 AS (SELECT * FROM {_shared_sql(domains, "root", "domain")}),
    g2 AS (SELECT * FROM {_shared_sql(languages, "domain", "language")}),
    g3 AS (SELECT domain, language, source_name, granted,
             CASE WHEN tokens > 0 THEN granted // tokens ELSE 0 END AS epochs,
             CASE WHEN tokens > 0 THEN granted % tokens ELSE 0 END AS rest
           FROM {_shared_sql(sources, "domain, language", "source_name")}),
    k AS (SELECT d.*, granted, epochs, rest, md5('{SEED}:' || epochs || ':' || doc_id) AS ord
          FROM d JOIN g3 USING (domain, language, source_name)),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source_name ORDER BY ord, doc_id, tokens
            ROWS UNBOUNDED PRECEDING) AS upto FROM k)
    SELECT doc_id, domain, language, source_name, tokens, granted::BIGINT AS leaf_budget,
           (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
    """


ORACLE = _oracle()
