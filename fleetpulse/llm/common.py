"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fleetpulse.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key: Any, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python process.

    Functions are sent by value, so a module variable would be a new one in
    every task; the interpreter itself outlives the task.
    """
    store = sys.__dict__.setdefault("_fleetpulse_llm", {})
    if key not in store:
        store[key] = make()
    return store[key]


def text_column(schema: str, row: Callable[[str], tuple], text: Column) -> Column:
    """A struct column of ``schema`` computed from each text; a null text counts as empty."""
    struct = StructType.fromDDL(schema)
    fields = list(to_arrow_schema(struct))

    def rows(texts: pa.Array) -> pa.Array:
        found = [row(x or "") for x in texts.to_pylist()]
        columns = zip(*found) if found else ([] for _ in fields)
        return pa.StructArray.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, fields)], fields=fields
        )

    return F.arrow_udf(rows, struct)(text)


def written(df: DataFrame, purpose: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """``df`` as a table in the shared folder, read back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number that only one row has, and the name of its column.

    Rows without an id, of one id, or equal in all columns can so be told apart.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), purpose), name
