"""Session defaults and the shared folder for tables a job writes between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on for skewed keys and late plan decisions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SCALE_CONF.items():
        spark.conf.set(key, value)
    return spark


_local_roots: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    The cluster names that folder and every executor can reach it.  Only a
    local master may run without the setting; it then gets a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_roots.setdefault(context.applicationId, tempfile.mkdtemp(prefix="fleetpulse-"))
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
