"""Actions under a time limit, by Spark's job tags."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import SparkSession

T = TypeVar("T")


class TimeLimitExceeded(Exception):
    """An action ran longer than it may; its jobs were cancelled."""


def within(spark: SparkSession, seconds: float | None, action: Callable[[], T], what: str = "The query") -> T:
    """``action()``; if it takes longer than ``seconds`` its Spark jobs are cancelled and ``TimeLimitExceeded`` is raised.

    The tag belongs to this thread, so other threads' jobs go on.  Jobs that the
    action starts after its time are cancelled as well.  No limit without ``seconds``.
    """
    if seconds is None:
        return action()
    context, tag = spark.sparkContext, f"limit-{uuid4().hex}"
    over, ended = threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not ended.wait(wait):
            over.set()
            context.cancelJobsWithTag(tag)
            wait = 0.2

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        result = action()
    except Exception as failure:
        if over.is_set():
            raise TimeLimitExceeded(f"{what} exceeded the limit of {seconds:g} s") from failure
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
    return result
