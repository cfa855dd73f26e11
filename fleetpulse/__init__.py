"""Workload-health analytics over database telemetry, written for Spark.

Every operator takes and returns DataFrames; every scalar takes and returns
Columns.  Nothing here starts an action unless its name says so (``append_*``,
``export_*``, ``*_cleanup``, ``refresh_all`` and the streaming starters).
"""
