"""Incremental forms of the snapshot metrics, change detection and result store."""
