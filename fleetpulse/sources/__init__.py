"""Readers of telemetry, and the stores and exports the operators write."""
