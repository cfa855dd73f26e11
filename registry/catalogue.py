"""All registered queries; importing a module registers its own."""

from registry import audit, compare, health, history, plans, profile, snapshots, store, streams, telemetry  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
