"""Every query module, so that the registry is complete."""

from recallgrid.plans import health, knowledge, lifecycle, linking, relational, retrieval, routing, search, streams, writes  # noqa: F401
from recallgrid.plans.registry import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
