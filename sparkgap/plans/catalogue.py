"""All queries of the core."""

from __future__ import annotations

from . import boards, found, views  # noqa: F401  (views adds its queries to those of boards)

FLAGSHIP = "per_net_minimum"
QUERIES = {**found.QUERIES, **boards.QUERIES}
ORACLES = {**found.ORACLES, **boards.ORACLES}
