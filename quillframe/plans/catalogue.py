"""Every registered query: importing the modules registers them."""

from __future__ import annotations

from quillframe.plans import elementary, extras, fitted, learning, network, numeric, relational, surroundings
from quillframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "elementary", "extras", "fitted", "learning", "network", "numeric", "relational", "surroundings"]
