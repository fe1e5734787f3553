"""All queries of the library by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from costfield.plans.oracles import ORACLE_SQL
from costfield.plans.queries import QUERIES

FLAGSHIP = "cost_surface_full"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
