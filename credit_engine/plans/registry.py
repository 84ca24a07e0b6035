"""All queries of the lending engine and the SQL that checks them."""

from __future__ import annotations

from . import keeping, lending, modelled, parity, timing

_PLANS = (parity, lending, timing, modelled, keeping)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
