"""All registered queries and their oracle SQL, gathered from the modules in ``leafmill.plans``."""

from __future__ import annotations

from leafmill.plans import artifacts, exchange, formats, functions, geometry, pages, records, text

QUERIES = {}
ORACLES = {}
for _module in (text, pages, geometry, functions, records, formats, artifacts, exchange):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
