"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from veilgrid.plans import audit, catalog, events, governed, helpers, report

QUERIES = {}
ORACLES = {}
for _mod in (governed, catalog, audit, report, events):
    QUERIES.update(_mod.QUERIES)
    ORACLES.update(_mod.ORACLES)
QUERIES.update(helpers.QUERIES)
ORACLES.update(helpers.oracles(report.CALLS))
