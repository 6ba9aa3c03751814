"""Registered queries: the operators bound to the test tables, each with an oracle in SQL."""

from kvartal.catalog import documents, jobs, lookups, merges, reports, routes, strings  # noqa: F401
from kvartal.catalog.registry import ORACLES, QUERIES  # noqa: F401
