"""All registered queries."""

from __future__ import annotations

from . import catalog_clusters, catalog_dashboards, catalog_extract, catalog_graph, catalog_health, catalog_ingest, catalog_pairs, catalog_problems, catalog_recommend, catalog_scoring, catalog_streaming, catalog_tracking  # noqa: F401
from .oracle import ORACLES, QUERIES, runner, with_tables


def queries():
    return {name: runner(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return {name: with_tables(sql, uses) for name, (sql, uses) in ORACLES.items()}
