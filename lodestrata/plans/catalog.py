"""All registered queries of the core, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from lodestrata.plans import graph_queries, measure_queries, motion_queries, problems, series_queries, stats_queries, text_queries

MODULES = (problems, graph_queries, text_queries, series_queries, stats_queries, measure_queries, motion_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
