"""All registered queries of the library outside of the text subpackage."""

from __future__ import annotations

from roadweave.plans import aggregate_queries, bundle_queries, more_queries, reasoning_queries, serving_queries, track_queries

MODULES = (track_queries, aggregate_queries, reasoning_queries, more_queries, serving_queries, bundle_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
