"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from . import catalog_queries, item_queries, stream_queries

MODULES = (catalog_queries, item_queries, stream_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
