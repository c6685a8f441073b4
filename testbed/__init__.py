"""Inputs, queries and checking statements over the given tables."""

from __future__ import annotations


def registered():
    """All queries by name."""
    from testbed import governance, ingest, models, relational, serving_queries, stream_queries, text_queries
    from testbed.catalogue import ENTRIES

    if not ENTRIES:
        for module in (models, ingest, relational, serving_queries, governance, text_queries, stream_queries):
            module.register()
    return ENTRIES
