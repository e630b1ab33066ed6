"""Whole jobs built from the operators, and the registered queries."""

from __future__ import annotations


def all_queries():
    """(queries, oracles); importing the modules registers them."""
    from faultline.plans import (q_evaluate, q_joins, q_rows, q_sequences, q_sources, q_streaming,  # noqa: F401
                                 q_templates, q_windows, registry)

    return dict(registry.QUERIES), dict(registry.ORACLES)
