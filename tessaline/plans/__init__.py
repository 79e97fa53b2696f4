"""Queries over the test tables, with SQL for the same rows."""

from __future__ import annotations


def load_queries() -> tuple[dict, dict]:
    """All queries of this package and their SQL, by name."""
    from tessaline.plans import activity, approximate, catalog, machines, registry, retrieval, rules, serving, small

    assert activity and approximate and catalog and machines and retrieval and rules and serving and small
    return registry.QUERIES, registry.ORACLE
