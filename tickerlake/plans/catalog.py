"""All registered queries."""

from __future__ import annotations

from tickerlake.plans import on_files, on_identity, on_ops, on_prices, on_value, registry, sqlparts  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    """Checking SQL with the binding rules it needs in front."""
    return {name: sqlparts.query(sql) for name, sql in registry.ORACLE.items()}
