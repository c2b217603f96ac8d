"""All registered queries."""

from __future__ import annotations

import importlib

from meander.plans import registry

MODULES = [
    "catalog_series", "catalog_divergence", "catalog_store", "catalog_remediation", "catalog_vectors", "catalog_topology",
    "catalog_records", "catalog_streaming",
]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"meander.plans.{module}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.SQL)
