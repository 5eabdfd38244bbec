"""Registered queries, grouped by family."""

from __future__ import annotations

import importlib

from undula.plans.catalog import ORACLES, QUERIES

MODULES = (
    "cohort_queries",
    "network_queries",
    "distribution_queries",
    "statistics_queries",
    "motif_queries",
    "community_queries",
    "state_queries",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"undula.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
