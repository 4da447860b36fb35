"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = (
    "cohorts",
    "features",
    "splits",
    "preprocessing",
    "evaluation",
    "bootstraps",
    "reports",
    "io",
    "models",
)


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"strataflow.plans.{m}")


def all_queries() -> dict:
    from strataflow.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    from strataflow.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
