"""Ready-made queries."""

from __future__ import annotations

import importlib

MODULES = ["core", "scoring", "serving", "projecting", "deciding", "basics", "modelling", "streams"]


def all_queries() -> dict:
    from cashlens.plans.registry import QUERIES
    for m in MODULES:
        importlib.import_module(f"cashlens.plans.{m}")
    return dict(QUERIES)
