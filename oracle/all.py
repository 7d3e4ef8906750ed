"""All query SQL, composed with the CTEs each one needs."""

import importlib

from oracle import compose

MODULES = ["core", "scoring", "serving", "projecting", "deciding", "basics", "modelling", "streams"]


def all_sql() -> dict[str, str]:
    importlib.import_module("oracle.panel")
    from oracle.base import CTES
    finals = {}
    for m in MODULES:
        finals |= importlib.import_module(f"oracle.{m}").SQL
    return {k: compose(CTES, v) for k, v in finals.items()}
