"""Independent SQL for DuckDB: every checked query as one WITH statement over the test tables."""

from __future__ import annotations

import re


def compose(ctes: dict[str, str], final: str) -> str:
    """Prefix ``final`` with the CTEs it needs, in definition order."""
    need, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(ctes[name])
    body = ",\n".join(f"{n} AS (\n{q.strip()}\n)" for n, q in ctes.items() if n in need)
    return f"WITH {body}\n{final.strip()}" if body else final.strip()


def shape(source: str, spec: str) -> str:
    """SELECT with the same output rule as the Spark side: ``name``, ``name:i``, ``name:digits``."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        e = f'"{name}"'
        if kind == "i":
            e = f"CAST({e} AS BIGINT)"
        elif kind:
            e = f"round(CAST({e} AS DOUBLE), {kind})"
        out.append(f'{e} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM {source}"
