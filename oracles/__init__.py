"""The same reports as SQL for a second engine, written against the same relations."""

from __future__ import annotations

import importlib
import re

from fleetstat.sources import fixtures

FAMILIES = (
    "statements", "waits", "resources", "colstats", "maintenance", "partitions", "indexes", "connections",
    "servers", "security", "config", "admin", "packs", "dashboards", "metrics", "checks", "history",
)


def with_relations(text: str) -> str:
    """Prefix a query with the derived relations it reads."""
    texts = fixtures.definitions("duckdb")
    used = [n for n in texts if re.search(rf"\b{n}\b", text)]
    ctes = [f"{n} AS ({texts[n]})" for n in used]
    body = text.strip()
    if not ctes:
        return body
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    inner = re.sub(r"^WITH( RECURSIVE)?\s", "", body, flags=re.I)
    joiner = ", " if inner != body else " "
    return f"WITH {recursive}{', '.join(ctes)}{joiner}{inner}"


def all_queries() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in FAMILIES:
        module = importlib.import_module(f"oracles.{family}")
        for key, text in module.SQL.items():
            if key in out:
                raise ValueError(f"{key} defined twice")
            out[key] = with_relations(text)
    return out
