"""Catalogue of reports: id, name, function and presentation order."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.sources.snapshots import Snapshots


@dataclass(frozen=True)
class Report:
    id: str
    name: str
    build: Callable[..., DataFrame]
    order: str | None

    @property
    def key(self) -> str:
        return f"{self.id.lower()}_{self.name}"


REPORTS: dict[str, Report] = {}

FAMILIES = (
    "statements", "waits", "resources", "colstats", "maintenance", "partitions", "indexes", "connections",
    "servers", "security", "config", "admin", "packs", "dashboards", "metrics", "checks", "history",
)


def report(id: str, order: str | None = None):
    """Register a function of snapshots as a report. ``order`` is for presentation only:
    a fleet-wide sort is done when asked for, never on the way."""
    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if id in REPORTS:
            raise ValueError(f"report {id} registered twice")
        REPORTS[id] = Report(id, build.__name__, build, order)
        return build
    return add


def load_all() -> dict[str, Report]:
    for family in FAMILIES:
        importlib.import_module(f"fleetstat.plans.{family}")
    return REPORTS


def run(id: str, snapshots: Snapshots, *, ordered: bool = False, **params) -> DataFrame:
    """Build a report by id ('QP2') or key ('qp2_top_by_total_time')."""
    load_all()
    entry = REPORTS.get(id.upper()) or next(r for r in REPORTS.values() if r.key == id.lower())
    result = entry.build(snapshots, **params)
    if ordered and entry.order:
        return result.orderBy(*[F.expr(part) if " " not in part.strip() else _sort(part) for part in entry.order.split(",")])
    return result


def _sort(part: str):
    """'x desc nulls first' as a sort column; bare directions follow the database defaults
    (ascending puts NULLs last, descending puts them first)."""
    words = part.split()
    name, descending = words[0], "desc" in words
    nulls_first = "first" in words if "nulls" in words else descending
    c = F.col(name)
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
