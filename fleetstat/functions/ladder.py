"""Ordered threshold ladders: the first predicate that holds names the row.

A ladder is data (predicate text, label). It becomes one Spark CASE expression,
and the same table can be printed as SQL for the side-by-side checks, so that
thresholds and labels are stated exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Ladder:
    def __init__(self, *rules: tuple[str, str], default: str | None):
        self.rules: Sequence[tuple[str, str]] = rules
        self.default = default

    def column(self) -> Column:
        chain = F
        for predicate, label in self.rules:
            chain = chain.when(F.expr(predicate), F.lit(label))
        if not self.rules:
            return F.lit(self.default)
        return chain.otherwise(F.lit(self.default))

    def rank(self) -> Column:
        """Position of the matching rung, for severity ordering."""
        chain = F
        for position, (predicate, _) in enumerate(self.rules, start=1):
            chain = chain.when(F.expr(predicate), F.lit(position))
        return chain.otherwise(F.lit(len(self.rules) + 1))

    def sql(self) -> str:
        rungs = " ".join(f"WHEN {p} THEN {_quote(label)}" for p, label in self.rules)
        tail = "NULL" if self.default is None else _quote(self.default)
        return f"(CASE {rungs} ELSE {tail} END)" if rungs else tail

    def rank_sql(self) -> str:
        rungs = " ".join(f"WHEN {p} THEN {i}" for i, (p, _) in enumerate(self.rules, start=1))
        return f"(CASE {rungs} ELSE {len(self.rules) + 1} END)"

    @classmethod
    def lookup(cls, column: str, mapping: dict[str, str], default: str | None) -> "Ladder":
        """Exact-value lookup written as a ladder, for enum columns."""
        return cls(*[(f"{column} = {_quote(k)}", v) for k, v in mapping.items()], default=default)
