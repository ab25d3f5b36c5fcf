"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if isinstance(value, str):
        return value
    if hasattr(value, "isoformat"):
        text = value.isoformat(sep=" ") if hasattr(value, "hour") else str(value)
        return None if text == "NaT" else text
    if hasattr(value, "__len__"):
        return str([plain(v) for v in value])
    number = float(value)
    if math.isnan(number):
        return None
    return repr(number)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
}


def differences(spark_df, relation, show: int = 3) -> list[str]:
    """Human-readable differences; empty when both results agree."""
    found = []
    spark_types = dict(spark_df.dtypes)
    duck_types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if set(spark_types) != set(duck_types):
        return [f"columns differ: {sorted(set(spark_types) ^ set(duck_types))}"]
    for name, kind in spark_types.items():
        if kind in SAME_TYPE and SAME_TYPE[kind] != duck_types[name]:
            found.append(f"type of {name}: {kind} vs {duck_types[name]}")
    left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = rows_of(relation.columns, relation.fetchall())
    if len(left) != len(right):
        found.append(f"row count {len(left)} vs {len(right)}")
    from collections import Counter
    a, b = Counter(left), Counter(right)
    only_left, only_right = list((a - b).elements()), list((b - a).elements())
    if only_left or only_right:
        found.append(f"columns {sorted(spark_df.columns)}")
        found += [f"spark only: {r}" for r in sorted(only_left, key=repr)[:show]]
        found += [f"duckdb only: {r}" for r in sorted(only_right, key=repr)[:show]]
    return found
