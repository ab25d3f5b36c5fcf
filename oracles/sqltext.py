"""SQL spellings of the shared column arithmetic."""

from __future__ import annotations

from fleetstat.sources.fixtures import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


def pct(part: str, whole: str) -> str:
    return f"((((20000::HUGEINT * ({part})) + nullif({whole}, 0)) // (2::HUGEINT * nullif({whole}, 0)))::DOUBLE / 100.0)"


def quotient(part: str, whole: str, digits: int = 2) -> str:
    f = 10**digits
    return f"((((2 * {f}::HUGEINT * ({part})) + nullif({whole}, 0)) // (2::HUGEINT * nullif({whole}, 0)))::DOUBLE / {float(f)})"


def r2(x: str, digits: int = 2) -> str:
    scale = 9 if digits <= 4 else 15  # wide enough not to round twice
    return f"round(({x})::DECIMAL(38,{scale}), {digits})::DOUBLE"


def pretty(x: str) -> str:
    x = f"({x})::BIGINT"
    return f"""(CASE WHEN {x} IS NULL THEN NULL WHEN abs({x}) < 10240 THEN {x} || ' bytes'
        WHEN abs({x} >> 9) < 20479 THEN ((({x} >> 9) + 1) >> 1) || ' kB'
        WHEN abs({x} >> 19) < 20479 THEN ((({x} >> 19) + 1) >> 1) || ' MB'
        WHEN abs({x} >> 29) < 20479 THEN ((({x} >> 29) + 1) >> 1) || ' GB'
        WHEN abs({x} >> 39) < 20479 THEN ((({x} >> 39) + 1) >> 1) || ' TB'
        ELSE ((({x} >> 49) + 1) >> 1) || ' PB' END)"""


def age_s(ts: str, now: str = NOW) -> str:
    return f"((epoch_us({now}) - epoch_us({ts}) + 500000) // 1000000)"


def us(ts: str, now: str = NOW) -> str:
    return f"(epoch_us({now}) - epoch_us({ts}))"


def older(ts: str, seconds: int) -> str:
    return f"({ts} < {NOW} - INTERVAL {seconds} SECOND)"


def latest(*ts: str) -> str:
    return "greatest(" + ", ".join(f"coalesce({t}, TIMESTAMP '1900-01-01')" for t in ts) + ")"


def clock(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def top(select: str, k: int, order: str, by: str = "server_id") -> str:
    """First k rows per server of a query."""
    return f"""SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS _rn
        FROM ({select}) ranked) numbered WHERE _rn <= {k}"""


def lsn(x: str) -> str:
    return f"(('0x' || split_part({x}, '/', 1))::BIGINT * 4294967296 + ('0x' || split_part({x}, '/', 2))::BIGINT)"


def unit_bytes(setting: str = "setting", unit: str = "unit") -> str:
    return f"""(TRY_CAST({setting} AS BIGINT) * CASE {unit} WHEN 'kB' THEN 1024 WHEN 'MB' THEN 1048576
        WHEN 'GB' THEN 1073741824 WHEN '8kB' THEN 8192 ELSE 1 END)"""
