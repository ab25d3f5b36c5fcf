"""Column expressions shared by the reports.

Semantics that differ between database servers and Spark (null placement,
integer division, size formatting, log positions, setting units) are settled
here once. Everything is a built-in Spark expression; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP = ["server_id", "snap_ts"]
MICROS = 1_000_000

# Schemas that never hold user objects.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
EXTENSION_SCHEMAS = ("_timescaledb_internal", "_timescaledb_cache")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_rows() -> Column:
    return F.count(F.lit(1))


# --- numbers ----------------------------------------------------------------

def percent(part, whole) -> Column:
    """100 * part / whole to two decimals, half away from zero, NULL when whole is 0.

    Exact for whole numbers: the rounding happens in wide integer arithmetic, so
    no binary fraction can tip a half the wrong way.
    """
    return ratio(part, whole, scale=100, digits=2)


def ratio(part, whole, scale: int = 1, digits: int = 2) -> Column:
    wide = "decimal(30,0)"
    n, d = _col(part).cast(wide), F.nullif(_col(whole).cast(wide), F.lit(0).cast(wide))
    doubled = n * F.lit(2 * scale * 10**digits).cast("decimal(7,0)") + d
    quotient = F.call_function("div", doubled, d * F.lit(2).cast("decimal(1,0)"))
    return quotient.cast("double") / F.lit(float(10**digits))


def two_decimals(c) -> Column:
    return F.round(_col(c), 2)


def whole_quotient(part, whole) -> Column:
    """Truncating division of two whole numbers; NULL when the divisor is 0."""
    return F.call_function("div", _col(part), F.nullif(_col(whole), F.lit(0)))


def coefficient_of_variation(stddev, mean) -> Column:
    return _col(stddev) / F.greatest(_col(mean), F.lit(1.0)) * 100


def as_number(c, kind: str = "bigint") -> Column:
    """Setting text to a number; text such as 'on' becomes NULL instead of an error."""
    return _col(c).try_cast(kind)


# --- text -------------------------------------------------------------------

def snippet(c, n: int = 120) -> Column:
    """Leading n characters and an ellipsis, which is added to short text too."""
    return F.concat(F.left(_col(c), F.lit(n)), F.lit("..."))


def normalise_parameters(c) -> Column:
    return F.regexp_replace(_col(c), r"\$[0-9]+", "?")


def matches_ci(c, pattern: str) -> Column:
    return _col(c).rlike("(?i)" + pattern)


def glob_to_like(glob: str) -> str:
    return glob.strip().replace("*", "%")


def match_globs(c, globs: str | None) -> Column:
    """True when the value matches any of the comma-separated globs."""
    if not globs:
        return F.lit(True)
    return any_of(*[_col(c).like(glob_to_like(g)) for g in globs.split(",")])


def any_of(*predicates: Column) -> Column:
    return reduce(or_, predicates)


def user_schema(c) -> Column:
    return ~_col(c).isin(*SYSTEM_SCHEMAS) & ~_col(c).rlike("^pg_toast")


def is_monitoring_query(c) -> Column:
    return _col(c).like("%pg_stat_%") | _col(c).like("%information_schema%")


def qualified(schema="schemaname", table="table_name") -> Column:
    return F.concat_ws(".", _col(schema), _col(table))


# --- time -------------------------------------------------------------------

def age_micros(ts, as_of="snap_ts") -> Column:
    return F.unix_micros(_col(as_of)) - F.unix_micros(_col(ts))


def age_seconds(ts, as_of="snap_ts") -> Column:
    """Age rounded to the nearest second."""
    return F.call_function("div", age_micros(ts, as_of) + F.lit(MICROS // 2), F.lit(MICROS))


def older_than(ts, seconds: int, as_of="snap_ts") -> Column:
    return age_micros(ts, as_of) > F.lit(seconds * MICROS)


def latest_of(*stamps) -> Column:
    """Newest of several times; a missing time counts as the distant past."""
    floor = F.lit("1900-01-01 00:00:00").cast("timestamp")
    return F.greatest(*[F.coalesce(_col(s), floor) for s in stamps])


# --- sizes, settings, log positions ------------------------------------------

SIZE_UNITS = ("kB", "MB", "GB", "TB", "PB")


def pretty_bytes(c) -> Column:
    """Human size: bytes below 10 kB, then the largest unit below 10,240, rounded to nearest."""
    n = _col(c).cast("bigint")
    chain = F.when(F.abs(n) < 10240, F.concat(n.cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(SIZE_UNITS):
        halves = F.shiftright(n, 9 + 10 * i)
        text = F.concat(F.shiftright(halves + 1, 1).cast("string"), F.lit(" " + unit))
        if i + 1 < len(SIZE_UNITS):
            chain = chain.when(F.abs(halves) < 20479, text)
        else:
            chain = chain.otherwise(text)
    return F.when(n.isNotNull(), chain)


# Multiplier of each unit a setting or a size argument may carry.
UNIT_BYTES = {
    "": 1, "b": 1, "8kb": 8192,
    "kb": 1024, "k": 1024,
    "mb": 1024**2, "m": 1024**2,
    "gb": 1024**3, "g": 1024**3,
    "tb": 1024**4, "t": 1024**4,
}


def setting_bytes(setting="setting", unit="unit") -> Column:
    """Setting value in bytes; unit-less settings keep their plain value."""
    key = F.lower(F.coalesce(_col(unit), F.lit("")))
    factor = reduce(
        lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), UNIT_BYTES.items(), F
    ).otherwise(F.lit(1))
    return as_number(setting) * factor.cast("bigint")


def parse_bytes(c) -> Column:
    """Size text such as '10GB', '512 MB', '1G' or '4096' to bytes; NULL when malformed."""
    text = F.trim(_col(c))
    number = F.regexp_extract(text, r"^([0-9]+)\s*[A-Za-z]*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^[0-9]+\s*([A-Za-z]*)$", 1))
    factor = reduce(lambda acc, kv: acc.when(unit == kv[0], F.lit(kv[1])), UNIT_BYTES.items(), F)
    return number.try_cast("bigint") * factor.otherwise(F.lit(None).cast("bigint")).cast("bigint")


def lsn_to_bytes(c) -> Column:
    """Log position 'X/Y' (two hexadecimal words) to a byte offset."""
    words = F.split(_col(c), "/")
    high = F.conv(F.get(words, F.lit(0)), 16, 10).cast("bigint")
    low = F.conv(F.get(words, F.lit(1)), 16, 10).cast("bigint")
    return high * F.lit(2**32).cast("bigint") + low


def lsn_diff(a, b) -> Column:
    return lsn_to_bytes(a) - lsn_to_bytes(b)


def wal_file_name(c, timeline: int = 1, segment_bytes: int = 16 * 1024**2) -> Column:
    """Segment file holding a position; a position on a boundary belongs to the previous file."""
    per_word = 2**32 // segment_bytes
    segment = F.call_function("div", lsn_to_bytes(c) - 1, F.lit(segment_bytes).cast("bigint"))
    return F.format_string(
        "%08X%08X%08X", F.lit(timeline),
        F.call_function("div", segment, F.lit(per_word).cast("bigint")),
        segment % per_word,
    )


def wraparound_percent(age) -> Column:
    return percent(age, F.lit(2_000_000_000))


def fillfactor_of(reloptions, default: int = 100) -> Column:
    option = F.get(F.filter(_col(reloptions), lambda o: o.startswith("fillfactor=")), F.lit(0))
    return F.coalesce(
        F.regexp_extract(option, "fillfactor=([0-9]+)", 1).try_cast("int"), F.lit(default)
    )


def array_length(c) -> Column:
    """Element count; NULL for a NULL or an empty array."""
    return F.when(F.size(_col(c)) > 0, F.size(_col(c)).cast("bigint"))


def utc_text(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def micro_units(ms) -> Column:
    """Milliseconds as whole microseconds, so that shares and sums of times are exact."""
    return F.round(_col(ms) * 1000).cast("decimal(30,0)")
