"""Streams that need a key's samples in time order: steps over window edges, and alerts that fire while a breach lasts.

Samples arrive in any order inside the lateness. Each key keeps those the watermark has not passed yet, and what the
last one before them left behind. Event-time timers say when the watermark has passed a sample (or the end of its
window); only then are samples taken, oldest first. So a replayed stream gives exactly what the stored twins give.

The state of a key is the samples of one window and the lateness, and one carried sample that does not expire.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fleetstat.operators.alerts import KEYS, judged
from fleetstat.streaming.windows import LATENESS, _late

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime.datetime(1970, 1, 1)


def require_state_store(spark: SparkSession) -> None:
    """Timers and lists need the RocksDB state store; it is set for streams this session starts from now on."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _micros(at: pd.Timestamp) -> int:
    return at.value // 1000


def _time(micros: int) -> datetime.datetime:
    return EPOCH + datetime.timedelta(microseconds=micros)


class _InOrder(StatefulProcessor):
    """Holds samples until the watermark has passed them; subclasses say when, and what to make of them."""

    #: Schema of a held sample after its time, and of what is carried.
    held: str
    carried: str

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, {self.held}")
        self.carry = handle.getValueState("carry", self.carried)

    def due(self, at: int) -> int:
        """The time (microseconds) the watermark must reach before a sample at `at` may be taken."""
        raise NotImplementedError

    def sample(self, row) -> tuple:
        raise NotImplementedError

    def take(self, key: tuple, samples: list[tuple], carry: tuple | None) -> tuple[list[tuple], tuple | None]:
        """Result rows of samples in order, and what is carried on."""
        raise NotImplementedError

    def columns(self) -> list[str]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh, timers = [], set()
        for frame in rows:
            for row in frame.itertuples(index=False):
                at = _micros(row.snap_ts)
                fresh.append((at, *self.sample(row)))
                timers.add(-(-self.due(at) // 1000))
        if fresh:
            self.waiting.appendList(fresh)
        for timer in timers:
            self.handle.registerTimer(timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(s) for s in self.waiting.get()]
        ready = sorted((s for s in waiting if self.due(s[0]) <= now), key=lambda s: tuple((v is not None, v) for v in s))
        if not ready:
            return
        rest = [s for s in waiting if self.due(s[0]) > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        found, carry = self.take(key, ready, tuple(self.carry.get()) if self.carry.exists() else None)
        if carry is not None:
            self.carry.update(carry)
        if found:
            yield pd.DataFrame(found, columns=self.columns())

    def close(self) -> None:
        pass


class _Windowed(_InOrder):
    """Samples are taken when their window has closed; each step counts in the window of its later sample."""

    def __init__(self, keys: list[str], window_micros: int):
        self.keys, self.window = keys, window_micros

    def due(self, at: int) -> int:
        return at - at % self.window + self.window

    def step(self, before: tuple, now: tuple) -> tuple:
        raise NotImplementedError

    def take(self, key, samples, carry):
        sums: dict[int, list] = {}
        before = carry
        for at, *values in samples:
            if before is not None:
                grown = self.step(before, tuple(values))
                total = sums.setdefault(self.due(at), [None] * len(grown))
                for i, g in enumerate(grown):
                    if g is not None:
                        total[i] = g + (total[i] or 0)
            before = tuple(values)
        return [(_time(end - self.window), _time(end), *key, *total) for end, total in sorted(sums.items())], before


class CounterSteps(_Windowed):
    """Growth of counters; a smaller value means the counter was reset and started from zero."""

    def __init__(self, keys: list[str], window_micros: int, counters: list[str], tie: str):
        super().__init__(keys, window_micros)
        self.counters, self.tie = counters, tie
        self.carried = ", ".join(["tie bigint", *(f"v{i} bigint" for i in range(len(counters)))])
        self.held = self.carried

    def sample(self, row) -> tuple:
        values = [getattr(row, c) for c in (self.tie, *self.counters)]
        return tuple(None if pd.isna(v) else int(v) for v in values)

    def step(self, before, now):
        return tuple(None if a is None or b is None else (b if b < a else b - a) for a, b in zip(before[1:], now[1:]))

    def columns(self):
        return ["window_start", "window_end", *self.keys, *self.counters]


class StateSteps(_Windowed):
    """How often a state differs from the one before it; NULL is a state like any other."""

    held = carried = "tie bigint, state string"

    def __init__(self, keys: list[str], window_micros: int, column: str, tie: str):
        super().__init__(keys, window_micros)
        self.column, self.tie = column, tie

    def sample(self, row) -> tuple:
        tie, state = getattr(row, self.tie), getattr(row, self.column)
        return None if pd.isna(tie) else int(tie), None if pd.isna(state) else str(state)

    def step(self, before, now):
        return (int(before[1] != now[1]),)

    def columns(self):
        return ["window_start", "window_end", *self.keys, "changes"]


class LastingAlert(_InOrder):
    """Fires at every scrape at which a breach has lasted as long as its rule asks."""

    held = "value double, breach boolean"
    carried = "at bigint, breach boolean, since bigint"

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def due(self, at: int) -> int:
        return at

    def sample(self, row) -> tuple:
        return None if pd.isna(row.value) else float(row.value), bool(row.breach)

    def take(self, key, samples, carry):
        found = []
        last, breaching, since = carry or (None, False, None)
        for at, value, breach in samples:
            if breach and (not breaching or at - last > self.gap):
                since = at
            last, breaching = at, breach
            if breach and at - since >= 1_000_000 * key[-1]:
                found.append((*key, _time(at), value, _time(since), (at - since) / 1_000_000))
        return found, (last, breaching, since)

    def columns(self):
        return [*KEYS, "snap_ts", "value", "since", "lasted_seconds"]


def _interval_micros(spark: SparkSession, text: str) -> int:
    start = "timestamp'1970-01-01 00:00:00 UTC'"
    return spark.range(1).select(F.unix_micros(F.expr(f"{start} + INTERVAL {text}"))).first()[0]


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, lateness: str, schema: str) -> DataFrame:
    require_state_store(df.sparkSession)
    return _late(df, lateness).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def counter_steps(df: DataFrame, keys: list[str], counters: list[str], window: str, tie: str = "sample_id", lateness: str = LATENESS) -> DataFrame:
    """Growth of counters per window of a stream, the step from the window before included."""
    processor = CounterSteps(keys, _interval_micros(df.sparkSession, window), counters, tie)
    schema = f"window_start timestamp, window_end timestamp, {_key_schema(df, keys)}, " + ", ".join(f"{c} bigint" for c in counters)
    return _run(df.select("snap_ts", *keys, tie, *counters), keys, processor, lateness, schema)


def state_steps(df: DataFrame, keys: list[str], column: str, window: str, tie: str = "sample_id", lateness: str = LATENESS) -> DataFrame:
    """Changes of a state per window of a stream, the change since the window before included."""
    processor = StateSteps(keys, _interval_micros(df.sparkSession, window), column, tie)
    schema = f"window_start timestamp, window_end timestamp, {_key_schema(df, keys)}, changes bigint"
    return _run(df.select("snap_ts", *keys, tie, column), keys, processor, lateness, schema)


def lasting_alerts(samples: DataFrame, rules: DataFrame, gap: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """The stream twin of ``operators.alerts.lasting_alerts``: an alert is sent as soon as it has lasted, not when it ends."""
    processor = LastingAlert(_interval_micros(samples.sparkSession, gap))
    schema = ("server_id bigint, metric string, object string, severity string, for_seconds bigint, snap_ts timestamp, value double, "
              "since timestamp, lasted_seconds double")
    return _run(judged(samples, rules), KEYS, processor, lateness, schema)
