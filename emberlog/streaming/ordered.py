"""Rules that need a key's rows in order of time, on streams: exact, whatever order the rows arrive in.

Rows wait in the key's state until the watermark has passed them; then they are folded in order of time, so a replay or
another split into batches gives the same rows out, and the same as the batch operators. A fold's own state is a few
numbers. Rows later than the watermark are dropped by Spark. The session's state store must be the RocksDB one
(`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
_WAITING = "us long, bad boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class AnchoredWindows:
    """Windows that open at the first row after the last one's end: (window_start, n, failed)."""

    schema, state, out = "start long, n long, failed long", (None, 0, 0), "window_start long, n long, failed long"

    def __init__(self, width: int):
        self.width = width

    def closed(self, state, now: int):
        """What is certain once no row before `now` can come."""
        if state[0] is not None and now > state[0] + self.width:
            return self.state, [state]
        return state, []

    def fold(self, state, us: int, bad: bool):
        start, n, failed = state
        return (us if start is None else start, n + 1, failed + int(bad)), []

    def deadline(self, state) -> int | None:
        return None if state[0] is None else state[0] + self.width


class FirstBurst:
    """The rows within `width` of a key's first row, if they are `least` or more: (start_us, end_us, n)."""

    schema, state, out = "start long, last long, n long, done boolean", (None, None, 0, False), "start_us long, end_us long, n long"

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least

    def closed(self, state, now: int):
        start, last, n, done = state
        if start is not None and not done and now >= start + self.width:
            return (start, last, n, True), [(start, last, n)] if n >= self.least else []
        return state, []

    def fold(self, state, us: int, bad: bool):
        start, last, n, done = state
        return (us if start is None else start, us, n + 1, False) if not done else state, []

    def deadline(self, state) -> int | None:
        return None if state[0] is None or state[3] else state[0] + self.width


class FirstCrowd:
    """The first failure t of a key with `least` or more failures in [t, t + width]: (start_us, failures). The state holds
    the last `least` - 1 failures, or the open window's start and count.
    """

    schema, state, out = "recent array<long>, start long, n long, done boolean", ([], None, 0, False), "start_us long, failures long"

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least

    def closed(self, state, now: int):
        recent, start, n, done = state
        if start is not None and not done and now > start + self.width:
            return ([], start, n, True), [(start, n)]
        return state, []

    def fold(self, state, us: int, bad: bool):
        recent, start, n, done = state
        if not bad or done:
            return state, []
        if start is not None:
            return (recent, start, n + 1, False), []
        recent = [*recent, us][-self.least :]
        if len(recent) == self.least and us - recent[0] <= self.width:
            return ([], recent[0], self.least, False), []
        return (recent, None, 0, False), []

    def deadline(self, state) -> int | None:
        return None if state[1] is None or state[3] else state[1] + self.width


class _Ordered(StatefulProcessor):
    def __init__(self, fold, keys: int, columns: list[str]):
        self.rule, self.keys, self.columns = fold, keys, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.own = handle.getValueState("own", self.rule.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:
            self.waiting.appendList([(int(us), bool(bad)) for us, bad in zip(batch["us"], batch["bad"])])
            top = int(batch["us"].max())
            last = top if last is None else max(last, top)
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [(int(r[0]), bool(r[1])) for r in self.waiting.get()]
        ready = sorted(r for r in rows if r[0] < now)
        state, out = tuple(self.own.get()) if self.own.exists() else self.rule.state, []
        for us, bad in ready:
            state, found = self.rule.closed(state, us)
            out += found
            state, found = self.rule.fold(state, us, bad)
            out += found
        state, found = self.rule.closed(state, now)
        out += found
        if ready:
            rest = [r for r in rows if r[0] >= now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.own.update(tuple(list(x) if isinstance(x, list) else x for x in state))
        end = self.rule.deadline(state)
        if end is not None:
            self.handle.registerTimer(end // 1000 + 1)
        values = key if isinstance(key, tuple) else (key,)
        yield pd.DataFrame([(*values, *x) for x in out], columns=self.columns)

    def close(self) -> None:
        pass


def _ordered(e: DataFrame, keys: list[str], rule, late: str) -> DataFrame:
    """(keys, what the rule gives) of entries (keys, us, outcome, event_ts)."""
    rows = e.select(*keys, "us", (F.coalesce(F.col("outcome"), F.lit("")) == "failure").alias("bad"), "event_ts").filter("us is not null").withWatermark("event_ts", late)
    kinds = dict(e.dtypes)
    out = ", ".join([f"{k} {kinds[k]}" for k in keys] + [rule.out])
    names = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy(*keys).transformWithStateInPandas(_Ordered(rule, len(keys), names), out, "append", "eventtime")


def anchored_windows(e: DataFrame, width_us: int, late: str = LATE) -> DataFrame:
    """(ip, window_start, n, failed) of windows anchored at the first entry after the last one's end."""
    return _ordered(e, ["ip"], AnchoredWindows(width_us), late)


def bursts(e: DataFrame, width_us: int = 60_000_000, least: int = 10, late: str = LATE) -> DataFrame:
    """(ip, start_us, end_us, n) of ips with `least` or more entries in less than `width_us` from their first."""
    return _ordered(e, ["ip"], FirstBurst(width_us, least), late)


def brute_force(e: DataFrame, least: int = 10, width_us: int = 300_000_000, late: str = LATE) -> DataFrame:
    """(ip, user, start_us, failures): the first start with `least` or more failures in the `width_us` from it."""
    return _ordered(e.filter("outcome = 'failure'"), ["ip", "user"], FirstCrowd(width_us, least), late)
