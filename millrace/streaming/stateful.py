"""Moving averages over the last so many readings of a key, with state that Spark keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, first timestamp, last timestamp, mean double, n int"
STATE = "times array<timestamp>, readings array<double>"


def count_window(df: DataFrame, key: str, ts: str, value: str, n: int, least: int | None = None, timeout_ms: int | None = None) -> DataFrame:
    """(key, first, last, mean, n) of the last n readings of each key, once it has at least `least` (n) of them.

    Each batch of new readings gives a row; the buffer keeps the newest n. With a timeout, a key that stays silent so long
    gives what it has and is forgotten."""
    least = n if least is None else least

    def row(key: str, times: list, readings: list) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "first": [times[0]], "last": [times[-1]], "mean": [sum(readings) / len(readings)], "n": pd.array([len(readings)], dtype="int32")})

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, readings = (list(x) for x in state.get) if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            if readings:
                yield row(str(k[0]), times, readings)
            return
        for batch in batches:
            both = sorted([*zip(times, readings, strict=True), *zip(batch[ts].dt.to_pydatetime() if hasattr(batch[ts], "dt") else batch[ts], batch[value], strict=True)])[-n:]
            times, readings = [pd.Timestamp(t).to_pydatetime() for t, _ in both], [float(v) for _, v in both]
        state.update((times, readings))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if len(readings) >= least:
            yield row(str(k[0]), times, readings)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(update, OUT, STATE, "append", timeout)


def latest_mean(df: DataFrame, key: str, ts: str, value: str, n: int, least: int = 3) -> DataFrame:
    """The same with a row for each key and batch in any case: a mean of 0 until there are `least` readings."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            held = sorted([*held, *zip([pd.Timestamp(t).to_pydatetime() for t in batch[ts]], batch[value].astype(float), strict=True)])[-n:]
        times, readings = [t for t, _ in held], [float(v) for _, v in held]
        state.update((times, readings))
        mean = sum(readings) / len(readings) if len(readings) >= least else 0.0
        yield pd.DataFrame({"key": [str(k[0])], "first": [times[0]], "last": [times[-1]], "mean": [mean], "n": pd.array([len(readings)], dtype="int32")})

    return df.groupBy(key).applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def sessions_by_event_time(df: DataFrame, key: str, ts: str, gap_ms: int, watermark: str) -> DataFrame:
    """(key, first, last, mean, n): the rows of a key counted until none came for gap_ms of event time. mean is their number per second."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ns = (list(x) for x in state.get) if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            n = int(ns[0])
            seconds = max(1.0, (times[1] - times[0]).total_seconds())
            yield pd.DataFrame({"key": [str(k[0])], "first": [times[0]], "last": [times[1]], "mean": [n / seconds], "n": pd.array([n], dtype="int32")})
            return
        n = int(ns[0]) if ns else 0
        for batch in batches:
            seen = [*times, *[pd.Timestamp(t).to_pydatetime() for t in batch[ts]]]
            times, n = [min(seen), max(seen)], n + len(batch)
        state.update((times, [float(n)]))
        last = int(pd.Timestamp(times[1]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))

    return df.withWatermark(ts, watermark).groupBy(key).applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
