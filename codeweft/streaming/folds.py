"""Keyed folds: token buckets over tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeweft.session import spread

OUT = "key bigint, seq bigint, allowed boolean, left double"


def bucket(left: float, last: float | None, at: float, capacity: float, per_second: float) -> tuple[bool, float]:
    """Whether a request at a time is allowed, and the tokens left after it."""
    have = capacity if last is None else min(capacity, left + max(0.0, at - last) * per_second)
    return (True, have - 1) if have >= 1 else (False, have)


def rate_limited(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """key, seq, allowed and left for requests (key, ts, seq) through a token bucket per key (STM-09).

    A fold in time order is sequential by nature; rows of a key pass through one task in order, in batches, so its
    memory does not grow with the key. A null time counts as no time passed.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, left, last = None, capacity, None
        for pdf in batches:
            out = []
            for key, ts, seq in zip(pdf["key"], pdf["ts"], pdf["seq"]):
                if key != owner:
                    owner, left, last = key, capacity, None
                at = last if pd.isna(ts) else ts.timestamp()
                ok, left = bucket(left, last, at if at is not None else 0.0, capacity, per_second)
                last = at
                out.append((key, seq, ok, left))
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "left"])

    return spread(events.select("key", "ts", "seq"), "key").sortWithinPartitions("key", "ts", "seq").mapInPandas(fold, OUT)


def rate_limited_stream(events: DataFrame, capacity: float, per_second: float, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: the bucket of a key is its state between batches.

    A key is forgotten when the watermark passes the time at which its bucket is full again, so state stays bounded.
    """
    idle = int(1000 * capacity / per_second)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (capacity, None)
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for ts, seq in zip(pdf["ts"], pdf["seq"]):
            ok, left = bucket(left, last, ts.timestamp(), capacity, per_second)
            last = ts.timestamp()
            out.append((key[0], seq, ok, left))
        state.update((left, last))
        state.setTimeoutTimestamp(max(int(1000 * last) + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed", "left"])

    keyed = events.select("key", "ts", "seq").withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(fold, OUT, "left double, last double", "append", GroupStateTimeout.EventTimeTimeout)
