"""Entries that live for a time: keyed state that expires.

`lifetimes` follows entries by the time of the events. An entry is opened by a `put`, may be touched, and ends
when it is dropped or when its time is over; the end is a row. A touch renews it, or only notes when it was last seen. What
batch an event comes in makes no difference: an entry whose time was over before the next event ends at its own time, and a
timer ends those after which nothing comes. Events behind the watermark are left out.

`held` is a cache by the clock: it says of each row whether its key was held, and holds it from then on; the state
itself forgets keys when their time is over.

Both need the RocksDB state store. State is as large as the number of entries that live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PUT, TOUCH, DROP = "put", "touch", "drop"
_COLUMNS = ["key", "opened", "seen", "ended", "n", "reason"]


class Lifetimes(StatefulProcessor):
    """opened, last seen and due are milliseconds; n counts the events of the entry."""

    def __init__(self, ttl_ms: int, renew: bool):
        self.ttl, self.renew = ttl_ms, renew

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "opened long, seen long, due long, n long")

    def _row(self, key: str, life: tuple, ended: int, reason: str) -> tuple:
        return key, life[0], life[1], ended, life[3], reason

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["at", "n"], kind="stable")
        was = life = tuple(self.life.get()) if self.life.exists() else None
        out = []
        for at, kind in zip(f["at"].tolist(), f["kind"].tolist()):
            if life and at > life[2]:
                out.append(self._row(key[0], life, life[2], "expired"))
                life = None
            if kind == DROP:
                if life:
                    out.append(self._row(key[0], life, at, "dropped"))
                life = None
            elif life:
                life = (life[0], at, at + self.ttl if self.renew or kind == PUT else life[2], life[3] + 1)
            elif kind == PUT:
                life = (at, at, at + self.ttl, 1)
        if was and (not life or life[2] != was[2]):
            self.handle.deleteTimer(was[2] + 1)
        if life:
            self.life.update(life)
            if not was or life[2] != was[2]:
                self.handle.registerTimer(life[2] + 1)
        elif was:
            self.life.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        life = tuple(self.life.get()) if self.life.exists() else None
        if life and life[2] < expiredTimerInfo.getExpiryTimeInMs():
            self.life.clear()
            yield pd.DataFrame([self._row(key[0], life, life[2], "expired")], columns=_COLUMNS)

    def close(self) -> None:
        pass


def lifetimes(events: DataFrame, ttl_ms: int, renew: bool = True, lateness: str = "0 seconds") -> DataFrame:
    """key, opened, seen, ended (timestamps), n, reason (expired or dropped) of entries as they end.

    events: a stream of key, kind (put, touch or drop; others only move the watermark), ts and n, which orders
    events of one time. Times count in whole milliseconds; an entry lives until ttl_ms after, that moment included.
    """
    e = events.withWatermark("ts", lateness).select(F.col("key").cast("string").alias("key"), "kind", "ts", F.col("n").cast("long").alias("n"), F.unix_millis("ts").alias("at"))
    ends = e.groupBy("key").transformWithStateInPandas(statefulProcessor=Lifetimes(ttl_ms, renew), outputStructType="key string, opened long, seen long, ended long, n long, reason string", outputMode="append", timeMode="eventTime")
    return ends.select("key", *(F.timestamp_millis(c).alias(c) for c in ("opened", "seen", "ended")), "n", "reason")


class Held(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "n long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.entry.get()[0] if self.entry.exists() else 0
        out = []
        for f in rows:
            for seq in sorted(f["seq"].tolist()):
                out.append((key[0], seq, n > 0))
                n += 1
        self.entry.update((n,))
        yield pd.DataFrame(out, columns=["key", "seq", "held"])

    def close(self) -> None:
        pass


def held(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """key, seq, held for each row of a stream (key, seq): whether a row with the key came less than ttl_ms before.

    A clock never ends, and so a query with availableNow doesn't; run it by intervals, or once for each arrival.
    """
    r = rows.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"))
    return r.groupBy("key").transformWithStateInPandas(statefulProcessor=Held(ttl_ms), outputStructType="key string, seq long, held boolean", outputMode="update", timeMode="processingTime")
