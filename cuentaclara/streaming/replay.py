"""Replay of missed events: per channel a keyed state with the newest events and a time to live.

One stream carries published events and the requests of clients that come back with the identifier of the last event
they saw. State per channel: a list of at most ``cap`` events, and when the last one was published. A channel to which
nothing was published for ``ttl_seconds`` forgets its events, by an event-time timer. A request gets the held events that
are strictly later than the time in its identifier, oldest first; an identifier that cannot be read gets all of them.

Defined results: the requests of a micro-batch see its events. Events of one identifier count once, as published last.
Rows without channel, time or event identifier, and requests without an identifier, give nothing. Of events with equal
times the greater identifier is the newer one.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cuentaclara.functions.text import after_millis
from cuentaclara.operators.operations import BUFFER_CAP
from cuentaclara.streaming.ingest import CONTINUOUS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUFFER_TTL_SECONDS = 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "millis bigint, event_id string, payload string"
REPLAYED = "channel string, client_id string, last_event_id string, position bigint, event_id string, millis bigint, payload string"


def published(events: DataFrame) -> DataFrame:
    """Events (channel, event_id, created_at, payload) as rows of the stream."""
    return events.select(
        "channel", F.col("created_at").cast("timestamp").alias("at"), F.col("event_id"), F.col("payload"), F.lit(None).cast("string").alias("client_id"),
        F.lit(None).cast("string").alias("last_event_id"), F.lit(None).cast("bigint").alias("after"))


def requested(requests: DataFrame) -> DataFrame:
    """Requests (channel, client_id, last_event_id, at) as rows of the stream."""
    none = F.lit(None).cast("string")
    return requests.where(F.col("last_event_id").isNotNull()).select(
        "channel", F.col("at").cast("timestamp").alias("at"), none.alias("event_id"), none.alias("payload"),
        F.coalesce("client_id", F.lit("")).alias("client_id"), "last_event_id", after_millis(F.col("last_event_id")).alias("after"))


class Held:
    """The newest events of a channel in order, without those before a silence longer than the time to live."""

    def __init__(self, cap: int, ttl: int) -> None:
        self.cap, self.ttl = cap, ttl
        self.by_id: dict[str, tuple[int, str, str | None]] = {}

    def add(self, millis: int, event_id: str, payload: str | None) -> None:
        self.by_id[event_id] = (millis, event_id, payload)
        if len(self.by_id) > 4 * self.cap:
            self.by_id = {e[1]: e for e in heapq.nlargest(self.cap, self.by_id.values(), key=lambda e: e[:2])}

    def events(self) -> list[tuple[int, str, str | None]]:
        newest = heapq.nlargest(self.cap, self.by_id.values(), key=lambda e: e[:2])
        for i in range(1, len(newest)):
            if newest[i - 1][0] - newest[i][0] > self.ttl:
                newest = newest[:i]
                break
        return newest[::-1]


class ReplayBuffer(StatefulProcessor):
    def __init__(self, cap: int, ttl_seconds: int) -> None:
        self.cap, self.ttl = cap, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.last = handle.getValueState("last", "millis bigint")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        held, asked, got = Held(self.cap, self.ttl), [], False
        for millis, event_id, payload in self.held.get():
            held.add(millis, event_id, payload)
        for frame in rows:
            for at, event_id, payload, client, seen, after in zip(
                    frame["millis"], frame["event_id"], frame["payload"], frame["client_id"], frame["last_event_id"], frame["after"], strict=True):
                if client is not None:
                    asked.append((int(at), client, seen, int(after)))
                else:
                    held.add(int(at), event_id, payload)
                    got = True
        events = held.events()
        if got:
            self.held.put(events)
            self._renew_timer(events[-1][0])
        out = []
        for at, client, seen, after in asked:
            if not events or at - events[-1][0] > self.ttl:
                continue
            missed = [e for e in events if e[0] > after]
            out += [(key[0], client, seen, i, e[1], e[0], e[2]) for i, e in enumerate(missed)]
        if out:
            yield pd.DataFrame(out, columns=["channel", "client_id", "last_event_id", "position", "event_id", "millis", "payload"])

    def _renew_timer(self, newest: int) -> None:
        if self.last.exists():
            before = self.last.get()[0]
            if before == newest:
                return
            self.handle.deleteTimer(before + self.ttl)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.held.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def replayed(rows: DataFrame, *, cap: int = BUFFER_CAP, ttl_seconds: int = BUFFER_TTL_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """What each request gets. ``rows`` is a union of ``published`` and ``requested`` streams."""
    usable = rows.where(F.col("channel").isNotNull() & F.col("at").isNotNull() & (F.col("event_id").isNotNull() | F.col("client_id").isNotNull()))
    stamped = usable.withWatermark("at", lateness).withColumn("millis", F.unix_millis("at"))
    return stamped.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=ReplayBuffer(cap, ttl_seconds), outputStructType=REPLAYED, outputMode="Append", timeMode="eventTime")


def start_replay(rows: DataFrame, path: str, checkpoint: str, *, cap: int = BUFFER_CAP, ttl_seconds: int = BUFFER_TTL_SECONDS,
                 lateness: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Append the answers to a table. List state and timers need the RocksDB store; its setting is read when a query starts."""
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return (
            replayed(rows, cap=cap, ttl_seconds=ttl_seconds, lateness=lateness)
            .writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or CONTINUOUS)).queryName("replay").start())
    finally:
        conf.set(name, before)
