"""Replay after an event identifier, over micro-batches, with expiry."""

import datetime as dt

from pyspark.sql import functions as F

from cuentaclara.functions import text
from cuentaclara.streaming import replay
from cuentaclara.streaming.ingest import DRAIN

START = dt.datetime(2026, 1, 1)
ROW = "channel string, at timestamp, event_id string, payload string, client_id string, last_event_id string, after bigint"


def ulid(seconds, tail="A" * 16):
    millis, head = int((START - dt.datetime(1970, 1, 1)).total_seconds() * 1000) + int(seconds * 1000), ""
    for _ in range(10):
        head, millis = text.CROCKFORD[millis % 32] + head, millis // 32
    return f"evt_{head}{tail}"


def events(spark, rows):
    df = spark.createDataFrame([(c, START + dt.timedelta(seconds=s), i, f"body {i}") for c, s, i in rows], "channel string, created_at timestamp, event_id string, payload string")
    return replay.published(df)


def requests(spark, rows):
    df = spark.createDataFrame([(c, who, last, START + dt.timedelta(seconds=s)) for c, s, who, last in rows], "channel string, client_id string, last_event_id string, at timestamp")
    return replay.requested(df)


def test_identifier_times(spark):
    row = spark.range(1).select(
        text.after_millis(F.lit(ulid(1.234))).alias("a"), text.after_millis(F.lit("evt_short")).alias("b"), text.after_millis(F.lit("evt_" + "U" * 26)).alias("c"),
        text.ulid_head(F.lit(1767225601234)).alias("d")).first()
    assert row.a == 1767225601234 and (row.b, row.c) == (0, 0) and ulid(1.234) == f"evt_{row.d}{'A' * 16}"


def test_missed_events_come_back_until_they_expire(spark, tmp_path):
    def step(frame):
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
        replay.start_replay(source, f"{tmp_path}/out", f"{tmp_path}/ck", ttl_seconds=600, lateness="10 seconds", trigger=DRAIN).awaitTermination()
        got = {}
        for r in spark.read.schema(replay.REPLAYED).parquet(f"{tmp_path}/out").collect():
            got.setdefault(r.client_id, []).append((r.position, r.event_id, r.payload))
        return {k: [e for _, e, _ in sorted(v)] for k, v in got.items()}

    names = [f"e{i:03}" for i in range(70)]
    first = events(spark, [("c1", i, names[i]) for i in range(70)] + [("c2", 5, "x1"), ("c2", 6, "x2"), ("c2", 6, "x2"), (None, 6, "lost")])
    assert step(first) == {}
    # The newest fifty are held; events are strictly later than the identifier; what cannot be read gets all.
    got = step(requests(spark, [("c1", 70, "late", ulid(39.5)), ("c1", 70, "same", ulid(40)), ("c1", 70, "broken", "evt_?"), ("c1", 70, "old", ulid(3)), ("c2", 70, "two", ulid(5)),
                                ("c2", 70, "none", None), ("nobody", 70, "empty", ulid(0))]))
    assert got == {"late": names[40:], "same": names[41:], "broken": names[20:], "old": names[20:], "two": ["x2"]}
    # Requests see the events of their own batch, also when the events arrive out of order.
    got = step(events(spark, [("c1", 300, "n2"), ("c1", 200, "n1")]).unionByName(requests(spark, [("c1", 301, "both", ulid(69))])))
    assert got["both"] == ["n1", "n2"]
    # Ten minutes of silence: c2 is empty for requests, and an event after the silence stands alone.
    assert "later" not in step(requests(spark, [("c2", 700, "later", ulid(0))]))
    got = step(events(spark, [("c2", 1000, "x3"), ("c1", 1500, "n3")]).unionByName(requests(spark, [("c2", 1001, "again", ulid(0)), ("c1", 1501, "after", ulid(0))])))
    assert got["again"] == ["x3"] and got["after"] == ["n3"]
    # The timer fires when event time has passed; a restart keeps what is left.
    assert step(events(spark, [("c3", 5000, "z")])).keys() == got.keys()
    got = step(requests(spark, [("c1", 2000, "gone", ulid(0)), ("c3", 5001, "last", ulid(0))]))
    assert "gone" not in got and got["last"] == ["z"]
