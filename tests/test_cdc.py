import random

from pyspark.sql import functions as F

from cuentaclara.operators import cdc

SCHEMA = "id string, v string, _op string, _source_ts_ms long, _tiebreak long"
LOG = [
    ("a", "1", "c", 10, 1), ("a", "2", "u", 20, 2), ("a", "1", "r", 15, 3),   # snapshot re-read arrives late
    ("b", "1", "c", 10, 4), ("b", None, "d", 30, 5), ("b", "9", "u", 20, 6),  # delete before an older update
    ("c", "1", "c", 10, 7), ("c", "2", "u", 10, 8),                           # equal sequences: later offset wins
    ("d", None, "d", 5, 9), ("d", "new", "c", 6, 10),                         # created again
]
STATE = {("a", "2"), ("c", "2"), ("d", "new")}


def state(spark, log):
    return {(r.id, r.v) for r in cdc.silver_state(spark.createDataFrame(log, SCHEMA), "id").collect()}


def test_sequence_decides(spark):
    assert state(spark, LOG) == STATE
    shuffled = LOG[:]
    random.Random(3).shuffle(shuffled)
    assert state(spark, shuffled) == STATE
    assert state(spark, LOG + LOG) == STATE


def test_tombstones_survive_a_staged_fold(spark):
    order = ["_source_ts_ms", "_tiebreak"]
    first = cdc.fold_latest(spark.createDataFrame(LOG[:5], SCHEMA), ["id"], order)
    whole = cdc.fold_latest(first.unionByName(spark.createDataFrame(LOG[5:], SCHEMA)), ["id"], order)
    assert {(r.id, r.v) for r in whole.where("_op <> 'd'").collect()} == STATE


def test_without_delete_rule(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    assert cdc.silver_state(df, "id", deletes=False).count() == 4


def test_history(spark):
    df = spark.createDataFrame(LOG, SCHEMA).withColumn("at", F.timestamp_millis("_source_ts_ms"))
    rows = cdc.history(df, ["id"], "at", ["_tiebreak"], apply_as_deletes=cdc.DELETE).select(
        "id", "v", F.unix_millis("__start_at"), F.unix_millis("__end_at")).collect()
    assert sorted(tuple(r) for r in rows if r.id == "b") == [("b", "1", 10, 20), ("b", "9", 20, 30)]
    assert [tuple(r) for r in rows if r.id == "d"] == [("d", "new", 6, None)]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, n int, v string")
    assert {(r.k, r.v) for r in cdc.upsert(old, new, ["k"], ["n"]).collect()} == {("a", "z"), ("b", "y")}
