import json

import pytest
from pyspark.sql import functions as F

from cuentaclara import schemas
from cuentaclara.operators import bronze, operations, quality, repair, silver
from cuentaclara.sources import feeds


def messages(spark, *values):
    rows = [(None, None if v is None else v.encode(), "cdc.x", 0, i, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, feeds.MESSAGE)


def test_bad_input_never_fails_the_job(spark):
    raw = messages(
        spark,
        None,
        "{broken",
        json.dumps({"expense_id": "e1", "tenant_id": "t_1", "amount": 12.345, "created_at": "2026-01-02T03:04:05.5Z",
                    "approved_at": "yesterday", "__op": "u", "__source_ts_ms": 5, "__deleted": "true", "unknown": 1}),
        json.dumps({"expense_id": "e2", "amount": "twelve", "__op": "c", "__deleted": False}),
    )
    one, two = bronze.bronze_rows(raw, schemas.EXPENSES).orderBy("_kafka_offset").collect()
    assert (str(one.amount), one["__deleted"], one.approved_at, one["_kafka_offset"]) == ("12.35", True, None, 2)
    assert one.created_at is not None
    assert (two.expense_id, two.amount, two["__deleted"]) == ("e2", None, False)
    (letter,) = bronze.dead_letters(raw, schemas.EXPENSES).collect()
    assert (letter.offset, letter.topic_original, letter.payload_raw) == (1, "cdc.x", "e2Jyb2tlbg==")


@pytest.mark.parametrize(("sent", "names"), [
    (["amount", "date"], ["amount", "date"]),
    ([{"field": "amount", "user_value": 1}, {"field": "vendor"}], ["amount", "vendor"]),
    ({"_0": "date", "_1": "amount"}, ["date", "amount"]),
    ({"_0": {"field": "date"}}, ["date"]),
    ([], []),
    (None, None),
])
def test_conflict_list_shapes(spark, sent, names):
    raw = messages(spark, json.dumps({"task_id": "t", "discrepancy_fields": sent, "__op": "c"}))
    assert bronze.bronze_rows(raw, schemas.HITL_TASKS).first().discrepancy_fields == names


@pytest.mark.parametrize(("sent", "kind"), [({"type": "user", "id": "u1"}, "user"), ("worker", None)])
def test_actor_shapes(spark, sent, kind):
    raw = messages(spark, json.dumps({"event_id": "v", "actor": sent, "metadata": {"trace_id": "x"}, "__op": "c"}))
    row = silver.clean_events(bronze.bronze_rows(raw, schemas.EXPENSE_EVENTS)).first()
    assert (row.actor_type, row.trace_id) == (kind, "x")


def test_a_reader_of_few_columns_parses_only_those(spark):
    raw = messages(
        spark, None, "{broken", json.dumps({"unknown": 1}), '{"task_id": "t0", "resolved_fields": {"a": "b"',
        json.dumps({"task_id": "t1", "status": "pending", "resolved_fields": {"amount": "1"}, "discrepancy_fields": [{"field": "vendor"}], "created_at": "2026-01-02T03:04:05Z",
                    "__op": "u", "__source_ts_ms": 5, "__deleted": "true"}),
        json.dumps({"task_id": "t2", "status": {"odd": 1}, "resolved_fields": 7, "created_at": "yesterday", "__source_ts_ms": "x"}), json.dumps({"status": "s", "__op": "d"}))
    only = ["__source_ts_ms", "__op", "task_id", "status", "created_at", "__deleted", "_kafka_offset"]
    few = bronze.bronze_rows(raw, schemas.HITL_TASKS, only=only)
    assert sorted(map(str, few.collect())) == sorted(map(str, bronze.bronze_rows(raw, schemas.HITL_TASKS).select(*only).collect())) and few.count() == 3
    plan = few._jdf.queryExecution().analyzed().toString()
    assert "created_at" in plan and "resolved_fields" not in plan and "discrepancy_fields" not in plan
    receipts = messages(spark, json.dumps({"receipt_id": "r", "mime_type": "image/png", "created_at": "2026-01-01T00:00:00Z", "__op": "c"}))
    row = bronze.bronze_rows(receipts, schemas.RECEIPTS, only=["content_type", "uploaded_at"]).first()
    assert row.content_type == "image/png" and row.uploaded_at is not None
    event = messages(spark, json.dumps({"event_id": "v", "actor": {"type": "user", "id": "u1"}, "__op": "c"}))
    assert tuple(bronze.bronze_rows(event, schemas.EXPENSE_EVENTS, only=["actor_id", "event_id"]).first()) == ("u1", "v")


def test_a_sorted_trace_view_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    columns = "expense_id string, __source_ts_ms bigint, __op string, task_id string, status string, decision string, resolved_by string, resolved_at timestamp, created_at timestamp, workflow_id string"
    rows = spark.createDataFrame([(f"e{i}", (i * 37) % 101, "u", f"t{i}", "pending", None, None, None, None, None) for i in range(500)], columns).repartition(4)
    got = operations.trace_view("bronze_hitl", rows.mapInArrow(note, columns)).collect()
    assert [r["__source_ts_ms"] for r in got] == sorted((i * 37) % 101 for i in range(500)) and seen.value == 500


def test_receipt_aliases(spark):
    raw = messages(spark, json.dumps({"receipt_id": "r", "mime_type": "image/png", "created_at": "2026-01-01T00:00:00Z", "__op": "c"}))
    row = bronze.bronze_rows(raw, schemas.RECEIPTS).first()
    assert row.content_type == "image/png" and row.uploaded_at is not None


def test_snapshot_defaults(spark):
    docs = spark.createDataFrame([("e1", "t_1", "u", 5.5, "2026-01-02T10:00:00Z")], "expense_id string, tenant_id string, user_id string, amount double, created_at string")
    row = bronze.snapshot_rows(docs, schemas.EXPENSES).first()
    assert (row.currency, row.status, row["__op"], row["__deleted"], row.source_per_field) == ("USD", "pending", "c", False, {})
    assert row.updated_at == row.created_at and row["__source_ts_ms"] == 1767348000000
    tasks = spark.createDataFrame([("h1", "t_1", "e1")], "task_id string, tenant_id string, expense_id string")
    task = bronze.snapshot_rows(tasks, schemas.HITL_TASKS).first()
    assert (task.discrepancy_fields, task["__source_ts_ms"], task.status) == ([], 0, "pending")
    events = spark.createDataFrame([("v", "e", "t", "created", "2026-01-02T10:00:00Z")], "event_id string, expense_id string, tenant_id string, event_type string, created_at string")
    assert silver.clean_events(bronze.snapshot_rows(events, schemas.EXPENSE_EVENTS)).first().trace_id is None


def test_expectations(spark):
    df = spark.createDataFrame([("e1", "approved", 5.0), ("e2", "bogus", -1.0), (None, None, None)], "expense_id string, status string, amount double").withColumn("tenant_id", F.lit("t_1"))
    assert [r.expense_id for r in quality.drop_invalid(df, quality.EXPENSE_DROP).collect()] == ["e1"]
    with pytest.raises(Exception, match="pk_present"):
        quality.fail_invalid(df, quality.EXPENSE_FAIL).collect()
    from pyspark.sql import Observation

    seen = Observation("warn")
    assert quality.warn(df, quality.EXPENSE_WARN, seen).count() == 3
    assert seen.get == {"total_rows": 3, "valid_amount": 1, "valid_tenant": 0}
    report = {r.expectation: (r.failed, r.total) for r in quality.violation_report(df, "x", quality.EXPENSE_DROP).collect()}
    assert report == {"valid_status": (2, 3)}


def test_deletes_pass_the_status_rule(spark):
    df = spark.createDataFrame([("a", "approved", "u"), ("b", None, "d"), ("c", None, "u")], "expense_id string, status string, _op string")
    assert {r.expense_id for r in silver.valid_changes(df).collect()} == {"a", "b"}


def test_repairs_are_idempotent(spark):
    now = F.lit("2026-02-01").cast("timestamp")
    rows = spark.createDataFrame(
        [("a", "t", "rejected", "VECTOR_SYNC_FAILED", 1.0), ("b", "t", "rejected", "CANCELLED", 1.0), ("c", "t", "rejected", "VECTOR_SYNC_TIMEOUT", None)],
        "expense_id string, tenant_id string, status string, rejection_reason string, final_amount double").withColumn("updated_at", F.lit(None).cast("timestamp"))
    fixed, events = repair.recover_rejected(rows, now)
    assert {r.expense_id: r.status for r in fixed.collect()} == {"a": "approved", "b": "rejected", "c": "rejected"}
    assert events.count() == 1
    again, more = repair.recover_rejected(fixed, now)
    assert more.isEmpty() and again.exceptAll(fixed).isEmpty()
    assert repair.add_column(repair.add_column(rows, "x", "int"), "x", "int").columns.count("x") == 1
