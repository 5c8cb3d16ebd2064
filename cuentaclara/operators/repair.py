"""One-off corrections, each idempotent: a second run changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rejections that only mean "indexing failed after approval".
RECOVERABLE_REASONS = ("VECTOR_SYNC_TIMEOUT", "VECTOR_SYNC_FAILED")


def backfill_hitl_decision(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Fill decision, resolved_fields and resolved_by from ``hitl_resolved`` events where the task
    has no decision yet. The first event of a task counts."""
    found = F.struct(
        F.col("details")["decision"].alias("decision"),
        F.col("details")["resolved_fields"].alias("resolved_fields"),
        F.col("actor_id").alias("resolved_by"),
    )
    answers = (
        events.where((F.col("event_type") == "hitl_resolved") & F.col("details")["hitl_task_id"].isNotNull())
        .groupBy(F.col("details")["hitl_task_id"].alias("task_id"))
        .agg(F.min_by(found, F.struct("created_at", "event_id")).alias("_answer"))
    )
    unset = F.col("decision").isNull() & F.col("_answer").isNotNull()
    parsed = F.from_json(F.col("_answer")["resolved_fields"], "map<string,string>")
    return tasks.join(answers, "task_id", "left").withColumns({
        "resolved_fields": F.when(unset, parsed).otherwise(F.col("resolved_fields")),
        "resolved_by": F.when(unset, F.col("_answer")["resolved_by"]).otherwise(F.col("resolved_by")),
        "decision": F.when(unset, F.col("_answer")["decision"]).otherwise(F.col("decision")),
    }).drop("_answer")


def backfill_receipt_expense(receipts: DataFrame, expenses: DataFrame) -> DataFrame:
    """Fill ``expense_id`` of receipts from the expense that names them, only where unset."""
    owners = expenses.where(F.col("receipt_id").isNotNull()).groupBy("receipt_id").agg(
        F.min("expense_id").alias("_owner")
    )
    return receipts.join(owners, "receipt_id", "left").withColumn(
        "expense_id", F.coalesce("expense_id", "_owner")
    ).drop("_owner")


def recover_rejected(expenses: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(corrected expenses, events to append) for rows rejected although approval had finished.

    Looking at the second frame without writing anything is the dry run.
    """
    wrong = (
        (F.col("status") == "rejected")
        & F.col("rejection_reason").isin(*RECOVERABLE_REASONS)
        & F.col("final_amount").isNotNull()
    )
    hit = F.coalesce(wrong, F.lit(False))
    fixed = expenses.withColumn("_hit", hit).withColumns({
        "status": F.when(F.col("_hit"), F.lit("approved")).otherwise(F.col("status")),
        "rejection_reason": F.when(F.col("_hit"), F.lit(None).cast("string")).otherwise(F.col("rejection_reason")),
        "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at")),
    }).drop("_hit")
    events = expenses.where(hit).select(
        F.concat(F.lit("evt_recover_"), "expense_id", F.lit("_"), F.unix_millis(now.cast("timestamp")).cast("string")).alias("event_id"),
        "expense_id", "tenant_id",
        F.lit("vector_sync_failed").alias("event_type"),
        F.to_json(F.struct(F.lit("system").alias("type"), F.lit("ops:recover-rejected").alias("id"))).alias("actor"),
        F.create_map(F.lit("prior_rejection_reason"), F.col("rejection_reason")).alias("details"),
        now.alias("created_at"),
    )
    return fixed, events


def rename_key(df: DataFrame, old: str, new: str) -> DataFrame:
    """Move ``old`` to ``new`` where ``old`` is set; rows that already use ``new`` keep it."""
    if old not in df.columns:
        return df
    if new not in df.columns:
        return df.withColumnRenamed(old, new)
    return df.withColumn(new, F.coalesce(old, new)).drop(old)


def add_column(df: DataFrame, name: str, ddl_type: str) -> DataFrame:
    """Add a NULL column unless the table has it already."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(ddl_type))
