"""Silver projections: retype, drop rows without a key, promote map entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuentaclara.operators import quality

def _envelope(df: DataFrame) -> list:
    cols = [F.col("__op").alias("_op"), F.col("__source_ts_ms").alias("_source_ts_ms")]
    if "_kafka_offset" in df.columns:
        cols.append(F.col("_kafka_offset").alias("_tiebreak"))
    return cols


def clean_expenses(bronze: DataFrame) -> DataFrame:
    keep = [
        "expense_id", "tenant_id", "user_id", "receipt_id", "workflow_id", "amount", "currency",
        F.col("date").try_cast("date").alias("date"),
        "vendor", "category", "status", "final_amount", "final_vendor",
        F.col("final_date").try_cast("date").alias("final_date"),
        "final_currency", "source_per_field", "approved_at", "created_at", "updated_at",
    ]
    return bronze.where("expense_id IS NOT NULL AND tenant_id IS NOT NULL").select(
        *keep, *_envelope(bronze), F.col("__deleted").alias("_deleted")
    )


def clean_receipts(bronze: DataFrame) -> DataFrame:
    return bronze.where("receipt_id IS NOT NULL").select(
        "receipt_id", "tenant_id", "user_id", "expense_id", "s3_key", "content_type",
        "size_bytes", "uploaded_at", *_envelope(bronze),
    )


def clean_ocr(bronze: DataFrame) -> DataFrame:
    # ocr_extra stays text on purpose: new sub-fields must not force a bronze backfill.
    return bronze.where("expense_id IS NOT NULL").select(
        "expense_id", "tenant_id", "user_id", "ocr_total", "ocr_total_confidence", "ocr_vendor",
        "ocr_vendor_confidence", F.col("ocr_date").try_cast("date").alias("ocr_date"),
        "ocr_date_confidence", "ocr_currency", "avg_confidence", "ocr_extra",
        "textract_raw_s3_key", "extracted_at", *_envelope(bronze),
    )


def clean_hitl(bronze: DataFrame) -> DataFrame:
    return bronze.where("task_id IS NOT NULL").select(
        "task_id", "tenant_id", "expense_id", "workflow_id", "status", "discrepancy_fields",
        "decision", "resolved_fields", "resolved_by", "resolved_at", "created_at",
        *_envelope(bronze),
    )


def clean_events(bronze: DataFrame) -> DataFrame:
    # Bootstrapped rows carry no metadata map; they get a NULL trace.
    if "metadata" not in bronze.columns:
        bronze = bronze.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    return bronze.where("event_id IS NOT NULL").select(
        "event_id", "expense_id", "tenant_id", "event_type", "actor",
        F.get_json_object("actor", "$.type").alias("actor_type"),
        F.get_json_object("actor", "$.id").alias("actor_id"),
        "details", "workflow_id", "metadata",
        F.try_element_at("metadata", F.lit("trace_id")).alias("trace_id"),
        "created_at", *_envelope(bronze),
    )


def hitl_discrepancies(hitl: DataFrame) -> DataFrame:
    """One row per (task, disputed field); tasks without conflicts give none."""
    return hitl.select(
        "task_id", "tenant_id", "expense_id", "workflow_id",
        F.explode("discrepancy_fields").alias("field_name"),
        "status", "decision", "resolved_by", "resolved_at", "created_at",
    )


def valid_changes(clean: DataFrame) -> DataFrame:
    """Changes that may reach the expense state. A delete needs no valid status: its row may
    carry nothing but the key."""
    is_delete = F.coalesce(F.col("_op") == "d", F.lit(False))
    for predicate in quality.EXPENSE_DROP.values():
        clean = clean.where(is_delete | quality.holds(predicate))
    return clean


#: topic -> (projection, deletes honoured)
CLEANERS = {
    "expenses": (clean_expenses, True),
    "receipts": (clean_receipts, True),
    "ocr_extractions": (clean_ocr, True),
    "hitl_tasks": (clean_hitl, True),
    "expense_events": (clean_events, False),
}
