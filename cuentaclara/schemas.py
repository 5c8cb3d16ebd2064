"""Envelope and table schemas, written as Spark DDL.

Flags and nested text that arrive in more than one JSON shape (``__deleted``,
``actor``, ``discrepancy_fields``) are read as strings and normalised later, so
one odd producer cannot turn a whole record into NULLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ENVELOPE = "__op string, __source_ts_ms bigint, __deleted string"
CORRUPT = "_corrupt_record"


def _ddl(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


@dataclass(frozen=True)
class Topic:
    """One change feed: its payload, business key and the columns that need retyping."""

    name: str
    key: str
    payload: str
    money: tuple[str, ...] = ()
    timestamps: tuple[str, ...] = ()

    @property
    def json_schema(self) -> T.StructType:
        return _ddl(f"{self.payload}, {ENVELOPE}, {CORRUPT} string")

    @property
    def columns(self) -> list[str]:
        return _ddl(self.payload).fieldNames()


# Payload fields of each topic, as the source writes them.
EXPENSES = Topic(
    name="expenses",
    key="expense_id",
    payload=(
        "expense_id string, tenant_id string, user_id string, receipt_id string, "
        "workflow_id string, amount double, currency string, date string, vendor string, "
        "category string, status string, final_amount double, final_vendor string, "
        "final_date string, final_currency string, source_per_field map<string,string>, "
        "approved_at string, created_at string, updated_at string"
    ),
    money=("amount", "final_amount"),
    timestamps=("approved_at", "created_at", "updated_at"),
)

RECEIPTS = Topic(
    name="receipts",
    key="receipt_id",
    payload=(
        "receipt_id string, tenant_id string, user_id string, expense_id string, "
        "s3_key string, content_type string, mime_type string, size_bytes bigint, "
        "uploaded_at string, created_at string"
    ),
    timestamps=("uploaded_at",),
)

HITL_TASKS = Topic(
    name="hitl_tasks",
    key="task_id",
    payload=(
        "task_id string, tenant_id string, expense_id string, workflow_id string, "
        "status string, discrepancy_fields string, decision string, "
        "resolved_fields map<string,string>, resolved_by string, resolved_at string, "
        "created_at string"
    ),
    timestamps=("resolved_at", "created_at"),
)

OCR_EXTRACTIONS = Topic(
    name="ocr_extractions",
    key="expense_id",
    payload=(
        "expense_id string, tenant_id string, user_id string, ocr_total double, "
        "ocr_total_confidence double, ocr_vendor string, ocr_vendor_confidence double, "
        "ocr_date string, ocr_date_confidence double, ocr_currency string, "
        "avg_confidence double, ocr_extra string, textract_raw_s3_key string, "
        "extracted_at string, created_at string"
    ),
    money=("ocr_total",),
    timestamps=("extracted_at",),
)

EXPENSE_EVENTS = Topic(
    name="expense_events",
    key="event_id",
    payload=(
        "event_id string, expense_id string, tenant_id string, event_type string, "
        "actor string, details map<string,string>, workflow_id string, "
        "metadata map<string,string>, created_at string"
    ),
    timestamps=("created_at",),
)

TOPICS = {t.name: t for t in (EXPENSES, RECEIPTS, HITL_TASKS, OCR_EXTRACTIONS, EXPENSE_EVENTS)}

#: The statuses an expense may have.
EXPENSE_STATUSES = (
    "pending",
    "processing",
    "hitl_required",
    "approved",
    "rejected",
    "cancelled",
    "failed",
)

LINE_ITEM = (
    "struct<item:string, price:string, quantity:string, unit_price:string, "
    "product_code:string, row_text:string, confidence_avg:double>"
)
SUMMARY_FIELD = "struct<field:string, value:string, confidence:double, label_text:string>"

#: ``ocr_extra`` arrives with real arrays or with arrays spelled as ``{"_0": ...}`` objects.
OCR_EXTRA_ARRAYS = f"struct<summary_fields:array<{SUMMARY_FIELD}>, line_items:array<{LINE_ITEM}>>"
OCR_EXTRA_MAPS = (
    f"struct<summary_fields:map<string,{SUMMARY_FIELD}>, line_items:map<string,{LINE_ITEM}>>"
)

_DETECTION = "struct<Text:string, Confidence:double>"
OCR_RESPONSE = (
    "struct<ExpenseDocuments:array<struct<"
    f"SummaryFields:array<struct<Type:struct<Text:string>, ValueDetection:{_DETECTION}, "
    "LabelDetection:struct<Text:string>>>, "
    "LineItemGroups:array<struct<LineItems:array<struct<LineItemExpenseFields:"
    f"array<struct<Type:struct<Text:string>, ValueDetection:{_DETECTION}>>>>>>>>>"
)
QUERY_RESPONSE = (
    "struct<Blocks:array<struct<BlockType:string, Id:string, Text:string, Confidence:double, "
    "Query:struct<Alias:string>>>>"
)
