"""Gold tables: audited expenses, their history, chunks for retrieval and tenant KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara import schemas
from cuentaclara.operators import skew
from cuentaclara.sources.tables import bucketed, replace_keys, staged


def hitl_rollup(hitl: DataFrame) -> DataFrame:
    """One row per expense over its resolved tasks; each column takes its own maximum."""
    maxima = {
        "hitl_resolved_at": "resolved_at",
        "hitl_decision": "decision",
        "hitl_resolved_by": "resolved_by",
        "hitl_conflict_fields": "discrepancy_fields",
    }
    return (
        hitl.where(F.col("status") == "resolved")
        .groupBy("expense_id")
        .agg(*[F.max(src).alias(out) for out, src in maxima.items()])
    )


def hitl_latest(hitl: DataFrame) -> DataFrame:
    """Variant of the rollup that takes all columns from the most recently resolved task."""
    row = F.struct(
        F.col("resolved_at").alias("hitl_resolved_at"),
        F.col("decision").alias("hitl_decision"),
        F.col("resolved_by").alias("hitl_resolved_by"),
        F.col("discrepancy_fields").alias("hitl_conflict_fields"),
    )
    latest = F.max_by(row, F.struct("resolved_at", "task_id")).alias("r")
    resolved = hitl.where(F.col("status") == "resolved")
    return resolved.groupBy("expense_id").agg(latest).select("expense_id", "r.*")


def trace_per_expense(events: DataFrame) -> DataFrame:
    """The earliest known trace id of each expense."""
    earliest = F.min_by("trace_id", F.struct("created_at", "event_id")).alias("trace_id")
    return events.where(F.col("trace_id").isNotNull()).groupBy("expense_id").agg(earliest)


def expense_audit(
    expenses: DataFrame, ocr: DataFrame, hitl: DataFrame, events: DataFrame
) -> DataFrame:
    """One row per approved expense. A human value beats OCR, OCR beats what was reported.

    Every joined side holds at most one row per expense, so the joins keep the grain.
    """

    def settled(field: str, ocr_field: str) -> Column:
        return F.coalesce(f"final_{field}", ocr_field, field).alias(f"final_{field}")

    ocr_side = ocr.select(
        "expense_id", "ocr_total", "ocr_vendor", "ocr_date", "ocr_currency", "ocr_extra"
    )
    joined = expenses.where(F.col("status") == "approved")
    for side in (ocr_side, hitl_rollup(hitl), trace_per_expense(events)):
        joined = joined.join(side, "expense_id", "left")
    return joined.select(
        "tenant_id", "expense_id", "user_id", "receipt_id",
        settled("amount", "ocr_total"),
        settled("vendor", "ocr_vendor"),
        settled("date", "ocr_date"),
        settled("currency", "ocr_currency"),
        "category", "source_per_field",
        F.coalesce("approved_at", "updated_at").alias("approved_at"),
        F.isnotnull("hitl_decision").alias("had_hitl"),
        "hitl_decision", "hitl_conflict_fields", "hitl_resolved_by", "hitl_resolved_at",
        "trace_id", "ocr_extra",
    )


#: As many dirty expenses at most are sent to every task, to cut the joined tables where they are read.
FEW_KEYS = 200_000


def refresh_audit(
    path: str, dirty: DataFrame, expenses: DataFrame, ocr: DataFrame, hitl: DataFrame, events: DataFrame
) -> DataFrame:
    """Replace the audit rows of the expenses in ``dirty`` (expense_id) and return the new ones, as they were written.

    The other tables may hold more than that. While the dirty expenses are few, all tables are cut to them before they are joined;
    many would have to be shuffled and sorted for that once per table, and the join with the cut expenses drops the rest anyway.
    Only the touched partitions of the table are written. An expense that is no longer approved loses its row.
    """
    keys = staged(dirty.select("expense_id").where("expense_id IS NOT NULL").distinct(), "dirty-expenses")
    if keys.count() <= FEW_KEYS:
        ocr, hitl, events = (df.join(F.broadcast(keys), "expense_id", "left_semi") for df in (ocr, hitl, events))
    fresh = expense_audit(expenses.join(keys, "expense_id", "left_semi"), ocr, hitl, events)
    return replace_keys(bucketed(fresh, "expense_id"), keys, path, "expense_id")


def audit_by_approval(expenses: DataFrame) -> DataFrame:
    """Older promotion rule: approved rows keyed by expense, the latest approval wins."""
    from cuentaclara.operators.cdc import apply_changes

    promoted = expenses.where(F.col("status") == "approved").select(
        "tenant_id", "expense_id", "user_id", "receipt_id", "final_amount", "final_vendor",
        "final_date", "final_currency", "source_per_field", "approved_at",
    )
    return apply_changes(promoted, ["expense_id"], ["approved_at"])


HISTORY_PAGE = 1000


def event_history(
    events: DataFrame, page_size: int = HISTORY_PAGE, bucket_seconds: int = skew.DAY
) -> DataFrame:
    """Timeline per (tenant, expense) as ordered arrays of at most ``page_size`` events.

    Ordinary expenses have one page (``page`` 0). An expense with an extreme number of
    events continues on further pages, so no single row or task has to hold all of it.
    """
    keys = ["tenant_id", "expense_id"]
    placed = skew.numbered(
        events, keys, "created_at", ["event_id"], alias="_n", bucket_seconds=bucket_seconds
    ).withColumn("page", F.floor((F.col("_n") - 1) / F.lit(page_size)).cast("bigint"))
    entry = F.struct("_n", "event_type", "actor", "created_at", "details")
    pages = placed.groupBy(*keys, "page").agg(
        F.array_sort(
            F.collect_list(entry), lambda a, b: F.signum(a["_n"] - b["_n"]).cast("int")
        ).alias("_entries"),
        F.max("created_at").alias("last_event_at"),
    )
    return pages.select(
        *keys, "page",
        F.transform(
            "_entries",
            lambda e: F.struct(e["event_type"].alias("event_type"), e["actor"].alias("actor"),
                               e["created_at"].alias("created_at"), e["details"].alias("details")),
        ).alias("event_history"),
        "last_event_at",
    )


def history_summary(events: DataFrame, page_size: int = HISTORY_PAGE) -> DataFrame:
    """One row per (tenant, expense): number of events, the last one, and how many pages of history there are."""
    last = F.max_by(F.struct("event_type", "created_at"), F.struct("created_at", "event_id"))
    counted = events.groupBy("tenant_id", "expense_id").agg(F.count(F.lit(1)).alias("event_count"), last.alias("_last"))
    return counted.select(
        "tenant_id", "expense_id", "event_count", F.col("_last.event_type").alias("last_event_type"),
        F.col("_last.created_at").alias("last_event_at"),
        F.ceil(F.col("event_count") / F.lit(page_size)).cast("bigint").alias("history_pages"),
    )


def audit_with_history(audit: DataFrame, events: DataFrame, page_size: int = HISTORY_PAGE) -> DataFrame:
    """The audit table with what happened to each expense. The grain stays one row per expense, whatever the number of
    events; the events themselves are the pages of ``event_history``, by (tenant_id, expense_id, page)."""
    return audit.join(history_summary(events, page_size), ["tenant_id", "expense_id"], "left")


def kpi_tenant_daily(audit: DataFrame, ocr: DataFrame) -> DataFrame:
    """Approved spend per tenant, day and category with OCR confidence and HITL counts."""
    confidence = ocr.select("expense_id", "avg_confidence")
    return (
        audit.join(confidence, "expense_id", "left")
        .groupBy("tenant_id", F.col("final_date").alias("date"), "category")
        .agg(
            F.count(F.lit(1)).alias("expense_count"),
            F.sum("final_amount").alias("total_amount"),
            F.avg("avg_confidence").alias("avg_ocr_confidence"),
            F.count("hitl_decision").alias("hitl_count"),
        )
    )


# --- chunks -------------------------------------------------------------------------------


def _items(extra: Column, part: str) -> Column:
    """``part`` of the OCR extras as an array, from either JSON shape."""
    listed = F.from_json(extra, schemas.OCR_EXTRA_ARRAYS)[part]
    mapped = F.from_json(extra, schemas.OCR_EXTRA_MAPS)[part]
    return F.coalesce(listed, F.map_values(mapped))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _item_text(item: Column) -> Column:
    at_price = F.coalesce(F.concat(F.lit("@"), item["unit_price"]), F.lit(""))
    return F.concat_ws(
        " ", _blank(item["quantity"]), _blank(item["item"]), at_price, _blank(item["price"])
    )


def _field_text(field: Column) -> Column:
    return F.concat_ws(": ", _blank(field["field"]), _blank(field["value"]))


def _section(title: str, entries: Column, render) -> Column:
    body = F.concat_ws("; ", F.transform(entries, render))
    return F.when(body != "", F.concat_ws(" ", F.lit(title), body, F.lit("."))).otherwise(F.lit(""))


def _sentence(*sections: Column) -> Column:
    # The sentence that is embedded. Empty sections stay as empty strings, which
    # leaves their separating spaces in the text; embeddings and hashes depend on it.
    return F.concat_ws(
        " ",
        F.lit("Gasto en"), F.col("final_vendor"),
        F.lit("por"), F.col("final_amount").cast("string"), F.col("final_currency"),
        F.lit("el"), F.col("final_date").cast("string"), F.lit("."),
        F.lit("Categoria:"), F.col("category"), F.lit("."),
        *sections,
    )


def _simple_sentence() -> Column:
    return F.concat_ws(
        " ",
        F.lit("Gasto en"), F.col("final_vendor"),
        F.lit("por"), F.col("final_amount").cast("string"), F.col("final_currency"),
        F.lit("el"), F.col("final_date").cast("string"),
        F.lit(". Categoria:"), F.col("category"), F.lit("."),
    )


def _chunk_columns(text: Column) -> list[Column]:
    return [
        F.concat("expense_id", F.lit("_main")).alias("chunk_id"),
        F.col("tenant_id"),
        F.col("expense_id"),
        text.alias("chunk_text"),
        F.col("final_amount").cast("double").alias("amount"),
        F.col("final_currency").alias("currency"),
        F.col("final_vendor").alias("vendor"),
        F.col("final_date").cast("string").alias("date"),
        F.col("category"),
        F.col("approved_at"),
    ]


def expense_chunks(audit: DataFrame) -> DataFrame:
    """One text chunk per audited expense, with line items and extra fields when OCR found any."""
    extra = F.col("ocr_extra")
    text = _sentence(
        _section("Items:", _items(extra, "line_items"), _item_text),
        _section("Detalles:", _items(extra, "summary_fields"), _field_text),
    )
    return audit.select(*_chunk_columns(text))


def simple_chunks(audit: DataFrame) -> DataFrame:
    """Chunks without OCR extras, used to fill the table for the first time."""
    return audit.select(*_chunk_columns(_simple_sentence()))
