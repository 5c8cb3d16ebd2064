"""Audit decisions as table jobs: compare, raise tasks, resolve, explain each value's source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.functions.similarity import similarity
from cuentaclara.functions.text import amount_value, date_value, plain_number, stripped

AMOUNT_TOLERANCE = 0.01
VENDOR_SIMILARITY_MIN = 0.85
AUDITED_FIELDS = ("amount", "vendor", "date", "currency")


def _folded(c: Column) -> Column:
    return F.lower(stripped(c))


def compare_fields(
    reported: DataFrame,
    ocr: DataFrame,
    *,
    key: str = "expense_id",
    amount_pct: float = AMOUNT_TOLERANCE,
    vendor_min: float = VENDOR_SIMILARITY_MIN,
) -> DataFrame:
    """Reported values against OCR values; ``conflicts`` is empty when they agree.

    ``reported`` has amount, vendor, date; ``ocr`` has ocr_total, ocr_vendor, ocr_date and,
    optionally, the three ``*_confidence`` columns. Values may be numbers or text.
    """
    ocr_columns = ["ocr_total", "ocr_vendor", "ocr_date"]
    conf = {c: f"{c}_confidence" for c in ocr_columns}
    ocr_side = ocr.select(
        key, *ocr_columns,
        *[(F.col(n) if n in ocr.columns else F.lit(None)).cast("double").alias(n) for n in conf.values()],
    )
    joined = reported.join(ocr_side, key).withColumns({
        "_amount": F.coalesce(amount_value(F.col("amount")), F.lit(0.0)),
        "_ocr_amount": F.coalesce(amount_value(F.col("ocr_total")), F.lit(0.0)),
        "_vendor": F.nullif(_folded(F.col("vendor")), F.lit("")),
        "_ocr_vendor": F.nullif(_folded(F.col("ocr_vendor")), F.lit("")),
        "_date": F.nullif(stripped(F.col("date").cast("string")), F.lit("")),
        "_ocr_date": F.nullif(stripped(F.col("ocr_date").cast("string")), F.lit("")),
    })
    joined = joined.withColumn("vendor_similarity", similarity(F.col("_vendor"), F.col("_ocr_vendor")))

    both = (F.col("_amount") != 0) & (F.col("_ocr_amount") != 0)
    gap = F.abs(F.col("_amount") - F.col("_ocr_amount")) / F.nullif(
        F.greatest("_amount", "_ocr_amount"), F.lit(0.0)
    )

    def shown(name: str) -> Column:
        return plain_number(F.col(name)) if name in ("_amount", "_ocr_amount") else F.col(name).cast("string")

    def conflict(field: str, hit: Column, user: str, found: str, source: str, ratio: Column) -> Column:
        return F.when(hit, F.struct(
            F.lit(field).alias("field"),
            shown(user).alias("user_value"),
            shown(found).alias("ocr_value"),
            F.col(conf[source]).alias("confidence"),
            ratio.alias("similarity"),
        ))

    no_ratio = F.lit(None).cast("double")
    found = F.array(
        conflict("amount", both & (gap > amount_pct), "_amount", "_ocr_amount", "ocr_total", no_ratio),
        conflict("vendor", F.col("vendor_similarity") < vendor_min, "_vendor", "_ocr_vendor",
                 "ocr_vendor", F.col("vendor_similarity")),
        conflict("date", F.col("_date") != F.col("_ocr_date"), "_date", "_ocr_date", "ocr_date", no_ratio),
    )
    return joined.withColumn("conflicts", F.filter(found, lambda c: c.isNotNull())).drop(
        "_amount", "_ocr_amount", "_vendor", "_ocr_vendor", "_date", "_ocr_date", *conf.values()
    )


def hitl_candidates(compared: DataFrame, created_at: Column) -> DataFrame:
    """A pending review task for every expense with a conflict."""
    return compared.where(F.size("conflicts") > 0).select(
        F.concat(F.lit("hitl_"), F.col("expense_id")).alias("task_id"),
        "tenant_id", "expense_id",
        F.col("conflicts").alias("discrepancy_fields"),
        F.lit("pending").alias("status"),
        created_at.alias("created_at"),
    )


def comparison_events(compared: DataFrame, created_at: Column) -> DataFrame:
    """One timeline event per comparison."""
    has_conflict = F.size("conflicts") > 0
    return compared.select(
        F.concat(F.lit("evt_cmp_"), F.col("expense_id")).alias("event_id"),
        "expense_id", "tenant_id",
        F.when(has_conflict, "discrepancy_detected").otherwise("no_discrepancy").alias("event_type"),
        F.to_json(F.struct(F.lit("system").alias("type"), F.lit("worker:auditor").alias("id"))).alias("actor"),
        F.when(has_conflict, F.create_map(
            F.lit("fields_in_conflict"), F.to_json("conflicts"),
            F.lit("hitl_task_id"), F.concat(F.lit("hitl_"), F.col("expense_id")),
        )).otherwise(F.create_map().cast("map<string,string>")).alias("details"),
        created_at.alias("created_at"),
    )


def final_from_ocr() -> dict[str, Column]:
    """OCR values in their final types."""
    return {
        "amount": amount_value(F.col("ocr_total")),
        "vendor": F.col("ocr_vendor"),
        "date": date_value(F.col("ocr_date").cast("string")).cast("string"),
    }


def resolve(tasks: DataFrame) -> DataFrame:
    """Final values of reviewed expenses.

    Start from what was reported; ``accept_ocr`` (also the default) overwrites amount, vendor
    and date with OCR even where OCR has nothing; ``resolved_fields`` override both.
    Expects reported columns, OCR columns, ``decision`` and ``resolved_fields`` on each row.
    """
    accept = F.coalesce("decision", F.lit("accept_ocr")) == "accept_ocr"
    from_ocr = final_from_ocr()
    out = {}
    for field in AUDITED_FIELDS:
        base = F.col(field).cast("double" if field == "amount" else "string")
        if field in from_ocr:
            base = F.when(accept, from_ocr[field]).otherwise(base)
        given = F.try_element_at("resolved_fields", F.lit(field))
        if field == "amount":
            given = amount_value(given)
        overridden = F.coalesce(F.map_contains_key("resolved_fields", field), F.lit(False))
        out[f"final_{field}"] = F.when(overridden, given).otherwise(base)
    return tasks.withColumns(out)


def source_per_field(tasks: DataFrame) -> DataFrame:
    """Where each final value came from. Expects ``conflict_fields`` (array of names)."""
    accept = F.coalesce("decision", F.lit("accept_ocr")) == "accept_ocr"
    sources = []
    for field in AUDITED_FIELDS:
        overridden = F.coalesce(F.map_contains_key("resolved_fields", field), F.lit(False))
        disputed = F.coalesce(F.array_contains("conflict_fields", field), F.lit(False))
        sources.append(
            F.when(overridden, F.lit("hitl_custom"))
            .when(disputed & accept, F.lit("ocr"))
            .when(disputed | F.col(field).isNotNull(), F.lit("user"))
            .otherwise(F.lit("ocr"))
        )
    names = F.array(*[F.lit(f) for f in AUDITED_FIELDS])
    return tasks.withColumn("source_per_field", F.map_from_arrays(names, F.array(*sources)))


def finalize_without_conflict(compared: DataFrame) -> DataFrame:
    """Undisputed expenses keep what was reported; when nothing was, OCR fills in."""
    reported = F.col("amount").isNotNull() | F.col("vendor").isNotNull() | F.col("date").isNotNull()
    from_ocr = final_from_ocr()
    quiet = compared.where(F.size("conflicts") == 0)
    out = {}
    for field in AUDITED_FIELDS:
        base = F.col(field).cast("double" if field == "amount" else "string")
        fallback = from_ocr.get(field, F.lit(None).cast("string"))
        out[f"final_{field}"] = F.when(reported, base).otherwise(fallback)
    present = F.when(reported, F.array(*[F.lit(f) for f in AUDITED_FIELDS])).otherwise(
        F.array(*[F.lit(f) for f in from_ocr])
    )
    sources = F.map_from_arrays(
        present, F.transform(present, lambda _: F.lit("ocr_high_confidence"))
    )
    return quiet.withColumns(out).withColumn("source_per_field", sources)


def touched_by_review(sources: Column) -> Column:
    """True when any value does not come straight from the user."""
    return F.coalesce(F.exists(F.map_values(sources), lambda s: s != "user"), F.lit(False))


def changed_fields(expenses: DataFrame) -> DataFrame:
    """(expense, field, reported, final, source) for every field not taken from the user."""
    def text(name: str) -> Column:
        return F.col(name).cast("string")

    entries = F.array(*[
        F.struct(
            F.lit(f).alias("field"), text(f).alias("reported_value"),
            text(f"final_{f}").alias("final_value"),
            F.try_element_at("source_per_field", F.lit(f)).alias("source"),
        )
        for f in AUDITED_FIELDS
    ])
    changed = F.filter(entries, lambda e: F.coalesce(e["source"], F.lit("user")) != "user")
    return expenses.select("expense_id", "tenant_id", F.explode(changed).alias("e")).select(
        "expense_id", "tenant_id", "e.*"
    )


HITL_TIMEOUT_DAYS = 7


def expire_tasks(tasks: DataFrame, as_of: Column, days: int = HITL_TIMEOUT_DAYS) -> DataFrame:
    """Pending tasks nobody answered in time, with the rejection they cause."""
    limit = as_of - F.make_interval(days=F.lit(days))
    return tasks.where((F.col("status") == "pending") & (F.col("created_at") < limit)).select(
        "task_id", "tenant_id", "expense_id", "created_at",
        F.lit("rejected").alias("expense_status"),
        F.lit("HITL_TIMEOUT").alias("rejection_reason"),
    )
