"""Every operator as a query over whole tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuentaclara import schemas
from cuentaclara.functions import text
from cuentaclara.functions.embedders import CountingEmbedder
from cuentaclara.operators import (
    audit, bronze, cdc, gold, grounding, ivf, logs, ocr, postings, quality, repair, retrieval, search, security, silver,
    sketches,
)
from cuentaclara.operators import operations as ops
from cuentaclara.plans import oracle
from cuentaclara.plans.domain import Domain, events_now, orders_now
from cuentaclara.sources import tables
from cuentaclara.sources.tables import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Only strings, bigints, doubles, booleans and zone-free timestamps leave a query."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.when(c.isNotNull(), F.concat_ws(",", c))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(build(Domain(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = oracle.complete(sql)
        return build
    return register


# --- bronze -------------------------------------------------------------------------------


def bronze_expense_rows(d: Domain) -> DataFrame:
    return bronze.bronze_rows(d.expense_messages, schemas.EXPENSES, events_now())


@query("bronze_expenses", """
    SELECT expense_id, tenant_id, user_id, workflow_id, CAST(amount AS DOUBLE) AS amount, currency, date, vendor, category, status,
           CAST(final_amount AS DOUBLE) AS final_amount, amount_source, approved_at, created_at, updated_at,
           op, source_ts_ms, deleted, off AS kafka_offset
    FROM bronze_expenses""")
def _(d):
    return bronze_expense_rows(d).select(
        "expense_id", "tenant_id", "user_id", "workflow_id", "amount", "currency", "date", "vendor", "category", "status",
        "final_amount", F.col("source_per_field")["amount"].alias("amount_source"), "approved_at", "created_at", "updated_at",
        F.col("__op").alias("op"), F.col("__source_ts_ms").alias("source_ts_ms"), F.col("__deleted").alias("deleted"),
        F.col("_kafka_offset").alias("kafka_offset"),
    )


@query("bronze_receipts", """
    SELECT receipt_id, tenant_id, user_id, expense_id, s3_key, content_type, size_bytes, uploaded_at, 'c' AS op,
           epoch_ms(uploaded_at) AS source_ts_ms FROM receipts""")
def _(d):
    return bronze.bronze_rows(d.receipt_messages, schemas.RECEIPTS).select(
        "receipt_id", "tenant_id", "user_id", "expense_id", "s3_key", "content_type", "size_bytes", "uploaded_at",
        F.col("__op").alias("op"), F.col("__source_ts_ms").alias("source_ts_ms"),
    )


@query("bronze_hitl_tasks", """
    SELECT task_id, tenant_id, expense_id, workflow_id, status, array_to_string(discrepancy_fields, ',') AS discrepancy_fields, decision,
           resolved_amount, resolved_by, resolved_at, created_at, op, source_ts_ms FROM hitl_changes""")
def _(d):
    return bronze.bronze_rows(d.hitl_messages, schemas.HITL_TASKS).select(
        "task_id", "tenant_id", "expense_id", "workflow_id", "status", "discrepancy_fields", "decision",
        F.try_element_at("resolved_fields", F.lit("amount")).alias("resolved_amount"), "resolved_by", "resolved_at",
        "created_at", F.col("__op").alias("op"), F.col("__source_ts_ms").alias("source_ts_ms"),
    )


@query("bronze_ocr_extractions", """
    SELECT expense_id, tenant_id, CAST(ocr_total AS DOUBLE) AS ocr_total, ocr_total_confidence, ocr_vendor, CAST(ocr_date AS VARCHAR) AS ocr_date,
           ocr_currency, avg_confidence, textract_raw_s3_key, extracted_at FROM ocr""")
def _(d):
    return bronze.bronze_rows(d.ocr_messages, schemas.OCR_EXTRACTIONS).select(
        "expense_id", "tenant_id", "ocr_total", "ocr_total_confidence", "ocr_vendor", "ocr_date", "ocr_currency",
        "avg_confidence", "textract_raw_s3_key", "extracted_at",
    )


@query("bronze_expense_events", """
    SELECT event_id, expense_id, tenant_id, event_type, actor_type, actor_id, hitl_task_id, workflow_id, trace_id, created_at FROM timeline""")
def _(d):
    rows = bronze.bronze_rows(d.event_messages, schemas.EXPENSE_EVENTS)
    return silver.clean_events(rows).select(
        "event_id", "expense_id", "tenant_id", "event_type", "actor_type", "actor_id",
        F.try_element_at("details", F.lit("hitl_task_id")).alias("hitl_task_id"), "workflow_id", "trace_id", "created_at",
    )


@query("dead_letters", """
    SELECT 'cdc.expenses' AS topic_original, CAST(user_id % 6 AS BIGINT) AS partition, event_id AS off,
           'malformed JSON' AS error_message FROM ev WHERE k = 7""")
def _(d):
    return bronze.dead_letters(d.expense_messages, schemas.EXPENSES, events_now()).select(
        "topic_original", "partition", F.col("offset").alias("off"), "error_message"
    )


@query("seed_expenses", """
    SELECT expense_id, tenant_id, CAST(amount AS DOUBLE) AS amount, currency, CAST(date AS VARCHAR) AS date, status, created_at, updated_at,
           'c' AS op, epoch_ms(updated_at) AS source_ts_ms, false AS deleted FROM expenses""")
def _(d):
    docs = d.expenses.drop("o_orderkey", "o_orderpriority", "rejection_reason")
    return bronze.snapshot_rows(docs, schemas.EXPENSES, orders_now()).select(
        "expense_id", "tenant_id", "amount", "currency", "date", "status", "created_at", "updated_at",
        F.col("__op").alias("op"), F.col("__source_ts_ms").alias("source_ts_ms"), F.col("__deleted").alias("deleted"),
    )


# --- quality ------------------------------------------------------------------------------


@query("expectations_warn", """
    SELECT expense_id, coalesce(amount IS NULL OR (amount > 0 AND amount < 1e9), false) AS ok_valid_amount,
           tenant_id IS NOT NULL AS ok_valid_tenant FROM expenses""")
def _(d):
    return quality.flag(d.expenses, quality.EXPENSE_WARN).select("expense_id", "ok_valid_amount", "ok_valid_tenant")


@query("expectations_drop", """
    SELECT expense_id, status FROM expenses
    WHERE status IN ('pending','processing','hitl_required','approved','rejected','cancelled','failed')""")
def _(d):
    return quality.drop_invalid(d.expenses, quality.EXPENSE_DROP).select("expense_id", "status")


@query("expectations_fail", "SELECT count(*) AS n FROM expenses")
def _(d):
    return quality.fail_invalid(d.expenses, quality.EXPENSE_FAIL).agg(ops.rows().alias("n"))


@query("expectation_report", """
    SELECT 'expenses' AS table_name, 'valid_status' AS expectation,
           CAST(sum(CASE WHEN status IN ('pending','processing','hitl_required','approved','rejected','cancelled','failed') THEN 0 ELSE 1 END) AS BIGINT) AS failed,
           count(*) AS total FROM expenses
    UNION ALL SELECT 'expenses', 'valid_currency', CAST(sum(CASE WHEN regexp_matches(currency, '^[A-Z]{3}$') THEN 0 ELSE 1 END) AS BIGINT), count(*) FROM expenses
    UNION ALL SELECT 'expenses', 'tenant_prefix', CAST(sum(CASE WHEN tenant_id LIKE 't\\_%' ESCAPE '\\' THEN 0 ELSE 1 END) AS BIGINT), count(*) FROM expenses
    UNION ALL SELECT 'ocr', 'valid_confidence', CAST(sum(CASE WHEN avg_confidence BETWEEN 0 AND 100 THEN 0 ELSE 1 END) AS BIGINT), count(*) FROM ocr
    UNION ALL SELECT 'ocr', 'has_signal', CAST(sum(CASE WHEN ocr_total IS NOT NULL OR ocr_vendor IS NOT NULL THEN 0 ELSE 1 END) AS BIGINT), count(*) FROM ocr""")
def _(d):
    expenses = quality.violation_report(d.expenses, "expenses", {**quality.EXPENSE_DROP, **quality.EXPENSE_STRICT})
    return expenses.unionByName(quality.violation_report(d.ocr, "ocr", quality.OCR_WARN))


@query("new_expense_validity", """
    SELECT expense_id, amount > 0 AS ok_positive_amount, length(currency) = 3 AS ok_currency_length,
           length(vendor) BETWEEN 1 AND 200 AS ok_vendor_length, length(category) BETWEEN 1 AND 80 AS ok_category_length FROM expenses""")
def _(d):
    return quality.flag(d.expenses, quality.NEW_EXPENSE).select("expense_id", *[f"ok_{r}" for r in quality.NEW_EXPENSE])


@query("tenant_rows", "SELECT expense_id, tenant_id FROM expenses WHERE tenant_id = 't_2'")
def _(d):
    return security.visible(d.expenses, security.Caller("t_2")).select("expense_id", "tenant_id")


@query("masked_emails", r"""
    SELECT user_id, n, regexp_replace(email, '(.{2}).*@', '\1****@') AS email
    FROM (SELECT user_id, count(*) AS n, user_id || '.name@mail.test' AS email FROM expenses GROUP BY user_id) t""")
def _(d):
    users = d.expenses.groupBy("user_id").agg(ops.rows().alias("n")).withColumn(
        "email", F.concat("user_id", F.lit(".name@mail.test")))
    return security.masked(users, security.Caller("t_0"), "email")


@query("point_lookup", """
    SELECT expense_id, tenant_id, status, CAST(date AS VARCHAR) AS date FROM expenses WHERE expense_id = 'exp_00000007' AND tenant_id = 't_2'""")
def _(d):
    return search.point_lookup(d.expenses.select("expense_id", "tenant_id", "status", "date"), "exp_00000007", "t_2")


# --- change application -------------------------------------------------------------------


@query("scd1_expenses", """
    SELECT expense_id, tenant_id, status, CAST(amount AS DOUBLE) AS amount, vendor, updated_at FROM cdc_state""")
def _(d):
    state = cdc.silver_state(silver.clean_expenses(bronze_expense_rows(d)), "expense_id")
    return state.select("expense_id", "tenant_id", "status", "amount", "vendor", "updated_at")


@query("scd1_hitl", """
    SELECT task_id, expense_id, status, decision, array_to_string(discrepancy_fields, ',') AS discrepancy_fields, resolved_at FROM hitl""")
def _(d):
    return d.hitl.select("task_id", "expense_id", "status", "decision", "discrepancy_fields", "resolved_at")


@query("scd1_events", "SELECT event_id, expense_id, event_type, trace_id, created_at FROM timeline")
def _(d):
    rows = bronze.bronze_rows(d.event_messages, schemas.EXPENSE_EVENTS)
    twice = rows.unionByName(rows)  # the same message delivered again
    state = cdc.silver_state(silver.clean_events(twice), "event_id", deletes=False)
    return state.select("event_id", "expense_id", "event_type", "trace_id", "created_at")


@query("scd1_ocr", """
    SELECT expense_id, CAST(ocr_total AS DOUBLE) AS ocr_total, ocr_vendor, CAST(ocr_date AS VARCHAR) AS ocr_date, avg_confidence FROM ocr""")
def _(d):
    rows = silver.clean_ocr(bronze.bronze_rows(d.ocr_messages, schemas.OCR_EXTRACTIONS))
    return cdc.silver_state(rows, "expense_id").select("expense_id", "ocr_total", "ocr_vendor", "ocr_date", "avg_confidence")


@query("scd1_receipts", "SELECT receipt_id, tenant_id, expense_id, content_type, uploaded_at FROM receipts")
def _(d):
    rows = silver.clean_receipts(bronze.bronze_rows(d.receipt_messages, schemas.RECEIPTS))
    return cdc.silver_state(rows, "receipt_id").select("receipt_id", "tenant_id", "expense_id", "content_type", "uploaded_at")


@query("scd2_expenses", """
    SELECT expense_id, status, off, source_ts_ms, start_at, end_at FROM (
        SELECT expense_id, status, op, off, source_ts_ms, created_at AS start_at,
               lead(created_at) OVER (PARTITION BY expense_id ORDER BY created_at, off) AS end_at FROM bronze_expenses) t
    WHERE op <> 'd'""")
def _(d):
    rows = silver.clean_expenses(bronze_expense_rows(d))
    versions = cdc.history(rows, ["expense_id"], "created_at", ["_tiebreak"], apply_as_deletes=cdc.DELETE)
    return versions.select("expense_id", "status", F.col("_tiebreak").alias("off"), F.col("_source_ts_ms").alias("source_ts_ms"),
                           F.col("__start_at").alias("start_at"), F.col("__end_at").alias("end_at"))


@query("silver_rebuild_equivalence", "SELECT count(*) AS live_keys, true AS same FROM cdc_state")
def _(d):
    # Fold the first half of the log, then the rest on top of it: same state as one fold.
    rows = silver.clean_expenses(bronze_expense_rows(d))
    order = ["_source_ts_ms", "_tiebreak"]
    early, late = F.col("_tiebreak") % 2 == 0, F.col("_tiebreak") % 2 == 1
    staged = cdc.fold_latest(
        cdc.fold_latest(rows.where(late), ["expense_id"], order).unionByName(rows.where(early)), ["expense_id"], order)
    whole = cdc.fold_latest(rows, ["expense_id"], order)
    pair = [staged.where("_op <> 'd'").select("expense_id", F.col("_tiebreak").alias("a")),
            whole.where("_op <> 'd'").select("expense_id", F.col("_tiebreak").alias("b"))]
    return pair[0].join(pair[1], "expense_id", "full").agg(
        ops.rows().alias("live_keys"), F.min(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


@query("audit_by_approval", """
    SELECT expense_id, tenant_id, CAST(final_amount AS DOUBLE) AS final_amount, approved_at FROM expenses WHERE status = 'approved'""")
def _(d):
    return gold.audit_by_approval(d.expenses).select("expense_id", "tenant_id", "final_amount", "approved_at")


@query("change_feed", """
    SELECT source_ts_ms, op, expense_id, status FROM bronze_expenses ORDER BY source_ts_ms DESC, off DESC LIMIT 20""")
def _(d):
    return cdc.change_feed(bronze_expense_rows(d), 20).select(
        F.col("__source_ts_ms").alias("source_ts_ms"), F.col("__op").alias("op"), "expense_id", "status")


@query("chat_turns_current", "SELECT session_id, turn, user_message, assistant_message FROM chat_turns")
def _(d):
    latest = cdc.fold_latest(d.chat_log, ["session_id", "turn"], ["version"])
    return latest.select("session_id", "turn", "user_message", "assistant_message")


@query("changed_key_refresh", """
    SELECT tenant_id, expense_id, user_id, CAST(final_amount AS DOUBLE) AS final_amount, final_vendor, CAST(final_date AS VARCHAR) AS final_date, final_currency,
           category, approved_at, had_hitl, hitl_decision, trace_id FROM audit""")
def _(d):
    # An audit table of an earlier state: other amounts, other tenants, expenses that are no more, others that are not yet.
    hours = F.pmod(F.xxhash64("expense_id"), F.lit(6))
    earlier = d.expenses.where(hours != 0).withColumns({
        "final_amount": F.when(hours == 1, F.lit(1).cast("decimal(18,2)")).otherwise(F.col("final_amount")),
        "tenant_id": F.when(hours == 2, F.lit("t_before")).otherwise(F.col("tenant_id")),
        "status": F.when(hours == 3, F.lit("approved")).otherwise(F.col("status"))})
    ghosts = d.expenses.where(hours == 4).withColumns({"expense_id": F.concat(F.lit("gone_"), "expense_id"), "status": F.lit("approved")})
    path = scratch_dir(d.spark, "audit")
    # Silver is a table: the change log of the tasks is folded once, for the table and for its refresh.
    hitl = tables.staged(d.hitl.select("expense_id", "status", "decision", "resolved_by", "resolved_at", "discrepancy_fields"), "silver-hitl")
    tables.overwrite_partitioned(tables.bucketed(
        gold.expense_audit(earlier.unionByName(ghosts), d.ocr, hitl, d.timeline), "expense_id"), path, ("tenant_id", "bucket"))
    dirty = d.expenses.where(hours <= 4).select(F.when(hours == 4, F.concat(F.lit("gone_"), "expense_id")).otherwise(F.col("expense_id")).alias("expense_id"))
    gold.refresh_audit(path, dirty, d.expenses, d.ocr, hitl, d.timeline)
    return tables.read_table(d.spark, path).select(
        F.col("tenant_id").cast("string").alias("tenant_id"), "expense_id", "user_id", "final_amount", "final_vendor", "final_date", "final_currency", "category",
        "approved_at", "had_hitl", "hitl_decision", "trace_id")


# --- gold ---------------------------------------------------------------------------------


def audit_table(d: Domain) -> DataFrame:
    return gold.expense_audit(d.expenses, d.ocr, d.hitl, d.timeline)


def chunk_table(d: Domain) -> DataFrame:
    return gold.expense_chunks(audit_table(d))


@query("hitl_rollup", """
    SELECT expense_id, hitl_resolved_at, hitl_decision, hitl_resolved_by, array_to_string(hitl_conflict_fields, ',') AS hitl_conflict_fields FROM hitl_agg""")
def _(d):
    return gold.hitl_rollup(d.hitl)


@query("hitl_latest", """
    SELECT expense_id, resolved_at AS hitl_resolved_at, decision AS hitl_decision, resolved_by AS hitl_resolved_by,
           array_to_string(discrepancy_fields, ',') AS hitl_conflict_fields
    FROM (SELECT *, row_number() OVER (PARTITION BY expense_id ORDER BY resolved_at DESC, task_id DESC) AS r
          FROM hitl WHERE status = 'resolved') t WHERE r = 1""")
def _(d):
    return gold.hitl_latest(d.hitl)


@query("trace_per_expense", "SELECT expense_id, trace_id FROM trace1")
def _(d):
    return gold.trace_per_expense(d.timeline)


@query("expense_audit", """
    SELECT tenant_id, expense_id, user_id, receipt_id, CAST(final_amount AS DOUBLE) AS final_amount, final_vendor, CAST(final_date AS VARCHAR) AS final_date,
           final_currency, category, approved_at, had_hitl, hitl_decision, array_to_string(hitl_conflict_fields, ',') AS hitl_conflict_fields,
           hitl_resolved_by, hitl_resolved_at, trace_id FROM audit""")
def _(d):
    return audit_table(d).drop("source_per_field", "ocr_extra")


@query("event_history", """
    SELECT tenant_id, expense_id, (rn - 1) // 3 AS page, string_agg(event_type, ',' ORDER BY rn) AS event_types,
           max(created_at) AS last_event_at, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, expense_id ORDER BY created_at, event_id) AS rn FROM timeline) t
    GROUP BY tenant_id, expense_id, (rn - 1) // 3""")
def _(d):
    pages = gold.event_history(d.timeline, page_size=3)
    kinds = F.transform("event_history", lambda e: e["event_type"])
    return pages.select("tenant_id", "expense_id", "page", kinds.alias("event_types"), "last_event_at",
                        F.size("event_history").cast("bigint").alias("n"))


@query("expense_audit_with_history", """
    SELECT a.tenant_id, a.expense_id, CAST(a.final_amount AS DOUBLE) AS final_amount, h.n AS event_count, h.last_event_type, h.last_event_at,
           (h.n + 999) // 1000 AS history_pages
    FROM audit a LEFT JOIN (SELECT tenant_id, expense_id, count(*) AS n, arg_max(event_type, (created_at, event_id)) AS last_event_type,
                                   max(created_at) AS last_event_at FROM timeline GROUP BY tenant_id, expense_id) h
    USING (tenant_id, expense_id)""")
def _(d):
    return gold.audit_with_history(audit_table(d), d.timeline).select(
        "tenant_id", "expense_id", "final_amount", "event_count", "last_event_type", "last_event_at", "history_pages")


@query("kpi_tenant_daily", """
    SELECT tenant_id, CAST(final_date AS VARCHAR) AS date, category, count(*) AS expense_count, CAST(sum(final_amount) AS DOUBLE) AS total_amount,
           round(avg(avg_confidence), 6) AS avg_ocr_confidence, count(hitl_decision) AS hitl_count
    FROM audit GROUP BY tenant_id, final_date, category""")
def _(d):
    return gold.kpi_tenant_daily(audit_table(d), d.ocr).withColumn("avg_ocr_confidence", F.round("avg_ocr_confidence", 6))


_CHUNK_SQL = """
    WITH parts AS (
      SELECT a.*, o_orderkey AS n, CASE WHEN has_ocr AND o_orderkey % 12 NOT IN (5, 7) THEN o_orderkey % 4 ELSE 0 END AS m,
             has_ocr AND o_orderkey % 12 NOT IN (5, 7) AS ok FROM audit a),
    sections AS (
      SELECT *, CASE WHEN m > 0 THEN 'Items: ' || array_to_string(list_transform(range(1, m + 1), lambda i:
               i || 'x item ' || (n % 100) || '-' || i || ' ' || CASE WHEN i % 2 = 1 THEN '@' || (n % 90 + i) ELSE '' END || ' ' || ((n % 90 + i) * i)), '; ') || ' .' ELSE '' END AS items,
             CASE WHEN ok THEN 'Detalles: tax: ' || (n % 1000) || ' .' ELSE '' END AS details FROM parts)
    SELECT expense_id || '_main' AS chunk_id, tenant_id, expense_id,
           'Gasto en ' || final_vendor || ' por ' || CAST(final_amount AS VARCHAR) || ' ' || final_currency || ' el ' || CAST(final_date AS VARCHAR)
           || ' . Categoria: ' || category || ' . ' || items || ' ' || details AS chunk_text,
           CAST(final_amount AS DOUBLE) AS amount, final_currency AS currency, final_vendor AS vendor, CAST(final_date AS VARCHAR) AS date, category, approved_at
    FROM sections"""


@query("expense_chunks")
def _(d):
    return chunk_table(d)


ORACLES["expense_chunks"] = oracle.complete(_CHUNK_SQL)


@query("simple_chunks", """
    SELECT expense_id || '_main' AS chunk_id, tenant_id, 'Gasto en ' || final_vendor || ' por ' || CAST(final_amount AS VARCHAR) || ' ' || final_currency
           || ' el ' || CAST(final_date AS VARCHAR) || ' . Categoria: ' || category || ' .' AS chunk_text FROM audit""")
def _(d):
    return gold.simple_chunks(audit_table(d)).select("chunk_id", "tenant_id", "chunk_text")


@query("hitl_discrepancies", """
    SELECT task_id, tenant_id, expense_id, unnest(discrepancy_fields) AS field_name, status, decision FROM hitl""")
def _(d):
    return silver.hitl_discrepancies(d.hitl).select("task_id", "tenant_id", "expense_id", "field_name", "status", "decision")


# --- operations ---------------------------------------------------------------------------


@query("approval_ratio", """
    SELECT round(100e0 * sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS approval_pct
    FROM expenses WHERE created_at >= :orders_now - INTERVAL 7 DAY""")
def _(d):
    return ops.approval_ratio(d.expenses, orders_now())


@query("hitl_pending", "SELECT count(*) AS pending FROM hitl WHERE status = 'pending'")
def _(d):
    return ops.hitl_pending(d.hitl)


@query("ocr_low_conf_count", "SELECT count(*) AS low_conf FROM ocr WHERE avg_confidence < 80 AND extracted_at >= :orders_now - INTERVAL 7 DAY")
def _(d):
    return ops.ocr_low_confidence_count(d.ocr, orders_now())


@query("stuck_count", "SELECT count(*) AS stuck FROM expenses WHERE status = 'processing' AND updated_at < :orders_now - INTERVAL 10 MINUTE")
def _(d):
    return ops.stuck_count(d.expenses, orders_now())


@query("stuck_expenses", """
    SELECT expense_id, tenant_id, workflow_id, updated_at, round((epoch_us(:orders_now) - epoch_us(updated_at)) / 1e6 / 60, 4) AS stuck_minutes
    FROM expenses WHERE status = 'processing' AND updated_at < :orders_now - INTERVAL 10 MINUTE""")
def _(d):
    return ops.stuck_expenses(d.expenses, orders_now())


@query("expenses_by_day_status", """
    SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, status, count(*) AS n FROM expenses
    WHERE created_at >= :orders_now - INTERVAL 14 DAY GROUP BY ALL""")
def _(d):
    return ops.expenses_by_day_status(d.expenses, orders_now())


@query("disputed_fields", """
    SELECT field, count(*) AS n FROM (SELECT unnest(discrepancy_fields) AS field, created_at FROM hitl) t
    WHERE created_at >= :orders_now - INTERVAL 30 DAY GROUP BY field""")
def _(d):
    return ops.disputed_fields(d.hitl, orders_now())


@query("run_failures", """
    SELECT count(*) AS failed FROM runs JOIN jobs USING (pipeline_id) WHERE name LIKE 'audit-%' AND result_state = 'FAILED'
    AND period_start_time >= :events_now - INTERVAL 24 HOUR""")
def _(d):
    return ops.run_failures(d.runs, d.jobs, events_now(), "audit-%")


@query("run_success_rate", """
    SELECT round(100e0 * sum(CASE WHEN result_state = 'COMPLETED' THEN 1 ELSE 0 END) / nullif(count(*), 0), 1) AS pct
    FROM runs JOIN jobs USING (pipeline_id) WHERE name LIKE 'audit-%' AND period_start_time >= :events_now - INTERVAL 7 DAY""")
def _(d):
    return ops.run_success_rate(d.runs, d.jobs, events_now(), "audit-%")


@query("runs_hourly", """
    SELECT CAST(date_trunc('hour', period_start_time) AS TIMESTAMP) AS hour,
           CASE WHEN name LIKE '%bronze%' THEN 'bronze' WHEN name LIKE '%silver%' THEN 'silver' WHEN name LIKE '%gold%' THEN 'gold' ELSE 'other' END AS layer,
           result_state, count(*) AS n
    FROM runs JOIN jobs USING (pipeline_id) WHERE name LIKE 'audit-%' AND period_start_time >= :events_now - INTERVAL 24 HOUR GROUP BY ALL""")
def _(d):
    return ops.runs_hourly(d.runs, d.jobs, events_now(), "audit-%")


@query("last_runs", """
    SELECT name AS pipeline, update_id, result_state, period_start_time, period_end_time,
           CAST(floor(epoch_us(period_end_time) / 1e6) - floor(epoch_us(period_start_time) / 1e6) AS BIGINT) AS duration_sec
    FROM runs JOIN jobs USING (pipeline_id) WHERE name LIKE 'audit-%' ORDER BY period_start_time DESC, update_id LIMIT 30""")
def _(d):
    return ops.last_runs(d.runs, d.jobs, "audit-%")


@query("run_errors", """
    SELECT pipeline, timestamp, event_type, left(regexp_replace(message, '[\\n\\r\\t]+', ' ', 'g'), 250) AS message FROM (
      SELECT 'backend' AS pipeline, timestamp, event AS event_type, msg AS message FROM logs WHERE level = 'error' AND service = 'backend'
      UNION ALL SELECT 'worker', timestamp, event, msg FROM logs WHERE level = 'error' AND service = 'worker') t
    ORDER BY timestamp DESC, pipeline, event_type, message LIMIT 15""")
def _(d):
    shaped = d.logs.select("service", "timestamp", F.col("event").alias("event_type"), F.upper("level").alias("level"), F.col("msg").alias("message"))
    return ops.run_errors({s: shaped.where(F.col("service") == s) for s in ("backend", "worker")})


@query("expenses_by_status", "SELECT status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM expenses WHERE tenant_id = 't_1' GROUP BY status")
def _(d):
    return ops.expenses_by_status(d.expenses, "t_1")


@query("expenses_per_hour", "SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour, count(*) AS n FROM expenses GROUP BY 1")
def _(d):
    return ops.expenses_per_hour(d.expenses)


@query("amount_by_day_outcome", """
    SELECT CAST(date_trunc('day', updated_at) AS TIMESTAMP) AS day, status, CAST(sum(amount) AS DOUBLE) AS total FROM expenses
    WHERE status IN ('approved', 'rejected') GROUP BY ALL""")
def _(d):
    return ops.amount_by_day_outcome(d.expenses)


@query("hitl_resolution_percentiles", """
    SELECT tenant_id, day, round(quantile_cont(m, 0.5), 6) AS p50, round(quantile_cont(m, 0.95), 6) AS p95, count(*) AS n FROM (
      SELECT tenant_id, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, (epoch_us(resolved_at) - epoch_us(created_at)) / 1e6 / 60 AS m
      FROM hitl WHERE status = 'resolved') t GROUP BY ALL""")
def _(d):
    out = ops.hitl_resolution_percentiles(d.hitl, exact=True)
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("hitl_resolution_by_tenant", """
    SELECT tenant_id, count(*) AS n, round(avg(s), 6) AS avg_sec, round(quantile_cont(s, 0.95), 6) AS p95_sec FROM (
      SELECT tenant_id, (epoch_us(resolved_at) - epoch_us(created_at)) / 1e6 AS s FROM hitl
      WHERE status = 'resolved' AND created_at >= :orders_now - INTERVAL 400 DAY) t GROUP BY tenant_id""")
def _(d):
    out = ops.hitl_resolution_by_tenant(d.hitl, orders_now(), 400, exact=True)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_sec", "p95_sec")})


@query("hitl_resolution_approx")
def _(d):
    return ops.hitl_resolution_percentiles(d.hitl)


@query("hitl_resolution_sketches", """
    SELECT tenant_id, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, count(*) AS n, true AS p50_within, true AS p95_within
    FROM hitl WHERE status = 'resolved' AND resolved_at IS NOT NULL GROUP BY ALL""")
def _(d):
    found = ops.hitl_resolution_rank_errors(d.hitl)
    within = [(F.col(f"{p}_error") <= sketches.RANK_BOUND).alias(f"{p}_within") for p in ("p50", "p95")]
    return found.select("tenant_id", "day", "n", *within)


@query("chat_turns_per_day", "SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS day, count(*) AS turns FROM chat_turns GROUP BY 1")
def _(d):
    return ops.chat_turns_per_day(d.chat_turns)


@query("top_vendors", """
    SELECT vendor, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM expenses WHERE created_at >= :orders_now - INTERVAL 30 DAY
    GROUP BY vendor ORDER BY sum(amount) DESC, vendor LIMIT 10""")
def _(d):
    return ops.top_vendors(d.expenses, orders_now())


@query("events_by_type_actor", "SELECT event_type, actor_type, count(*) AS n FROM timeline GROUP BY ALL")
def _(d):
    return ops.events_by_type_actor(d.timeline)


@query("top_questions", """
    SELECT user_message, count(*) AS n FROM chat_turns WHERE created_at >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 24 HOUR
    GROUP BY user_message ORDER BY n DESC, user_message LIMIT 10""")
def _(d):
    return ops.top_questions(d.chat_turns, F.lit("2024-01-03").cast("timestamp"))


@query("hitl_by_decision", "SELECT status, decision, count(*) AS n FROM hitl WHERE tenant_id = 't_3' GROUP BY ALL")
def _(d):
    return ops.hitl_by_decision(d.hitl, "t_3")


@query("approved_daily", """
    SELECT tenant_id, count(*) AS approved_count, CAST(sum(final_amount) AS DOUBLE) AS total_approved_amount FROM audit
    WHERE approved_at >= :orders_now - INTERVAL 30 DAY GROUP BY tenant_id""")
def _(d):
    return ops.approved_daily(audit_table(d), orders_now(), 30)


@query("status_by_tenant", """
    SELECT tenant_id, status, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS sum_amount FROM expenses
    WHERE created_at >= :orders_now - INTERVAL 30 DAY GROUP BY ALL""")
def _(d):
    return ops.status_by_tenant(d.expenses, orders_now(), 30)


@query("rows_by_tenant_op", "SELECT tenant_id, op, count(*) AS n FROM bronze_expenses GROUP BY ALL")
def _(d):
    return ops.rows_by_tenant_op(bronze_expense_rows(d))


@query("rows_by_tenant_layer", """
    SELECT 'silver' AS layer, tenant_id, count(*) AS n FROM expenses GROUP BY ALL
    UNION ALL SELECT 'gold', tenant_id, count(*) FROM audit GROUP BY ALL""")
def _(d):
    return ops.rows_by_tenant_layer({"silver": d.expenses, "gold": audit_table(d)})


@query("tenant_null_audit", """
    SELECT 'expenses' AS table_name, CAST(sum(CASE WHEN tenant_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_tenant, count(*) AS total FROM expenses
    UNION ALL SELECT 'ocr', CAST(sum(CASE WHEN tenant_id IS NULL THEN 1 ELSE 0 END) AS BIGINT), count(*) FROM ocr
    UNION ALL SELECT 'hitl', CAST(sum(CASE WHEN tenant_id IS NULL THEN 1 ELSE 0 END) AS BIGINT), count(*) FROM hitl""")
def _(d):
    return ops.tenant_null_audit({"expenses": d.expenses, "ocr": d.ocr, "hitl": d.hitl})


@query("column_completeness", """
    SELECT 'receipt_id' AS column_name, count(receipt_id) AS filled, count(*) AS total FROM expenses
    UNION ALL SELECT 'final_amount', count(final_amount), count(*) FROM expenses
    UNION ALL SELECT 'approved_at', count(approved_at), count(*) FROM expenses""")
def _(d):
    return ops.completeness(d.expenses, ["receipt_id", "final_amount", "approved_at"])


@query("cdc_lag", """
    SELECT max(source_ts_ms) AS max_source_ts_ms, (epoch_us(:events_now) // 1000 - max(source_ts_ms)) / 1e3 AS lag_sec FROM bronze_expenses""")
def _(d):
    return ops.cdc_lag(bronze_expense_rows(d), events_now())


@query("table_fingerprint", """
    SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5(expense_id || '|' || CAST(updated_at AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS hash_sum
    FROM expenses""")
def _(d):
    return ops.table_fingerprint(d.expenses, ["expense_id", "updated_at"])


@query("ingest_health", """
    SELECT 'expenses' AS src, count(*) AS rows, :events_now AS last_ingest FROM bronze_expenses
    UNION ALL SELECT 'receipts', count(*), :events_now FROM receipts
    UNION ALL SELECT 'expense_events', count(*), :events_now FROM timeline""")
def _(d):
    return ops.ingest_health({
        "expenses": bronze_expense_rows(d),
        "receipts": bronze.bronze_rows(d.receipt_messages, schemas.RECEIPTS, events_now()),
        "expense_events": bronze.bronze_rows(d.event_messages, schemas.EXPENSE_EVENTS, events_now()),
    })


@query("trace_catalog", """
    SELECT trace_id, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS event_count, min(expense_id) AS expense_id
    FROM timeline WHERE trace_id IS NOT NULL AND created_at >= :events_now - INTERVAL 24 HOUR
    GROUP BY trace_id ORDER BY last_seen DESC, trace_id LIMIT 200""")
def _(d):
    return ops.trace_catalog(d.timeline, events_now())


@query("audited_totals_by_currency", """
    SELECT upper(coalesce(final_currency, currency)) AS currency, CAST(sum(coalesce(final_amount, amount)) AS DOUBLE) AS total FROM expenses
    WHERE status = 'approved' AND coalesce(final_amount, amount) <> 0 GROUP BY 1""")
def _(d):
    return ops.audited_totals_by_currency(d.expenses)


_DRIFT = """
    SELECT tenant_id, CAST(date_trunc('{0}', extracted_at) AS TIMESTAMP) AS window_start, '1 {0}' AS granularity,
           round(avg(avg_confidence), 6) AS avg_ocr_confidence, round(avg(CASE WHEN avg_confidence < 80 THEN 1e0 ELSE 0e0 END), 6) AS pct_low_confidence_records,
           count(*) AS n, avg(avg_confidence) < 85 OR avg(CASE WHEN avg_confidence < 80 THEN 1e0 ELSE 0e0 END) > 0.1 AS alert
    FROM ocr GROUP BY 1, 2"""


@query("ocr_drift_profile", _DRIFT.format("day"))
def _(d):
    return ops.ocr_drift_profile(d.ocr)


@query("ocr_drift_hourly", _DRIFT.format("hour"))
def _(d):
    return ops.ocr_drift_profile(d.ocr, "1 hour")


@query("chunks_per_tenant", "SELECT tenant_id, count(*) AS n FROM audit GROUP BY tenant_id ORDER BY n DESC, tenant_id LIMIT 5")
def _(d):
    return ops.chunks_per_tenant(chunk_table(d))


@query("time_to_approve", """
    SELECT tenant_id, count(*) AS n, round(avg((epoch_us(a) - epoch_us(c)) / 1e6), 3) AS avg_sec FROM (
      SELECT tenant_id, expense_id, min(CASE WHEN event_type = 'created' THEN created_at END) AS c, min(CASE WHEN event_type = 'approved' THEN created_at END) AS a
      FROM timeline GROUP BY ALL) t WHERE a >= c GROUP BY tenant_id""")
def _(d):
    return ops.time_to_approve(d.timeline)


@query("hitl_share_monthly", """
    SELECT tenant_id, CAST(date_trunc('month', created_at) AS TIMESTAMP) AS month, count(*) AS n, count(h.expense_id) AS reviewed,
           round(count(h.expense_id) / count(*), 6) AS share
    FROM expenses e LEFT JOIN (SELECT DISTINCT expense_id FROM hitl) h USING (expense_id) GROUP BY 1, 2""")
def _(d):
    return ops.hitl_share_monthly(d.expenses, d.hitl)


@query("hitl_by_actor", "SELECT resolved_by, count(*) AS n FROM hitl WHERE status = 'resolved' GROUP BY resolved_by")
def _(d):
    return ops.hitl_by_actor(d.hitl)


# --- joins across layers ------------------------------------------------------------------


@query("layer_freshness", """
    SELECT b.expense_id, make_timestamp(b.ts_ms * 1000) AS bronze_latest, s.status, s.updated_at AS silver_ts, g.approved_at AS gold_ts,
           (epoch_us(s.updated_at) // 1000 - b.ts_ms) / 1e3 AS bronze_to_silver_sec,
           (epoch_us(g.approved_at) // 1000 - epoch_us(s.updated_at) // 1000) / 1e3 AS silver_to_gold_sec
    FROM (SELECT expense_id, max(source_ts_ms) AS ts_ms FROM bronze_expenses GROUP BY 1) b
    LEFT JOIN cdc_state s USING (expense_id) LEFT JOIN (SELECT * FROM cdc_state WHERE status = 'approved') g USING (expense_id)
    ORDER BY b.ts_ms DESC, b.expense_id LIMIT 50""")
def _(d):
    rows = bronze_expense_rows(d)
    state = cdc.silver_state(silver.clean_expenses(rows), "expense_id")
    return ops.layer_freshness(rows, state, state.where("status = 'approved'"))


@query("ocr_amount_gap", """
    SELECT expense_id, CAST(ocr_total AS DOUBLE) AS ocr_total, CAST(amount AS DOUBLE) AS user_amount, avg_confidence, extracted_at,
           round(abs(CAST(ocr_total - amount AS DOUBLE) / CASE WHEN amount > 0 THEN CAST(amount AS DOUBLE) ELSE 1e0 END), 9) AS diff_pct
    FROM ocr JOIN (SELECT expense_id, amount FROM expenses) e USING (expense_id)
    WHERE abs(CAST(ocr_total - amount AS DOUBLE) / CASE WHEN amount > 0 THEN CAST(amount AS DOUBLE) ELSE 1e0 END) > 0.01""")
def _(d):
    return ops.ocr_amount_gap(d.ocr, d.expenses, None).withColumn("diff_pct", F.round("diff_pct", 9))


@query("never_reached_ocr", """
    SELECT expense_id FROM timeline GROUP BY expense_id
    HAVING bool_or(event_type = 'created') AND NOT bool_or(event_type = 'ocr_started')""")
def _(d):
    return ops.never_reached_ocr(d.timeline)


@query("expense_receipts", """
    SELECT e.expense_id, receipt_id, e.tenant_id, r.content_type, r.size_bytes FROM expenses e JOIN receipts r USING (receipt_id) WHERE e.tenant_id = r.tenant_id""")
def _(d):
    return ops.expense_receipts(d.expenses, d.receipts).select("expense_id", "receipt_id", "tenant_id", "content_type", "size_bytes")


@query("workflow_owner", """
    SELECT workflow_id, tenant_id FROM expenses
    UNION ALL SELECT DISTINCT 'rag-' || session_id || '-1', tenant_id FROM chat_turns
    UNION ALL SELECT DISTINCT 'rag-x' || session_id || '-1', NULL FROM chat_turns""")
def _(d):
    sessions = d.chat_turns.select("session_id", "tenant_id").distinct()
    workflows = d.expenses.select("workflow_id")
    for prefix in ("rag-", "rag-x"):
        workflows = workflows.unionByName(sessions.select(F.concat(F.lit(prefix), "session_id", F.lit("-1")).alias("workflow_id")))
    return ops.workflow_owner(workflows, d.expenses, sessions)


@query("layer_reconcile", """
    SELECT 'in_bronze' AS layer, count(DISTINCT expense_id) AS keys FROM bronze_expenses
    UNION ALL SELECT 'in_silver', count(DISTINCT expense_id) FROM cdc_state""")
def _(d):
    rows = bronze_expense_rows(d)
    return ops.layer_reconcile({"in_bronze": rows, "in_silver": cdc.silver_state(silver.clean_expenses(rows), "expense_id")})


@query("missing_downstream", "SELECT DISTINCT expense_id FROM bronze_expenses WHERE expense_id NOT IN (SELECT expense_id FROM cdc_state)")
def _(d):
    rows = bronze_expense_rows(d)
    return ops.missing_downstream(rows, cdc.silver_state(silver.clean_expenses(rows), "expense_id"))


@query("layer_days", """
    WITH u AS (SELECT DISTINCT CAST(coalesce(approved_at, updated_at) AS DATE) AS day, expense_id FROM expenses),
         l AS (SELECT DISTINCT CAST(approved_at AS DATE) AS day, expense_id FROM audit),
         b AS (SELECT coalesce(u.day, l.day) AS day, u.expense_id AS one, l.expense_id AS other
               FROM u FULL JOIN l ON u.day = l.day AND u.expense_id = l.expense_id)
    SELECT CAST(day AS VARCHAR) AS day, count(one) AS upper_ids, count(other) AS lower_ids, count(*) FILTER (other IS NULL) AS missing,
           count(*) = count(one) AND count(*) = count(other) AS settled, true AS in_bound FROM b GROUP BY day""")
def _(d):
    silver_days = d.expenses.withColumn("approved_at", F.coalesce("approved_at", "updated_at"))
    return sketches.day_report(silver_days, audit_table(d), "expense_id", "approved_at").drop("only_upper", "only_lower")


# --- presence, lists, pages ---------------------------------------------------------------

_PRESENCE = ("bronze_expenses", "receipts", "timeline", "ocr", "hitl_changes", "expenses", "timeline", "ocr", "hitl", "audit")
_PRESENCE_NAMES = ("bronze.expenses", "bronze.receipts", "bronze.events", "bronze.ocr", "bronze.hitl",
                   "silver.expenses", "silver.events", "silver.ocr", "silver.hitl", "gold.expense_audit")


def _layers(d: Domain) -> dict[str, DataFrame]:
    hitl_bronze = bronze.bronze_rows(d.hitl_messages, schemas.HITL_TASKS)
    frames = (bronze_expense_rows(d), d.receipts, d.timeline, d.ocr, hitl_bronze, d.expenses, d.timeline, d.ocr, d.hitl, audit_table(d))
    return dict(zip(_PRESENCE_NAMES, frames, strict=True))


@query("layer_presence", " UNION ALL ".join(
    f"SELECT '{name}' AS layer, count(*) AS row_count, CAST({i} AS BIGINT) AS sort_order FROM {table} WHERE expense_id = 'exp_00000007'"
    for i, (name, table) in enumerate(zip(_PRESENCE_NAMES, _PRESENCE, strict=True), 1)))
def _(d):
    return ops.presence(_layers(d), "exp_00000007")


@query("layer_funnel", """
    SELECT 'bronze' AS layer, count(*) AS n, CAST(1 AS BIGINT) AS sort_order FROM bronze_expenses
    UNION ALL SELECT 'silver', count(*), 2 FROM expenses UNION ALL SELECT 'gold', count(*), 3 FROM audit""")
def _(d):
    return ops.layer_funnel({"bronze": bronze_expense_rows(d), "silver": d.expenses, "gold": audit_table(d)})


@query("trace_silver_expense", """
    SELECT expense_id, tenant_id, user_id, receipt_id, workflow_id, status, CAST(amount AS DOUBLE) AS amount, currency, vendor, CAST(date AS VARCHAR) AS date, category,
           CAST(final_amount AS DOUBLE) AS final_amount, final_currency, final_vendor, CAST(final_date AS VARCHAR) AS final_date, approved_at, created_at, updated_at FROM expenses""")
def _(d):
    return ops.trace_view("silver_expense", d.expenses)


@query("trace_silver_timeline", "SELECT created_at, event_type, workflow_id, event_id FROM timeline WHERE expense_id = 'exp_00000007'")
def _(d):
    return ops.trace_view("silver_timeline", d.timeline, "exp_00000007").drop("actor")


@query("trace_silver_ocr", """
    SELECT expense_id, tenant_id, user_id, CAST(ocr_total AS DOUBLE) AS ocr_total, ocr_total_confidence, ocr_vendor, ocr_vendor_confidence,
           CAST(ocr_date AS VARCHAR) AS ocr_date, ocr_date_confidence, ocr_currency, avg_confidence, textract_raw_s3_key, extracted_at FROM ocr""")
def _(d):
    return ops.trace_view("silver_ocr", d.ocr)


@query("trace_silver_hitl", """
    SELECT task_id, status, decision, resolved_by, resolved_at, created_at, workflow_id, array_to_string(discrepancy_fields, ',') AS discrepancy_fields FROM hitl""")
def _(d):
    return ops.trace_view("silver_hitl", d.hitl).drop("resolved_fields")


@query("trace_gold_audit", """
    SELECT tenant_id, expense_id, user_id, receipt_id, CAST(final_amount AS DOUBLE) AS final_amount, final_currency, final_vendor, CAST(final_date AS VARCHAR) AS final_date,
           category, approved_at, had_hitl, hitl_decision, hitl_resolved_by, hitl_resolved_at FROM audit WHERE expense_id = 'exp_00000001'""")
def _(d):
    return ops.trace_view("gold_audit", audit_table(d), "exp_00000001")


@query("trace_bronze_expense", """
    SELECT source_ts_ms AS __source_ts_ms, op AS __op, deleted AS __deleted, status, CAST(amount AS DOUBLE) AS amount, currency, vendor, date,
           CAST(final_amount AS DOUBLE) AS final_amount, CAST(NULL AS VARCHAR) AS final_vendor, CAST(NULL AS VARCHAR) AS final_date, created_at, updated_at,
           :events_now AS _cdc_ingestion_ts FROM bronze_expenses""")
def _(d):
    return ops.trace_view("bronze_expense", bronze_expense_rows(d))


def trace_of_messages(view: str, messages: DataFrame, topic: schemas.Topic) -> DataFrame:
    return ops.trace_view(view, bronze.bronze_rows(messages, topic, only=["expense_id", *ops.TRACE_VIEWS[view][0]]))


@query("trace_bronze_receipt", """
    SELECT epoch_us(uploaded_at) // 1000 AS __source_ts_ms, 'c' AS __op, receipt_id, s3_key, content_type, size_bytes, uploaded_at FROM receipts""")
def _(d):
    return trace_of_messages("bronze_receipt", d.receipt_messages, schemas.RECEIPTS)


@query("trace_bronze_events", """
    SELECT epoch_us(created_at) // 1000 AS __source_ts_ms, 'c' AS __op, event_type, workflow_id, event_id, created_at FROM timeline""")
def _(d):
    return trace_of_messages("bronze_events", d.event_messages, schemas.EXPENSE_EVENTS).drop("actor")


@query("trace_bronze_ocr", """
    SELECT epoch_us(extracted_at) // 1000 AS __source_ts_ms, 'u' AS __op, CAST(ocr_total AS DOUBLE) AS ocr_total, ocr_vendor, CAST(ocr_date AS VARCHAR) AS ocr_date,
           ocr_currency, avg_confidence, textract_raw_s3_key, extracted_at FROM ocr""")
def _(d):
    return trace_of_messages("bronze_ocr", d.ocr_messages, schemas.OCR_EXTRACTIONS)


@query("trace_bronze_hitl", """
    SELECT source_ts_ms AS __source_ts_ms, op AS __op, task_id, status, decision, resolved_by, resolved_at, created_at, workflow_id FROM hitl_changes""")
def _(d):
    return trace_of_messages("bronze_hitl", d.hitl_messages, schemas.HITL_TASKS)


@query("expenses_page", """
    SELECT expense_id, status, true AS has_more FROM expenses WHERE tenant_id = 't_1' AND status = 'approved' AND date >= DATE '1996-01-01'
    AND date <= DATE '2000-12-31' AND expense_id < 'exp_00001200' ORDER BY expense_id DESC LIMIT 50""")
def _(d):
    page = ops.expenses_page(d.expenses, "t_1", status="approved", date_from="1996-01-01", date_to="2000-12-31", cursor="exp_00001200")
    return page.select("expense_id", "status", "has_more")


@query("hitl_list", """
    SELECT task_id, expense_id, created_at FROM hitl WHERE tenant_id = 't_2' AND status = 'pending' ORDER BY created_at DESC, task_id LIMIT 50""")
def _(d):
    return ops.hitl_list(d.hitl, "t_2", "pending").select("task_id", "expense_id", "created_at")


@query("pending_tasks", "SELECT task_id, expense_id, tenant_id, created_at FROM hitl WHERE status = 'pending'")
def _(d):
    return ops.pending_tasks(d.hitl).select("task_id", "expense_id", "tenant_id", "created_at")


@query("expense_timeline", """
    SELECT event_id, event_type, created_at FROM timeline WHERE expense_id = 'exp_00000011' AND tenant_id = 't_1' ORDER BY created_at, event_id LIMIT 200""")
def _(d):
    return ops.expense_timeline(d.timeline, "exp_00000011", "t_1").select("event_id", "event_type", "created_at")


@query("session_turns", """
    SELECT turn, user_message, assistant_message FROM chat_turns WHERE session_id = 'sess_7' AND tenant_id = 't_2' ORDER BY turn LIMIT 200""")
def _(d):
    return ops.session_turns(d.chat_turns, "sess_7", "t_2").select("turn", "user_message", "assistant_message")


@query("latest_expenses", """
    SELECT expense_id, tenant_id, status, CAST(amount AS DOUBLE) AS amount, currency, vendor, created_at, updated_at FROM expenses
    ORDER BY created_at DESC, expense_id LIMIT 20""")
def _(d):
    return ops.latest_expenses(d.expenses)


@query("expense_id_options", """
    SELECT expense_id, max(created_at) AS last_seen FROM bronze_expenses GROUP BY expense_id ORDER BY last_seen DESC, expense_id LIMIT 500""")
def _(d):
    return ops.expense_id_options(bronze_expense_rows(d))


@query("ocr_low_conf", """
    SELECT expense_id, tenant_id, avg_confidence, CAST(ocr_total AS DOUBLE) AS ocr_total, ocr_vendor, CAST(ocr_date AS VARCHAR) AS ocr_date, extracted_at
    FROM ocr WHERE avg_confidence < 80 ORDER BY extracted_at DESC, expense_id LIMIT 50""")
def _(d):
    return ops.ocr_low_confidence(d.ocr)


@query("tenant_chunks", """
    SELECT expense_id || '_main' AS chunk_id, approved_at FROM audit WHERE tenant_id = 't_4' ORDER BY approved_at DESC, chunk_id LIMIT 10""")
def _(d):
    return ops.tenant_chunks(chunk_table(d), "t_4").select("chunk_id", "approved_at")


@query("recent_receipts", """
    SELECT receipt_id, expense_id, uploaded_at FROM receipts WHERE tenant_id = 't_1' AND user_id = 'u_11' ORDER BY uploaded_at DESC, receipt_id LIMIT 20""")
def _(d):
    return ops.recent_receipts(d.receipts, "t_1", "u_11")


@query("recent_expenses", """
    SELECT expense_id, status, CAST(amount AS DOUBLE) AS amount, vendor, CAST(date AS VARCHAR) AS date, workflow_id, created_at
    FROM expenses WHERE tenant_id = 't_1' ORDER BY created_at DESC, expense_id LIMIT 10""")
def _(d):
    return ops.recent_expenses_of_tenant(d.expenses, "t_1")


@query("recent_sessions", """
    SELECT session_id, min(created_at) AS created_at, max(turn) AS last_turn FROM chat_turns WHERE tenant_id = 't_2' AND user_id = 'u_7'
    GROUP BY session_id ORDER BY created_at DESC, session_id LIMIT 10""")
def _(d):
    sessions = d.chat_turns.groupBy("session_id", "tenant_id", "user_id").agg(
        F.min("created_at").alias("created_at"), F.max("turn").alias("last_turn"))
    return ops.recent_sessions(sessions, "t_2", "u_7")


@query("in_flight", "SELECT expense_id, status, created_at FROM expenses WHERE status IN ('pending', 'processing')")
def _(d):
    return ops.in_flight(d.expenses).select("expense_id", "status", "created_at")


# --- windows ------------------------------------------------------------------------------


@query("breadcrumb", """
    SELECT created_at, event_type, actor_type, actor_id, workflow_id, expense_id, event_id,
           CAST(floor(epoch_us(created_at) / 1e6) - floor(epoch_us(prev) / 1e6) AS BIGINT) AS stage_duration_sec
    FROM (SELECT *, lag(created_at) OVER (PARTITION BY expense_id ORDER BY created_at, event_id) AS prev FROM timeline) t""")
def _(d):
    return ops.breadcrumb(d.timeline)


@query("breadcrumb_of_trace", """
    SELECT created_at, event_type, expense_id, CAST(floor(epoch_us(created_at) / 1e6) - floor(epoch_us(prev) / 1e6) AS BIGINT) AS stage_duration_sec
    FROM (SELECT *, lag(created_at) OVER (PARTITION BY expense_id ORDER BY created_at, event_id) AS prev FROM timeline WHERE trace_id = 'trace_8') t""")
def _(d):
    return ops.breadcrumb(d.timeline, "trace_8").select("created_at", "event_type", "expense_id", "stage_duration_sec")


@query("stage_durations", """
    SELECT expense_id, event_id, event_type, CAST((epoch_us(created_at) - epoch_us(prev)) // 1000000 AS BIGINT) AS stage_sec
    FROM (SELECT *, lag(created_at) OVER (PARTITION BY expense_id ORDER BY created_at, event_id) AS prev FROM timeline) t""")
def _(d):
    return ops.stage_durations(d.timeline)


@query("latest_embedding", "SELECT chunk_id, tenant_id, updated_at, CAST(len(embedding) AS BIGINT) AS dimensions, CAST(embedding[1] AS DOUBLE) AS first FROM latest_emb")
def _(d):
    return retrieval.latest_embeddings(d.embedding_log).select(
        "chunk_id", "tenant_id", "updated_at", F.size("embedding").alias("dimensions"), F.col("embedding")[0].alias("first"))


@query("channel_replay_buffer", """
    WITH fan AS (
      SELECT event_id, created_at, 'tenant:' || tenant_id || ':user:u_' || user_id AS channel FROM timeline
      UNION ALL SELECT event_id, created_at, 'tenant:' || tenant_id || ':workflow:' || workflow_id FROM timeline),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY created_at DESC, event_id DESC) AS buffer_pos,
                      max(created_at) OVER (PARTITION BY channel) AS last FROM fan)
    SELECT channel, event_id, created_at, buffer_pos FROM ranked WHERE buffer_pos <= 50 AND last >= :events_now - INTERVAL 48 HOUR""")
def _(d):
    events = d.timeline.withColumn("user_id", F.concat(F.lit("u_"), "user_id"))
    return ops.channel_replay_buffer(events, events_now(), ttl_seconds=48 * 3600).select("channel", "event_id", "created_at", "buffer_pos")


#: The first ten characters after the prefix are digits of base 32.
_ULID_MILLIS = " + ".join(f"(strpos('{text.CROCKFORD}', substr(last_event_id, {5 + i}, 1)) - 1) * {32 ** (9 - i)}" for i in range(10))
_ULID_HEAD = " || ".join(f"substr('{text.CROCKFORD}', CAST((epoch_us(created_at) // 1000 // {32 ** i}) % 32 AS INTEGER) + 1, 1)" for i in reversed(range(10)))


@query("replay_after_event", f"""
    WITH requests AS (
      SELECT 'tenant:' || tenant_id || ':user:u_' || user_id AS channel, 'client_' || n AS client_id,
             CASE WHEN n % 21 = 0 THEN 'evt_broken' ELSE 'evt_' || {_ULID_HEAD} || lpad(CAST(n AS VARCHAR), 16, '0') END AS last_event_id FROM timeline WHERE n % 7 = 0),
    asked AS (SELECT *, CASE WHEN length(last_event_id) = 30 THEN {_ULID_MILLIS} ELSE 0 END AS after FROM requests),
    fan AS (SELECT event_id, created_at, 'tenant:' || tenant_id || ':user:u_' || user_id AS channel FROM timeline),
    held AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY created_at DESC, event_id DESC) AS r, max(created_at) OVER (PARTITION BY channel) AS last FROM fan)
    SELECT h.channel, client_id, last_event_id, event_id, created_at,
           row_number() OVER (PARTITION BY h.channel, client_id, last_event_id ORDER BY created_at, event_id) - 1 AS position
    FROM held h JOIN asked USING (channel) WHERE r <= 50 AND last >= :events_now - INTERVAL 240 HOUR AND epoch_us(created_at) // 1000 > after""")
def _(d):
    events = d.timeline.withColumn("user_id", F.concat(F.lit("u_"), "user_id"))
    return ops.replay_after_event(events, d.replay_requests, events_now(), ttl_seconds=240 * 3600)


@query("current_step", """
    SELECT expense_id, event_type AS step FROM (SELECT *, row_number() OVER (PARTITION BY expense_id ORDER BY created_at DESC, event_id DESC) AS rn FROM timeline) t
    WHERE rn = 1""")
def _(d):
    return ops.current_step(d.timeline.withColumn("step", F.col("event_type")))


@query("chat_history", """
    SELECT session_id, tenant_id, count(user_message) + count(assistant_message) AS messages,
           string_agg(user_message || coalesce('|' || assistant_message, ''), '|' ORDER BY turn) AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tenant_id ORDER BY turn) AS rn FROM chat_turns) t WHERE rn <= 2 GROUP BY ALL""")
def _(d):
    said = F.transform("messages", lambda m: m["content"])
    return ops.chat_history(d.chat_turns, 2).select(
        "session_id", "tenant_id", F.size("messages").alias("messages"), F.concat_ws("|", said).alias("body"))


# --- audit jobs ---------------------------------------------------------------------------


@query("ocr_normalize", """
    SELECT expense_id, CAST(amount AS VARCHAR) || ' ' || currency AS total, CAST(50 + o_orderkey % 50 AS DOUBLE) AS total_confidence,
           CASE WHEN o_orderkey % 5 <> 0 THEN vendor END AS vendor, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(date, '%d/%m/%Y') END AS date
    FROM expenses""")
def _(d):
    return ocr.normalize(d.ocr_responses).select(
        "expense_id", F.col("ocr_total.value").alias("total"), F.col("ocr_total.confidence").alias("total_confidence"),
        F.col("ocr_vendor.value").alias("vendor"), F.col("ocr_date.value").alias("date"))


@query("ocr_avg_confidence", """
    SELECT expense_id, round(((50 + o_orderkey % 50) + CASE WHEN o_orderkey % 5 <> 0 THEN 60 + o_orderkey % 40 ELSE 0 END
           + CASE WHEN o_orderkey % 7 <> 0 THEN 90 ELSE 0 END) / CAST(1 + CAST(o_orderkey % 5 <> 0 AS INT) + CAST(o_orderkey % 7 <> 0 AS INT) AS DOUBLE), 2) AS avg_confidence
    FROM expenses""")
def _(d):
    return ocr.normalize(d.ocr_responses).select("expense_id", "avg_confidence")


@query("ocr_extra", """
    SELECT expense_id, 'tax=' || (o_orderkey % 1000) || ':80.0:IVA,loyalty_id=L' || substr(user_id, 3) || ':0.0:' AS fields,
           CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE array_to_string(list_transform(range(1, o_orderkey % 4 + 1), lambda i:
             'item ' || i || '/' || i * 10 || '/row ' || i || '/c' || i), ',') END AS items,
           o_orderkey % 4 AS n_items,
           CASE WHEN o_orderkey % 4 > 0 THEN round((90 + 80 + o_orderkey % 10 + 70) / 3e0, 2) END AS first_confidence
    FROM expenses""")
def _(d):
    fields = F.transform("summary_extra", lambda f: F.concat(
        f["field"], F.lit("="), f["value"], F.lit(":"), f["confidence"].cast("string"), F.lit(":"), F.coalesce(f["label_text"], F.lit(""))))
    items = F.transform("line_items", lambda i: F.concat_ws("/", i["item"], i["price"], i["row_text"], i["other"]["color"]))
    return ocr.extras(d.ocr_responses).select(
        "expense_id", fields.alias("fields"), items.alias("items"), F.size("line_items").alias("n_items"),
        F.try_element_at("line_items", F.lit(1))["confidence_avg"].alias("first_confidence"))


@query("ocr_flat_summary", """
    SELECT expense_id, 'ocr_total' || CASE WHEN o_orderkey % 5 <> 0 THEN ',ocr_vendor' ELSE '' END || CASE WHEN o_orderkey % 7 <> 0 THEN ',ocr_date' ELSE '' END
           || ',tax,loyalty_id' AS fields FROM expenses""")
def _(d):
    both = ocr.extras(ocr.normalize(d.ocr_responses))
    return both.select("expense_id", F.transform(ocr.flat_summary(), lambda f: f["field"]).alias("fields"))


@query("ocr_query_answers", """
    SELECT expense_id, CAST(amount AS VARCHAR) AS total, CAST(date AS VARCHAR) AS date, CASE WHEN o_orderkey % 3 <> 0 THEN upper(vendor) END AS vendor,
           round((95 + 40 + o_orderkey % 60 + CASE WHEN o_orderkey % 3 <> 0 THEN 70 ELSE 0 END) / CAST(CASE WHEN o_orderkey % 3 <> 0 THEN 3 ELSE 2 END AS DOUBLE), 2) AS avg_confidence
    FROM expenses""")
def _(d):
    return ocr.query_answers(d.query_responses).select(
        "expense_id", F.col("ocr_total.value").alias("total"), F.col("ocr_date.value").alias("date"),
        F.col("ocr_vendor.value").alias("vendor"), "avg_confidence")


_MERGE = """
    WITH p AS (
      SELECT expense_id, CAST(amount AS VARCHAR) || ' ' || currency AS tv, 50e0 + o_orderkey % 50 AS tc,
             CASE WHEN o_orderkey % 5 <> 0 THEN vendor END AS vv, CASE WHEN o_orderkey % 5 <> 0 THEN 60e0 + o_orderkey % 40 ELSE 0e0 END AS vc,
             CASE WHEN o_orderkey % 7 <> 0 THEN strftime(date, '%d/%m/%Y') END AS dv, CASE WHEN o_orderkey % 7 <> 0 THEN 90e0 ELSE 0e0 END AS dc,
             1 + CAST(o_orderkey % 5 <> 0 AS INT) + CAST(o_orderkey % 7 <> 0 AS INT) AS np,
             CAST(amount AS VARCHAR) AS ftv, CAST(date AS VARCHAR) AS fdv, 40e0 + o_orderkey % 60 AS fdc,
             CASE WHEN o_orderkey % 3 <> 0 THEN upper(vendor) END AS fvv, CASE WHEN o_orderkey % 3 <> 0 THEN 70e0 ELSE 0e0 END AS fvc,
             o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0 AS any_vendor
      FROM expenses),
    w AS (SELECT *, round((tc + vc + dc) / np, 2) AS avg0 FROM p)
    SELECT expense_id, CASE WHEN avg0 < 80 AND tc < 95 THEN ftv ELSE tv END AS total,
           CASE WHEN avg0 < 80 AND vc < fvc THEN fvv ELSE vv END AS vendor, CASE WHEN avg0 < 80 AND dc < fdc THEN fdv ELSE dv END AS date,
           CASE WHEN avg0 < 80 THEN round((greatest(tc, 95) + greatest(vc, fvc) + greatest(dc, fdc)) / (2 + CAST(any_vendor AS INT)), 2) ELSE avg0 END AS avg_confidence,
           avg0 < 80 AS used_fallback
    FROM w"""


@query("ocr_merge")
def _(d):
    merged = ocr.merge(ocr.normalize(d.ocr_responses).drop("response"), ocr.query_answers(d.query_responses))
    return merged.select("expense_id", F.col("ocr_total.value").alias("total"), F.col("ocr_vendor.value").alias("vendor"),
                         F.col("ocr_date.value").alias("date"), "avg_confidence", "used_fallback")


ORACLES["ocr_merge"] = oracle.complete(_MERGE)


@query("amount_normalize", """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, raw, CASE WHEN (l_orderkey + l_linenumber) % 5 = 4 THEN NULL ELSE CAST(p AS DOUBLE) END AS amount FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS p,
             CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' COP'
               WHEN 1 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || ' EUR'
               WHEN 2 THEN 'USD 0,0' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
               WHEN 3 THEN '0.0' || replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
               ELSE '1,234,567' END AS raw FROM lineitem) t""")
def _(d):
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    raw = (
        F.when(kind == 0, F.concat(price, F.lit(" COP")))
        .when(kind == 1, F.concat(F.replace(price, F.lit("."), F.lit(",")), F.lit(" EUR")))
        .when(kind == 2, F.concat(F.lit("USD 0,0"), price))
        .when(kind == 3, F.concat(F.lit("0.0"), F.replace(price, F.lit("."), F.lit(","))))
        .otherwise(F.lit("1,234,567"))
    )
    lines = d.source("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return lines.withColumn("amount", text.amount_value(F.col("raw")))


@query("date_normalize", """
    SELECT expense_id, CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || chr(9) || raw || chr(10) ELSE raw END AS raw,
           CASE kind WHEN 5 THEN NULL WHEN 2 THEN CASE WHEN day(date) <= 12 THEN strftime(make_date(year(date), day(date), month(date)), '%Y-%m-%d')
             ELSE strftime(date, '%Y-%m-%d') END ELSE strftime(date, '%Y-%m-%d') END AS day FROM (
      SELECT expense_id, date, o_orderkey, o_orderkey % 6 AS kind, CASE o_orderkey % 6 WHEN 0 THEN strftime(date, '%Y-%m-%d') WHEN 1 THEN strftime(date, '%d/%m/%Y')
             WHEN 2 THEN strftime(date, '%m/%d/%Y') WHEN 3 THEN strftime(date, '%d-%m-%Y') WHEN 4 THEN strftime(date, '%Y/%m/%d') ELSE 'on ' || strftime(date, '%Y-%m-%d') END AS raw
      FROM expenses) t""")
def _(d):
    kind = F.col("o_orderkey") % 6
    raw = F.concat(F.lit("on "), F.date_format("date", "yyyy-MM-dd"))
    for i, pattern in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")):
        raw = F.when(kind == i, F.date_format("date", pattern)).otherwise(raw)
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("\n\t"), raw, F.lit("\n"))).otherwise(raw)
    return d.expenses.select("expense_id", raw.alias("raw")).withColumn("day", text.date_value(F.col("raw")))


@query("amount_numbers", """
    SELECT o_orderkey, o_totalprice * 1e6 AS amount, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS exact_amount FROM orders""")
def _(d):
    # Numbers stay what they are, also where their text form has an exponent.
    return d.source("orders").select(
        "o_orderkey", text.amount_value(F.col("o_totalprice") * F.lit(1e6)).alias("amount"),
        text.amount_value(F.col("o_totalprice").cast("decimal(18,2)")).alias("exact_amount"))


def compared(d: Domain) -> DataFrame:
    reported = d.expenses.select("expense_id", "tenant_id", "amount", "vendor", "date", "currency")
    return audit.compare_fields(reported, d.ocr.drop("tenant_id", "user_id"))


# The ratio of every vendor pair that occurs, by the textbook LCS table.
_SIMILARITY = """
    pairs AS (SELECT DISTINCT lower(trim(vendor)) AS a, lower(trim(ocr_vendor)) AS b FROM ocr JOIN (SELECT expense_id, vendor FROM expenses) e USING (expense_id)),
    lcs AS (SELECT a, b, list_reduce(list_prepend(CAST([0] AS INT[]), list_transform(string_split(b, ''), lambda y: [ascii(y)])),
        lambda prev, y: list_reduce(list_prepend(CAST([0] AS INT[]), list_transform(range(1, len(a) + 1), lambda i: [CAST(i AS INT)])),
          lambda acc, x: list_append(acc, greatest(acc[len(acc)], coalesce(prev[x[1] + 1], 0),
             coalesce(prev[x[1]], 0) + CASE WHEN ascii(substr(a, x[1], 1)) = y[1] THEN 1 ELSE 0 END)))) AS row FROM pairs),
    ratios AS (SELECT a, b, 2e0 * row[len(row)] / (len(a) + len(b)) AS ratio FROM lcs)"""

_COMPARED = f"""
    WITH {_SIMILARITY},
    j AS (SELECT e.expense_id, e.tenant_id, CAST(e.amount AS DOUBLE) AS u, CAST(o.ocr_total AS DOUBLE) AS v, e.vendor, o.ocr_vendor, e.date, o.ocr_date,
                 r.ratio FROM expenses e JOIN ocr o USING (expense_id) JOIN ratios r ON r.a = lower(trim(e.vendor)) AND r.b = lower(trim(o.ocr_vendor))),
    c AS (SELECT *, coalesce(abs(u - v) / greatest(u, v) > 0.01 AND u <> 0 AND v <> 0, false) AS ca, ratio < 0.85 AS cv, date <> ocr_date AS cd FROM j)"""


@query("compare_fields")
def _(d):
    return compared(d).select(
        "expense_id", F.transform("conflicts", lambda c: c["field"]).alias("conflicts"),
        F.round("vendor_similarity", 6).alias("vendor_similarity"))


ORACLES["compare_fields"] = oracle.complete(_COMPARED + """
    SELECT expense_id, array_to_string(list_filter([CASE WHEN ca THEN 'amount' END, CASE WHEN cv THEN 'vendor' END, CASE WHEN cd THEN 'date' END], lambda x: x IS NOT NULL), ',') AS conflicts,
           round(ratio, 6) AS vendor_similarity FROM c""")


@query("hitl_candidates")
def _(d):
    return audit.hitl_candidates(compared(d), orders_now()).select(
        "task_id", "expense_id", "tenant_id", "status", "created_at", F.size("discrepancy_fields").alias("n_fields"))


ORACLES["hitl_candidates"] = oracle.complete(_COMPARED + """
    SELECT 'hitl_' || expense_id AS task_id, expense_id, tenant_id, 'pending' AS status, :orders_now AS created_at,
           CAST(ca AS BIGINT) + CAST(cv AS BIGINT) + CAST(cd AS BIGINT) AS n_fields FROM c WHERE ca OR cv OR cd""")


@query("comparison_events")
def _(d):
    return audit.comparison_events(compared(d), orders_now()).select("event_id", "expense_id", "tenant_id", "event_type", "created_at")


ORACLES["comparison_events"] = oracle.complete(_COMPARED + """
    SELECT 'evt_cmp_' || expense_id AS event_id, expense_id, tenant_id, CASE WHEN ca OR cv OR cd THEN 'discrepancy_detected' ELSE 'no_discrepancy' END AS event_type,
           :orders_now AS created_at FROM c""")


def review_rows(d: Domain) -> DataFrame:
    """Resolved tasks beside the reported and OCR values of their expense."""
    tasks = d.hitl.where("status = 'resolved'").select(
        "task_id", "expense_id", "decision", "resolved_fields", F.col("discrepancy_fields").alias("conflict_fields"))
    reported = d.expenses.select("expense_id", "amount", "vendor", "date", "currency")
    found = d.ocr.select("expense_id", "ocr_total", "ocr_vendor", "ocr_date")
    return tasks.join(reported, "expense_id").join(found, "expense_id", "left")


_REVIEW = """SELECT h.task_id, h.expense_id, h.decision, h.resolved_amount, h.discrepancy_fields AS cf, e.amount, e.vendor, e.date, e.currency, o.ocr_total, o.ocr_vendor, o.ocr_date
    FROM hitl h JOIN expenses e USING (expense_id) LEFT JOIN ocr o USING (expense_id) WHERE h.status = 'resolved'"""


@query("hitl_resolve", f"""
    SELECT task_id, CASE WHEN resolved_amount IS NOT NULL THEN CAST(resolved_amount AS DOUBLE) WHEN decision = 'accept_ocr' THEN CAST(ocr_total AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS final_amount,
           CASE WHEN decision = 'accept_ocr' THEN ocr_vendor ELSE vendor END AS final_vendor,
           CAST(CASE WHEN decision = 'accept_ocr' THEN ocr_date ELSE date END AS VARCHAR) AS final_date, currency AS final_currency
    FROM ({_REVIEW}) r""")
def _(d):
    return audit.resolve(review_rows(d)).select("task_id", "final_amount", "final_vendor", "final_date", "final_currency")


@query("source_per_field", f"""
    SELECT task_id, CASE WHEN resolved_amount IS NOT NULL THEN 'hitl_custom' WHEN list_contains(cf, 'amount') AND decision = 'accept_ocr' THEN 'ocr' ELSE 'user' END AS amount,
           CASE WHEN list_contains(cf, 'vendor') AND decision = 'accept_ocr' THEN 'ocr' ELSE 'user' END AS vendor,
           CASE WHEN list_contains(cf, 'date') AND decision = 'accept_ocr' THEN 'ocr' ELSE 'user' END AS date, 'user' AS currency
    FROM ({_REVIEW}) r""")
def _(d):
    explained = audit.source_per_field(review_rows(d))
    return explained.select("task_id", *[F.col("source_per_field")[f].alias(f) for f in audit.AUDITED_FIELDS])


@query("finalize_without_conflict")
def _(d):
    done = audit.finalize_without_conflict(compared(d))
    return done.select("expense_id", "final_amount", "final_vendor", "final_date", "final_currency",
                       F.col("source_per_field")["amount"].alias("amount_source"))


ORACLES["finalize_without_conflict"] = oracle.complete(_COMPARED + """
    SELECT c.expense_id, c.u AS final_amount, c.vendor AS final_vendor, CAST(c.date AS VARCHAR) AS final_date, e.currency AS final_currency, 'ocr_high_confidence' AS amount_source
    FROM c JOIN (SELECT expense_id, currency FROM expenses) e USING (expense_id) WHERE NOT (ca OR cv OR cd)""")


@query("touched_by_review", "SELECT expense_id, coalesce(src_amount <> 'user' OR src_vendor <> 'user', false) AS had_hitl FROM expenses")
def _(d):
    return d.expenses.select("expense_id", audit.touched_by_review(F.col("source_per_field")).alias("had_hitl"))


@query("changed_fields", """
    SELECT expense_id, 'amount' AS field, CAST(amount AS VARCHAR) AS reported_value, CAST(final_amount AS VARCHAR) AS final_value, src_amount AS source FROM expenses WHERE src_amount <> 'user'
    UNION ALL SELECT expense_id, 'vendor', vendor, final_vendor, src_vendor FROM expenses WHERE src_vendor <> 'user'""")
def _(d):
    return audit.changed_fields(d.expenses).select("expense_id", "field", "reported_value", "final_value", "source")


@query("recover_rejected", """
    SELECT expense_id, CASE WHEN hit THEN 'approved' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE rejection_reason END AS rejection_reason,
           CASE WHEN hit THEN :orders_now ELSE updated_at END AS updated_at FROM (
      SELECT *, status = 'rejected' AND rejection_reason IN ('VECTOR_SYNC_TIMEOUT', 'VECTOR_SYNC_FAILED') AND final_amount IS NOT NULL AS hit FROM expenses) t""")
def _(d):
    return repair.recover_rejected(d.expenses, orders_now())[0].select("expense_id", "status", "rejection_reason", "updated_at")


@query("recover_rejected_events", """
    SELECT 'evt_recover_' || expense_id || '_' || (epoch_us(:orders_now) // 1000) AS event_id, expense_id, tenant_id, rejection_reason AS prior
    FROM expenses WHERE status = 'rejected' AND rejection_reason IN ('VECTOR_SYNC_TIMEOUT', 'VECTOR_SYNC_FAILED') AND final_amount IS NOT NULL""")
def _(d):
    return repair.recover_rejected(d.expenses, orders_now())[1].select(
        "event_id", "expense_id", "tenant_id", F.col("details")["prior_rejection_reason"].alias("prior"))


@query("backfill_hitl_decision", """
    SELECT h.task_id, coalesce(h.decision, CASE WHEN e.task_id IS NOT NULL THEN 'keep_user_value' END) AS decision,
           CASE WHEN h.decision IS NULL AND e.task_id IS NOT NULL THEN e.actor_id ELSE h.resolved_by END AS resolved_by,
           CASE WHEN h.decision IS NULL AND e.task_id IS NOT NULL THEN CAST(e.k AS VARCHAR) ELSE h.resolved_amount END AS resolved_amount
    FROM hitl h LEFT JOIN (SELECT hitl_task_id AS task_id, actor_id, k FROM (SELECT *, row_number() OVER (PARTITION BY hitl_task_id ORDER BY created_at, event_id) AS rn
         FROM timeline WHERE hitl_task_id IS NOT NULL) t WHERE rn = 1) e USING (task_id)""")
def _(d):
    return repair.backfill_hitl_decision(d.hitl, d.timeline).select(
        "task_id", "decision", "resolved_by", F.try_element_at("resolved_fields", F.lit("amount")).alias("resolved_amount"))


@query("backfill_receipt_expense", "SELECT r.receipt_id, e.expense_id FROM receipts r JOIN expenses e USING (receipt_id)")
def _(d):
    return repair.backfill_receipt_expense(d.receipts, d.expenses).select("receipt_id", "expense_id")


@query("rename_key", "SELECT task_id, array_to_string(discrepancy_fields, ',') AS discrepancy_fields FROM hitl_changes")
def _(d):
    old = F.col("status") == "pending"
    mixed = d.hitl_changes.withColumn("fields_in_conflict", F.when(old, F.col("discrepancy_fields"))).withColumn(
        "discrepancy_fields", F.when(~old, F.col("discrepancy_fields")))
    return repair.rename_key(mixed, "fields_in_conflict", "discrepancy_fields").select("task_id", "discrepancy_fields")


@query("hitl_expired", """
    SELECT task_id, tenant_id, expense_id, created_at, 'rejected' AS expense_status, 'HITL_TIMEOUT' AS rejection_reason FROM hitl
    WHERE status = 'pending' AND created_at < :orders_now - INTERVAL 7 DAY""")
def _(d):
    return audit.expire_tasks(d.hitl, orders_now())


# --- structured search --------------------------------------------------------------------

_LIST_COLUMNS = """expense_id, final_vendor AS vendor, CAST(final_amount AS DOUBLE) AS amount, final_currency AS currency, CAST(final_date AS VARCHAR) AS date,
    category, '/expenses/' || expense_id AS link, 'sql' AS _source"""


@query("search_list", f"""
    SELECT {_LIST_COLUMNS} FROM audit AS a WHERE tenant_id = 't_1' AND lower(final_vendor) LIKE '%vendor 1%' AND category = 'food'
    AND final_amount >= 1000.0 ORDER BY a.final_date DESC, expense_id LIMIT 50""")
def _(d):
    request = {"vendor": "Vendor 1", "category": "Food", "amount_min": 1000, "limit": 999, "tenant_id": "t_9"}
    return search.search(audit_table(d), request, "t_1")["rows"]


@query("search_sum", """
    SELECT coalesce(CAST(sum(final_amount) AS DOUBLE), 0e0) AS aggregate_value, min(final_currency) AS currency, count(*) AS row_count_total FROM audit
    WHERE tenant_id = 't_2' AND final_date >= DATE '1997-01-01' AND final_date <= DATE '1999-12-31' AND final_currency = 'USD'""")
def _(d):
    request = {"date_from": "1997-01-01", "date_to": "1999-12-31", "currency": "usd", "aggregate": "sum"}
    return search.search(audit_table(d), request, "t_2")["summary"]


@query("search_sum_by_currency", """
    SELECT final_currency AS currency, CAST(sum(final_amount) AS DOUBLE) AS aggregate_value, count(*) AS row_count_total FROM audit
    WHERE tenant_id = 't_2' AND category = 'travel' GROUP BY final_currency""")
def _(d):
    return search.total_by_currency(audit_table(d), search.parse_request({"category": "travel"}, "t_2"))


@query("search_count", """
    SELECT count(*) AS aggregate_value, count(*) AS row_count_total FROM audit WHERE tenant_id = 't_3' AND final_amount <= 50000.0""")
def _(d):
    return search.search(audit_table(d), {"amount_max": 50000, "aggregate": "count"}, "t_3")["summary"]


@query("search_sample", f"""
    SELECT {_LIST_COLUMNS} FROM audit AS a WHERE tenant_id = 't_3' AND final_amount <= 50000.0 ORDER BY a.final_date DESC, expense_id LIMIT 10""")
def _(d):
    return search.search(audit_table(d), {"amount_max": 50000, "aggregate": "count"}, "t_3")["rows"]


# --- retrieval ----------------------------------------------------------------------------


def embedded_chunks(d: Domain) -> DataFrame:
    return retrieval.with_latest_embedding(d.chunks, d.embedding_log)


@query("chunks_latest_embedding", """
    SELECT chunk_id, tenant_id, c.expense_id, e.updated_at AS embedded_at, e.embedding IS NOT NULL AS has_embedding
    FROM chunks c LEFT JOIN latest_emb e USING (chunk_id, tenant_id)""")
def _(d):
    return embedded_chunks(d).select("chunk_id", "tenant_id", "expense_id", "embedded_at", F.col("embedding").isNotNull().alias("has_embedding"))


@query("chunks_missing_embedding", "SELECT chunk_id, tenant_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM embedding_log)")
def _(d):
    return retrieval.missing_embeddings(d.chunks, d.embedding_log).select("chunk_id", "tenant_id")


@query("embedding_inspect", """
    SELECT chunk_id, tenant_id, updated_at, CAST(len(embedding) AS BIGINT) AS dimensions, round(CAST(embedding[8] AS DOUBLE), 6) AS eighth FROM embedding_log
    WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE tenant_id = 't_1')""")
def _(d):
    found = retrieval.embeddings_of_expenses(d.embedding_log, d.chunks.where("tenant_id = 't_1'"))
    return found.select("chunk_id", "tenant_id", "updated_at", "dimensions", F.round(F.col("head")[7].cast("double"), 6).alias("eighth"))


@query("embedding_coverage", """
    SELECT c.tenant_id, count(*) AS chunks, count(e.chunk_id) AS with_emb FROM chunks c LEFT JOIN latest_emb e ON c.chunk_id = e.chunk_id AND c.tenant_id = e.tenant_id GROUP BY c.tenant_id""")
def _(d):
    return retrieval.embedding_coverage(d.chunks, d.embedding_log)


@query("embeddings_compact", "SELECT chunk_id, tenant_id, updated_at FROM latest_emb")
def _(d):
    return retrieval.latest_embeddings(d.embedding_log).select("chunk_id", "tenant_id", "updated_at")


@query("semantic_topk", """
    SELECT query_id, tenant_id, chunk_id, rank, round(c, 4) AS score FROM dense WHERE rank <= 10""")
def _(d):
    hits = retrieval.semantic_topk(retrieval.latest_embeddings(d.embedding_log), d.questions)
    return hits.select("query_id", "tenant_id", "chunk_id", "rank", "score")


@query("semantic_above_floor", "SELECT query_id, chunk_id, round(c, 4) AS score FROM dense WHERE rank <= 10 AND round(c, 4) >= 0.3")
def _(d):
    hits = retrieval.semantic_topk(retrieval.latest_embeddings(d.embedding_log), d.questions)
    return retrieval.above_floor(hits, 0.3).select("query_id", "chunk_id", "score")


@query("semantic_citable", """
    SELECT query_id, chunk_id, expense_id, round(c, 4) AS score, '/expenses/' || expense_id AS link, 'semantic' AS _source
    FROM (SELECT query_id, chunk_id, expense_id, c, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS r
          FROM dense JOIN (SELECT chunk_id, expense_id FROM chunks) k USING (chunk_id)) z WHERE r <= 10""")
def _(d):
    hits = retrieval.semantic_topk(embedded_chunks(d).select("chunk_id", "tenant_id", "expense_id", "embedding"), d.questions)
    return retrieval.citable(hits).select("query_id", "chunk_id", "expense_id", "score", "link", "_source")


@query("lexical_topk", "SELECT query_id, tenant_id, chunk_id, lexical_score, rank FROM bm25 WHERE rank <= 10")
def _(d):
    return retrieval.lexical_topk(d.chunks, d.questions).select("query_id", "tenant_id", "chunk_id", "lexical_score", "rank")


@query("lexical_indexed", "SELECT query_id, tenant_id, chunk_id, lexical_score, rank FROM bm25 WHERE rank <= 10")
def _(d):
    # An index of other texts, with chunks that are no more and without some that are, brought up to date by what differs.
    place = scratch_dir(d.spark, "postings")
    chunks = d.chunks.select("chunk_id", "tenant_id", "chunk_text")
    early = chunks.where("tenant_id <> 't_2'").select(
        "chunk_id", "tenant_id", F.when(F.col("tenant_id") == "t_3", F.concat(F.lit("reau "), "chunk_text")).otherwise(F.col("chunk_text")).alias("chunk_text"))
    gone = chunks.where("tenant_id = 't_1'").select(F.concat(F.lit("old_"), "chunk_id").alias("chunk_id"), "tenant_id", "chunk_text")
    index = postings.Index(d.spark, f"{place}/index", parts=8)
    postings.build(index, early.unionByName(gone))
    postings.update(index, chunks, gone)
    return postings.topk(index, d.questions).select("query_id", "tenant_id", "chunk_id", "lexical_score", "rank")


@query("hybrid_rrf")
def _(d):
    return retrieval.hybrid_topk(d.chunks, retrieval.latest_embeddings(d.embedding_log), d.questions, 10, depth=50).select("query_id", "tenant_id", "chunk_id", "rrf_score", "rank")


ORACLES["hybrid_rrf"] = oracle.complete("""
    WITH dr AS (SELECT query_id, tenant_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS r FROM dense WHERE chunk_id IN (SELECT chunk_id FROM chunks)),
    votes AS (SELECT query_id, tenant_id, chunk_id, r FROM dr WHERE r <= 50 UNION ALL SELECT query_id, tenant_id, chunk_id, rank FROM bm25 WHERE rank <= 50),
    fused AS (SELECT query_id, tenant_id, chunk_id, round(sum(1e0 / (60 + r)), 8) AS rrf_score FROM votes GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM fused) t WHERE rank <= 10""")


def approximate_report(d):
    """The hits of the approximate search; and in one row its recall against the exact search and the share of pairs it scores."""
    newest = retrieval.latest_embeddings(d.embedding_log)
    exact = retrieval.semantic_topk(newest.select("chunk_id", "tenant_id", "embedding"), d.questions).select("query_id", "chunk_id")
    hits = retrieval.approximate_topk(newest, d.questions)
    found = hits.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    recall = exact.join(found, ["query_id", "chunk_id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    pairs = newest.join(d.questions.select("tenant_id", "query_id"), "tenant_id").agg(F.count(F.lit(1)).alias("n"))
    tried = retrieval.approximate_candidates(newest, d.questions).agg(F.count(F.lit(1)).alias("m"))
    one = [df.withColumn("one", F.lit(1)) for df in (recall, pairs, tried)]
    return hits, one[0].join(one[1], "one").join(one[2], "one").select("recall", (F.col("m") / F.col("n")).alias("candidate_share"))


@query("semantic_approximate", "SELECT count(*) AS queries, true AS recall_above_bound, true AS candidates_below_bound FROM questions")
def _(d):
    # Against the exact search: at least 90 of 100 neighbours found while at most 70 of 100 pairs are scored.
    _, measured = approximate_report(d)
    return d.questions.agg(ops.rows().alias("queries")).crossJoin(measured).select(
        "queries", (F.col("recall") >= 0.9).alias("recall_above_bound"), (F.col("candidate_share") <= 0.7).alias("candidates_below_bound"))


@query("semantic_approximate_hits")
def _(d):
    hits, measured = approximate_report(d)
    return hits.select("query_id", "tenant_id", "chunk_id", "rank", "score").crossJoin(F.broadcast(measured))


def ivf_report(d):
    """Neighbours of the vectors whose vec_id is divisible by 100 among all vectors, by inverted lists; in one row how many of the
    exact neighbours are among them, and which shares of all pairs were looked at by code and by vector. A vector is no
    neighbour of itself."""
    stored = d.source("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = stored.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    quantiser = ivf.train(stored, "chunk_id", "embedding")
    # Index and candidates are read several times, so they are made once.
    index = tables.staged(ivf.index_rows(stored, "chunk_id", "embedding", quantiser), "ivf-index")
    candidates = tables.staged(ivf.candidates(index, asked, quantiser, id_col="chunk_id", query_id="query_id", vec_col="query_vec"), "ivf-candidates")
    hits = ivf.search(index, stored, asked, quantiser, 11, scope=None, tried=candidates)
    everyone = F.lit("all").alias("tenant_id")
    exact = retrieval.semantic_topk_many(stored.select("*", everyone), asked.select("*", everyone), 11)
    other = F.col("query_id") != F.col("chunk_id")
    # A hit that ranks among the exact ones must have the exact score.
    found = hits.where(other).select("query_id", "chunk_id", F.col("score").alias("found"))
    recall = exact.where(other).join(found, ["query_id", "chunk_id"], "left").agg(
        (F.count("found") / F.count(F.lit(1))).alias("recall"), F.bool_and(F.col("found").isNull() | (F.abs(F.col("found") - F.col("score")) < 2e-4)).alias("scores_exact"))
    tried = candidates.agg(F.count(F.lit(1)).alias("tried"))
    rows = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("chunk_id") % 100 == 0).alias("queries"))
    opened = ivf.opened_share(index, asked, quantiser, query_id="query_id", query_vec="query_vec")
    one = [df.withColumn("one", F.lit(1)) for df in (recall, tried, rows, opened)]
    measured = one[0].join(one[1], "one").join(one[2], "one").join(one[3], "one").select(
        "queries", "recall", "scores_exact", "opened_share", (F.col("tried") / (F.col("rows") * F.col("queries"))).alias("scored_share"))
    return hits, measured


@query("semantic_ivf", """
    SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, true AS recall_above_bound, true AS scored_below_bound, true AS scores_exact FROM embeddings""")
def _(d):
    # At least 90 of 100 neighbours found while at most 25 of 100 pairs are scored on their vectors.
    return ivf_report(d)[1].select("queries", (F.col("recall") >= 0.9).alias("recall_above_bound"),
                                   (F.col("scored_share") <= 0.25).alias("scored_below_bound"), "scores_exact")


@query("semantic_ivf_hits")
def _(d):
    hits, measured = ivf_report(d)
    return hits.crossJoin(F.broadcast(measured.drop("queries")))


#: SQL for the first and the last value of ``CountingEmbedder``.
_COUNT_A, _COUNT_DOT = (f"CAST(length(chunk_text) - length(replace(chunk_text, '{c}', '')) AS DOUBLE)" for c in "a.")


def first_and_last() -> list[Column]:
    return [F.col("embedding")[0].cast("double").alias("first_value"), F.element_at("embedding", -1).cast("double").alias("last_value")]


@query("embed_on_the_fly", f"""
    SELECT chunk_id, tenant_id, CASE WHEN e.chunk_id IS NULL THEN CAST(10 AS BIGINT) ELSE CAST(len(e.embedding) AS BIGINT) END AS dimensions,
           CASE WHEN e.chunk_id IS NULL THEN {_COUNT_A} ELSE CAST(e.embedding[1] AS DOUBLE) END AS first_value,
           CASE WHEN e.chunk_id IS NULL THEN {_COUNT_DOT} ELSE CAST(e.embedding[-1] AS DOUBLE) END AS last_value
    FROM chunks LEFT JOIN latest_emb e USING (chunk_id, tenant_id)""")
def _(d):
    full = retrieval.complete_embeddings(d.chunks, d.embedding_log, CountingEmbedder())
    return full.select("chunk_id", "tenant_id", F.size("embedding").alias("dimensions"), *first_and_last())


@query("revectorize", f"""
    SELECT chunk_id, tenant_id, updated_at, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(embedding[-1] AS DOUBLE) AS last_value
    FROM embedding_log WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE tenant_id = 't_0')
    UNION ALL SELECT chunk_id, tenant_id, :events_now, {_COUNT_A}, {_COUNT_DOT} FROM chunks WHERE tenant_id = 't_0'""")
def _(d):
    table = retrieval.revectorize(d.chunks, d.embedding_log, F.col("tenant_id") == "t_0", CountingEmbedder(), events_now())
    return table.select("chunk_id", "tenant_id", "updated_at", *first_and_last())


@query("embedding_sync", f"""
    SELECT chunk_id, tenant_id, CASE WHEN tenant_id IN ('t_2', 't_3') THEN :events_now ELSE :orders_now END AS updated_at, {_COUNT_A} AS first_value, {_COUNT_DOT} AS last_value
    FROM chunks""")
def _(d):
    # One tenant is new, one was edited, some chunks are gone; the others keep vector and time.
    place = scratch_dir(d.spark, "embeddings")
    chunks = d.chunks.select("chunk_id", "tenant_id", "chunk_text")
    edited = F.when(F.col("tenant_id") == "t_3", F.concat("chunk_text", F.lit(" before"))).otherwise(F.col("chunk_text"))
    gone = chunks.where("tenant_id = 't_1'").withColumn("chunk_id", F.concat(F.lit("gone_"), "chunk_id"))
    earlier = chunks.where("tenant_id <> 't_2'").withColumn("chunk_text", edited).unionByName(gone)
    retrieval.sync_embeddings(earlier, f"{place}/table", CountingEmbedder(), orders_now())
    retrieval.sync_embeddings(chunks, f"{place}/table", CountingEmbedder(), events_now())
    return tables.read_table(d.spark, f"{place}/table").select(
        "chunk_id", F.col("tenant_id").cast("string").alias("tenant_id"), "updated_at", *first_and_last())


@query("changed_chunks", "SELECT chunk_id, tenant_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM embedding_log) OR tenant_id = 't_3'")
def _(d):
    have = d.embedding_log.select("chunk_id", "tenant_id").distinct()
    old = F.when(F.col("tenant_id") == "t_3", F.lit("old text")).otherwise(F.col("chunk_text"))
    known = d.chunks.join(have, ["chunk_id", "tenant_id"]).select("chunk_id", "tenant_id", retrieval.text_hash(old).alias("text_hash"))
    return retrieval.changed_chunks(d.chunks, known).select("chunk_id", "tenant_id")


# --- grounding ----------------------------------------------------------------------------


@query("citations_normalized", """
    SELECT conv_id, pos, expense_id, vendor, amount, coalesce(link, '/expenses/' || expense_id) AS link, coalesce(src, 'unknown') AS source
    FROM tool_rows WHERE coalesce(expense_id, '') <> '' AND error IS NULL""")
def _(d):
    return grounding.normalize(d.tool_rows).select("conv_id", "pos", "expense_id", "vendor", "amount", "link", "source")


@query("citations", """
    SELECT conv_id, expense_id, amount, link, source, citation_no FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS citation_no FROM citations) t WHERE citation_no <= 10""")
def _(d):
    return grounding.citations(d.tool_rows).select("conv_id", "expense_id", "amount", "link", "source", "citation_no")


_LINKS = r"""
    links AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\[([^\]]*)\]\(\s*/expenses/([A-Za-z0-9_\-]+)\s*\)', 2)) AS expense_id,
              unnest(range(1, 1 + len(regexp_extract_all(text, '\[([^\]]*)\]\(\s*/expenses/([A-Za-z0-9_\-]+)\s*\)', 2)))) AS p FROM answers)"""


@query("cited_expenses")
def _(d):
    return grounding.cited_expenses(d.answers, d.tool_rows).select("conv_id", "turn", "expense_id", "amount", "source", "citation_no")


ORACLES["cited_expenses"] = oracle.complete(f"""
    WITH {_LINKS}, first AS (SELECT conv_id, turn, expense_id, min(p) AS p FROM links GROUP BY ALL)
    SELECT * FROM (SELECT f.conv_id, f.turn, f.expense_id, c.amount, c.source, row_number() OVER (PARTITION BY f.conv_id, f.turn ORDER BY f.p) AS citation_no
                   FROM first f JOIN citations c ON c.conv_id = f.conv_id AND c.expense_id = f.expense_id) t WHERE citation_no <= 10""")


@query("strip_ungrounded")
def _(d):
    return grounding.strip_ungrounded(d.answers, d.tool_rows)


ORACLES["strip_ungrounded"] = oracle.complete(rf"""
    WITH {_LINKS}, bad AS (
      SELECT conv_id, turn, list_sort(list(DISTINCT expense_id)) AS ids FROM links l
      WHERE NOT EXISTS (SELECT 1 FROM tool_rows r WHERE r.conv_id = l.conv_id AND r.expense_id = l.expense_id AND r.error IS NULL) GROUP BY ALL),
    cut AS (SELECT conv_id, turn, ids, CASE WHEN ids IS NULL THEN text ELSE list_reduce(list_prepend(text, ids),
              lambda t, i: replace(replace(t, '[ver](/expenses/' || i || ')', ''), '[otro]( /expenses/' || i || ' )', '')) END AS t
            FROM answers LEFT JOIN bad USING (conv_id, turn))
    SELECT conv_id, turn, coalesce(array_to_string(ids, ','), '') AS removed_ids,
           regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM cut""")


@query("tool_rows", """
    SELECT conv_id, turn, i AS row_no, 'exp_' || lpad(CAST(conv_id + CASE WHEN turn % 4 = 1 THEN 2 ELSE i END AS VARCHAR), 8, '0') AS expense_id,
           'vendor ' || (conv_id % 40) AS vendor, CAST(turn AS DOUBLE) AS amount, 'sql' AS source
    FROM (SELECT conv_id, turn, unnest(CASE turn % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE CAST([] AS BIGINT[]) END) AS i
          FROM conversations WHERE role = 'assistant' AND turn % 8 <> 5) t""")
def _(d):
    rows = grounding.normalize(grounding.tool_rows_from_messages(d.tool_messages))
    return rows.select("conv_id", "pos.turn", F.col("pos.row_no").cast("bigint").alias("row_no"), "expense_id", "vendor", "amount", "source")


@query("tool_call_outcomes", """
    SELECT tool, outcome, count(*) AS calls, round(avg(latency_ms), 2) AS avg_latency_ms, CAST(sum(row_count) AS BIGINT) AS rows_returned FROM (
      SELECT CASE WHEN user_id % 2 = 0 THEN 'search_structured' ELSE 'search_semantic' END AS tool, k % 4 AS row_count, value AS latency_ms,
             CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND k % 10 = 0 THEN 'invalid_input' WHEN k % 4 = 0 THEN 'empty' ELSE 'ok' END AS outcome
      FROM ev) t GROUP BY ALL""")
def _(d):
    return grounding.tool_call_outcomes(d.tool_calls)


# --- logs ---------------------------------------------------------------------------------


@query("log_traces", """
    SELECT trace_id, count(*) AS events, min(timestamp) AS started, max(timestamp) AS ended, count(DISTINCT stream) AS services FROM logs
    WHERE trace_id IS NOT NULL GROUP BY trace_id ORDER BY ended DESC, trace_id LIMIT 30""")
def _(d):
    return logs.traces(d.logs)


@query("log_recent_requests", """
    SELECT timestamp, request_id, trace_id, method, path, CAST(status_code AS BIGINT) AS status_code, elapsed_ms FROM logs WHERE event = 'request.completed'
    ORDER BY timestamp DESC, request_id LIMIT 30""")
def _(d):
    return logs.recent_requests(d.logs)


@query("log_component_chain", """
    SELECT timestamp, request_id, stream, event, tool FROM logs WHERE trace_id = 'trace_8' OR request_id = 'req_0000000000' ORDER BY timestamp, request_id LIMIT 500""")
def _(d):
    return logs.component_chain(d.logs, "trace_8", "req_0000000000").select("timestamp", "request_id", "stream", "event", "tool")


@query("log_component_time", """
    SELECT component, round(sum(ms), 4) AS total_ms, count(*) AS times FROM (SELECT coalesce(tool, event) AS component, coalesce(latency_ms, elapsed_ms) AS ms FROM logs) t
    WHERE ms IS NOT NULL GROUP BY component""")
def _(d):
    return logs.component_time(d.logs).withColumn("total_ms", F.round("total_ms", 4))


@query("log_tool_outcomes", "SELECT tool, outcome, count(*) AS times FROM logs WHERE tool IS NOT NULL GROUP BY ALL")
def _(d):
    return logs.tool_outcomes(d.logs)


@query("log_latency", """
    SELECT service, period_start, round(quantile_cont(elapsed_ms, 0.5), 6) AS p50, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95,
           round(quantile_cont(elapsed_ms, 0.99), 6) AS p99, count(*) AS n
    FROM (SELECT service, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS period_start, elapsed_ms FROM logs WHERE elapsed_ms IS NOT NULL) t GROUP BY ALL""")
def _(d):
    out = logs.latency_profile(d.logs, "1 day", exact=True)
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@query("log_error_rate", """
    SELECT service, CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS period_start, round(avg(CASE WHEN status_code BETWEEN 400 AND 499 THEN 1e0 ELSE 0e0 END), 6) AS error_rate,
           round(avg(CASE WHEN status_code >= 500 THEN 1e0 ELSE 0e0 END), 6) AS fault_rate, count(*) AS n FROM logs WHERE status_code IS NOT NULL GROUP BY 1, 2""")
def _(d):
    return logs.error_rate(d.logs)


@query("log_recent_errors", """
    SELECT timestamp, trace_id, request_id, level, event, error FROM logs WHERE level IN ('error', 'exception') AND timestamp >= :events_now - INTERVAL 24 HOUR
    ORDER BY timestamp DESC, request_id LIMIT 50""")
def _(d):
    return logs.recent_errors(d.logs, events_now()).drop("workflow_id", "msg")


@query("log_error_patterns", r"""
    SELECT regexp_extract(msg, '[a-z]+ at step [0-9]+') AS pattern, count(*) AS times FROM logs WHERE regexp_extract(msg, '[a-z]+ at step [0-9]+') <> '' GROUP BY 1""")
def _(d):
    return logs.error_patterns(d.logs, "[a-z]+ at step [0-9]+")


@query("log_restarts", """
    SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS hour, count(*) AS restarts, count(*) > 3 AS crash_loop FROM logs WHERE contains(msg, 'Finished start') GROUP BY 1""")
def _(d):
    return logs.restarts_per_hour(d.logs, "Finished start")


@query("counters_by_label", "SELECT event_type, tenant_id, count(*) AS total FROM timeline GROUP BY ALL")
def _(d):
    return logs.counters(d.timeline, "event_type", "tenant_id")


_CALLS = """SELECT ts AS timestamp, event_id, 'trace_' || user_id AS trace_id, 'rag-' || user_id AS workflow_id, event_type = 'view' AS uses, k,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'tool_use' ELSE 'end_turn' END AS stop_reason,
      CASE WHEN k % 2 = 0 THEN 'search_structured' ELSE 'search_semantic' END AS tool, k * 10 AS input_tokens, user_id % 100 AS output_tokens,
      CASE WHEN event_type = 'error' THEN 0 ELSE k * 10 + user_id % 100 END AS total_tokens,
      CASE WHEN event_type = 'view' THEN k ELSE user_id % 50 END AS text_chars, value AS latency_ms FROM ev"""


def decisions(d: Domain) -> DataFrame:
    """Model-call records as they are logged, the tool list as JSON text."""
    return logs.model_decisions(d.model_calls).withColumn("tools_emitted", F.to_json("tools_emitted"))


@query("model_decisions", f"""
    SELECT event_id, stop_reason, CASE WHEN uses THEN '[{{"name":"' || tool || '","input_keys":["amount_min","vendor"]}}]' ELSE '[]' END AS tools_emitted,
           CAST(uses AS BIGINT) AS tools_emitted_count, CAST(1 AS BIGINT) AS text_blocks, text_chars, input_tokens, output_tokens, total_tokens, latency_ms FROM ({_CALLS}) c""")
def _(d):
    return decisions(d).select("event_id", "stop_reason", "tools_emitted", "tools_emitted_count", "text_blocks", "text_chars",
                               "input_tokens", "output_tokens", "total_tokens", "latency_ms")


@query("model_recent_calls", f"SELECT timestamp, workflow_id, stop_reason, input_tokens FROM ({_CALLS}) c ORDER BY timestamp DESC, workflow_id LIMIT 50")
def _(d):
    return logs.recent_calls(decisions(d)).select("timestamp", "workflow_id", "stop_reason", "input_tokens")


@query("model_calls_of_trace", f"SELECT timestamp, stop_reason, text_chars FROM ({_CALLS}) c WHERE trace_id = 'trace_8' ORDER BY timestamp, workflow_id LIMIT 50")
def _(d):
    return logs.recent_calls(decisions(d), "trace_8").select("timestamp", "stop_reason", "text_chars")


@query("model_tools", f"SELECT tool AS tool_name, count(*) AS times FROM ({_CALLS}) c WHERE uses GROUP BY tool")
def _(d):
    return logs.tools_chosen(decisions(d))


@query("model_stop_reasons", f"SELECT stop_reason, count(*) AS times FROM ({_CALLS}) c GROUP BY stop_reason")
def _(d):
    return logs.stop_reasons(d.model_calls)


@query("model_turns", f"SELECT workflow_id, count(*) AS turns FROM ({_CALLS}) c GROUP BY workflow_id ORDER BY turns DESC, workflow_id LIMIT 20")
def _(d):
    return logs.turns_per_workflow(d.model_calls)


@query("model_input_keys", f"""SELECT tool, '"amount_min","vendor"' AS keys, count(*) AS times FROM ({_CALLS}) c WHERE uses GROUP BY tool""")
def _(d):
    return logs.tool_input_keys(decisions(d))


@query("model_cost", f"""
    SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS hour, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           round(sum(input_tokens) * 8e-7, 8) AS input_cost, round(sum(output_tokens) * 3.2e-6, 8) AS output_cost,
           round(sum(input_tokens) * 8e-7 + sum(output_tokens) * 3.2e-6, 8) AS total_cost FROM ({_CALLS}) c GROUP BY 1""")
def _(d):
    return logs.hourly_cost(d.model_calls)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From change events to audited spend: decode, apply changes, approve, sum per tenant."""
    d = Domain(spark, sf_dir)
    state = cdc.silver_state(silver.valid_changes(silver.clean_expenses(bronze_expense_rows(d))), "expense_id")
    approved = F.col("status") == "approved"
    return plain(state.groupBy("tenant_id").agg(
        ops.rows().alias("expenses"),
        F.round(100.0 * F.count_if(approved) / ops.rows(), 1).alias("approval_pct"),
        F.sum(F.when(approved, F.coalesce("final_amount", "amount"))).alias("approved_total"),
    ))


QUERIES["tenant_overview"] = flagship
ORACLES["tenant_overview"] = oracle.complete("""
    SELECT tenant_id, count(*) AS expenses, round(100e0 * sum(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) / count(*), 1) AS approval_pct,
           CAST(sum(CASE WHEN status = 'approved' THEN coalesce(final_amount, amount) END) AS DOUBLE) AS approved_total
    FROM cdc_state GROUP BY tenant_id""")
