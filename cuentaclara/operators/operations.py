"""Operational analytics over bronze, silver and gold.

Everything that is relative to "now" takes ``as_of`` (a Column), so results are repeatable;
pass ``F.current_timestamp()`` in production. Top-k reports carry a tie-break so that they
are stable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuentaclara.functions import text
from cuentaclara.functions.text import one_line
from cuentaclara.operators import sketches, skew
from cuentaclara.sources.tables import staged



def rows() -> Column:
    return F.count(F.lit(1))


def days_before(as_of: Column, days: int) -> Column:
    """Midnight ``days`` before the day of ``as_of``."""
    return F.date_trunc("day", as_of) - F.make_dt_interval(F.lit(days))


def _seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Difference with microseconds kept."""
    def micros(c: str | Column) -> Column:
        return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _percent(condition: Column) -> Column:
    return F.round(100.0 * F.count_if(condition) / F.nullif(rows(), F.lit(0)), 1)


# --- counters and ratios ------------------------------------------------------------------


def approval_ratio(expenses: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    recent = expenses.where(F.col("created_at") >= days_before(as_of, days))
    return recent.agg(_percent(F.col("status") == "approved").alias("approval_pct"))


def hitl_pending(hitl: DataFrame) -> DataFrame:
    return hitl.where(F.col("status") == "pending").agg(rows().alias("pending"))


def ocr_low_confidence_count(ocr: DataFrame, as_of: Column, days: int = 7, floor: float = 80) -> DataFrame:
    low = (F.col("avg_confidence") < floor) & (F.col("extracted_at") >= days_before(as_of, days))
    return ocr.where(low).agg(rows().alias("low_conf"))


def _stuck(expenses: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return expenses.where((F.col("status") == "processing") & (F.col("updated_at") < limit))


def stuck_count(expenses: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    return _stuck(expenses, as_of, minutes).agg(rows().alias("stuck"))


def stuck_expenses(expenses: DataFrame, as_of: Column, minutes: int = 10) -> DataFrame:
    """Every stuck expense with how long it has been stuck, longest first."""
    return _stuck(expenses, as_of, minutes).select(
        "expense_id", "tenant_id", "workflow_id", "updated_at",
        F.round(_seconds_between(as_of, "updated_at") / 60, 4).alias("stuck_minutes"),
    ).orderBy(F.col("stuck_minutes").desc(), "expense_id")


def expenses_by_day_status(expenses: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    recent = expenses.where(F.col("created_at") >= days_before(as_of, days))
    return recent.groupBy(F.date_trunc("day", "created_at").alias("day"), "status").agg(rows().alias("n"))


def disputed_fields(hitl: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = hitl.where(F.col("created_at") >= days_before(as_of, days))
    return recent.select(F.explode("discrepancy_fields").alias("field")).groupBy("field").agg(rows().alias("n"))


def expenses_by_status(expenses: DataFrame, tenant: str | None = None) -> DataFrame:
    scope = expenses if tenant is None else expenses.where(F.col("tenant_id") == tenant)
    return scope.groupBy("status").agg(rows().alias("n"), F.sum("amount").alias("total"))


def expenses_per_hour(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(rows().alias("n"))


def amount_by_day_outcome(expenses: DataFrame) -> DataFrame:
    decided = expenses.where(F.col("status").isin("approved", "rejected"))
    return decided.groupBy(F.date_trunc("day", "updated_at").alias("day"), "status").agg(
        F.sum("amount").alias("total")
    )


def _resolved_minutes(hitl: DataFrame) -> DataFrame:
    return hitl.where(F.col("status") == "resolved").select(
        "tenant_id",
        F.date_trunc("day", "created_at").alias("day"),
        _seconds_between("resolved_at", "created_at").alias("seconds"),
        (_seconds_between("resolved_at", "created_at") / 60).alias("minutes"),
        "created_at",
    )


def hitl_resolution_percentiles(hitl: DataFrame, *, exact: bool = False) -> DataFrame:
    """Median and 95th percentile of minutes to resolution per tenant and day.

    Approximate by default, as a dashboard wants it; ``exact`` interpolates exactly without
    ever holding a group in one task.
    """
    durations = _resolved_minutes(hitl)
    keys = ["tenant_id", "day"]
    if exact:
        return skew.exact_percentiles(durations, keys, "minutes", {"p50": 0.5, "p95": 0.95})
    return durations.groupBy(*keys).agg(
        F.percentile_approx("minutes", 0.5).alias("p50"),
        F.percentile_approx("minutes", 0.95).alias("p95"),
        rows().alias("n"),
    )


def hitl_resolution_sketches(hitl: DataFrame) -> DataFrame:
    """Minutes to resolution as one mergeable sketch per tenant and hour, to be stored and rolled up."""
    return sketches.quantile_sketches(_resolved_minutes(hitl), ["tenant_id"], "created_at", "minutes")


def hitl_resolution_from_sketches(hourly: DataFrame) -> DataFrame:
    """Median and 95th percentile per tenant and day, from stored hours alone."""
    days = sketches.rolled_up(hourly, ["tenant_id"], "day").withColumnRenamed("period", "day")
    return sketches.quantiles(days, {"p50": 0.5, "p95": 0.95})


def hitl_resolution_rank_errors(hitl: DataFrame) -> DataFrame:
    """Those percentiles with the measured distance of their ranks from the ones asked for."""
    found = hitl_resolution_from_sketches(hitl_resolution_sketches(hitl))
    return sketches.rank_check(found, _resolved_minutes(hitl), ["tenant_id", "day"], "minutes", {"p50": 0.5, "p95": 0.95})


def hitl_resolution_by_tenant(hitl: DataFrame, as_of: Column, days: int = 7, *, exact: bool = False) -> DataFrame:
    """Count, mean and 95th percentile of seconds to resolution per tenant."""
    start = as_of - F.make_dt_interval(F.lit(days))
    recent = _resolved_minutes(hitl).where(F.col("created_at") >= start)
    if not exact:
        return recent.groupBy("tenant_id").agg(
            rows().alias("n"), F.avg("seconds").alias("avg_sec"),
            F.percentile_approx("seconds", 0.95).alias("p95_sec"),
        )
    means = recent.groupBy("tenant_id").agg(rows().alias("n"), F.avg("seconds").alias("avg_sec"))
    tails = skew.exact_percentiles(recent, ["tenant_id"], "seconds", {"p95_sec": 0.95}).drop("n")
    return means.join(tails, "tenant_id", "left")


def chat_turns_per_day(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.date_trunc("day", "created_at").alias("day")).agg(rows().alias("turns"))


def top_vendors(expenses: DataFrame, as_of: Column, days: int = 30, n: int = 10) -> DataFrame:
    start = as_of - F.make_dt_interval(F.lit(days))
    return (
        expenses.where(F.col("created_at") >= start)
        .groupBy("vendor")
        .agg(rows().alias("n"), F.sum("amount").alias("total"))
        .orderBy(F.col("total").desc(), "vendor")
        .limit(n)
    )


def events_by_type_actor(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "actor_type").agg(rows().alias("n"))


def top_questions(turns: DataFrame, as_of: Column, tenant: str | None = None, hours: int = 24, n: int = 10) -> DataFrame:
    scope = turns.where(F.col("created_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    if tenant is not None:
        scope = scope.where(F.col("tenant_id") == tenant)
    return (
        scope.groupBy("user_message").agg(rows().alias("n"))
        .orderBy(F.col("n").desc(), "user_message").limit(n)
    )


def hitl_by_decision(hitl: DataFrame, tenant: str | None = None) -> DataFrame:
    scope = hitl if tenant is None else hitl.where(F.col("tenant_id") == tenant)
    return scope.groupBy("status", "decision").agg(rows().alias("n"))


def approved_daily(audit: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    recent = audit.where(F.col("approved_at") >= days_before(as_of, days))
    return recent.groupBy("tenant_id").agg(
        rows().alias("approved_count"), F.sum("final_amount").alias("total_approved_amount")
    )


def status_by_tenant(expenses: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    recent = expenses.where(F.col("created_at") >= days_before(as_of, days))
    return recent.groupBy("tenant_id", "status").agg(rows().alias("n"), F.sum("amount").alias("sum_amount"))


def rows_by_tenant_op(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("tenant_id", "__op").agg(rows().alias("n")).withColumnRenamed("__op", "op")


def rows_by_tenant_layer(layers: Mapping[str, DataFrame]) -> DataFrame:
    return _union([
        df.groupBy("tenant_id").agg(rows().alias("n")).withColumn("layer", F.lit(name))
        for name, df in layers.items()
    ])


def tenant_null_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([
        df.agg(F.count_if(F.col("tenant_id").isNull()).alias("null_tenant"), rows().alias("total"))
        .select(F.lit(name).alias("table_name"), "null_tenant", "total")
        for name, df in tables.items()
    ])


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows against rows with a value, per column, in one pass."""
    counts = df.agg(rows().alias("total"), *[F.count(c).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns])
    return counts.select(F.explode(entries).alias("e"), "total").select("e.column_name", "e.filled", "total")


def cdc_lag(bronze: DataFrame, as_of: Column) -> DataFrame:
    newest = F.max("__source_ts_ms")
    return bronze.agg(
        newest.alias("max_source_ts_ms"),
        ((F.unix_millis(as_of) - newest) / F.lit(1000.0)).alias("lag_sec"),
    )


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and order-free sum of 60 bits of each row's MD5; equal tables give equal fingerprints, in any engine."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(rows().alias("n"), F.sum(digest).cast("string").alias("hash_sum"))


def ingest_health(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([
        df.agg(rows().alias("rows"), F.max("_cdc_ingestion_ts").alias("last_ingest"))
        .select(F.lit(name).alias("src"), "rows", "last_ingest")
        for name, df in tables.items()
    ])


def trace_catalog(events: DataFrame, as_of: Column, hours: int = 24, n: int = 200) -> DataFrame:
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    return (
        events.where(F.col("trace_id").isNotNull() & (F.col("created_at") >= start))
        .groupBy("trace_id")
        .agg(
            F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
            rows().alias("event_count"), F.min("expense_id").alias("expense_id"),
        )
        .orderBy(F.col("last_seen").desc(), "trace_id")
        .limit(n)
    )


def audited_totals_by_currency(expenses: DataFrame) -> DataFrame:
    """Approved totals per currency; a missing final value falls back to the reported one."""
    amount = F.coalesce("final_amount", "amount")
    currency = F.upper(F.coalesce("final_currency", "currency"))
    approved = expenses.where(F.col("status") == "approved")
    return approved.select(amount.alias("a"), currency.alias("currency")).where(F.col("a") != 0).groupBy(
        "currency"
    ).agg(F.sum("a").alias("total"))


def ocr_drift_profile(ocr: DataFrame, granularity: str = "1 day") -> DataFrame:
    """Mean confidence and share below 80 per tenant and window, with the alert condition."""
    low = F.when(F.col("avg_confidence") < 80, 1.0).otherwise(0.0)
    return (
        ocr.groupBy("tenant_id", F.window("extracted_at", granularity).alias("w"))
        .agg(F.avg("avg_confidence").alias("_avg"), F.avg(low).alias("_low"), rows().alias("n"))
        .select(
            "tenant_id", F.col("w.start").alias("window_start"),
            F.lit(granularity).alias("granularity"),
            F.round("_avg", 6).alias("avg_ocr_confidence"),
            F.round("_low", 6).alias("pct_low_confidence_records"), "n",
            ((F.col("_avg") < 85) | (F.col("_low") > 0.1)).alias("alert"),
        )
    )


def chunks_per_tenant(chunks: DataFrame, n: int = 5) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(rows().alias("n")).orderBy(F.col("n").desc(), "tenant_id").limit(n)


def time_to_approve(events: DataFrame) -> DataFrame:
    """Mean seconds from creation to approval per tenant."""
    def first_time(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("created_at")))
    spans = (
        events.where(F.col("event_type").isin("created", "approved"))
        .groupBy("tenant_id", "expense_id")
        .agg(first_time("created").alias("c"), first_time("approved").alias("a"))
        .where(F.col("a") >= F.col("c"))
    )
    return spans.groupBy("tenant_id").agg(
        rows().alias("n"), F.round(F.avg(_seconds_between("a", "c")), 3).alias("avg_sec")
    )


def hitl_share_monthly(expenses: DataFrame, hitl: DataFrame) -> DataFrame:
    """Share of expenses per tenant and month that went to review."""
    reviewed = hitl.select("expense_id").distinct().withColumn("_reviewed", F.lit(True))
    return (
        expenses.join(reviewed, "expense_id", "left")
        .groupBy("tenant_id", F.date_trunc("month", "created_at").alias("month"))
        .agg(rows().alias("n"), F.count("_reviewed").alias("reviewed"))
        .withColumn("share", F.round(F.col("reviewed") / F.col("n"), 6))
    )


def hitl_by_actor(hitl: DataFrame) -> DataFrame:
    resolved = hitl.where(F.col("status") == "resolved")
    return resolved.groupBy("resolved_by").agg(rows().alias("n"))


# --- joins across layers ------------------------------------------------------------------


def layer_freshness(bronze: DataFrame, expenses: DataFrame, audit: DataFrame, n: int | None = 50) -> DataFrame:
    """Newest change per expense in each layer and the lags between layers, newest first."""
    b = bronze.groupBy("expense_id").agg(F.max("__source_ts_ms").alias("bronze_ts_ms"))
    s = expenses.select("expense_id", F.col("updated_at").alias("silver_ts"), "status")
    g = audit.select("expense_id", F.col("approved_at").alias("gold_ts"))
    silver_ms, gold_ms = (F.unix_millis(F.col(c).cast("timestamp")) for c in ("silver_ts", "gold_ts"))
    out = b.join(s, "expense_id", "left").join(g, "expense_id", "left").select(
        "expense_id",
        F.timestamp_millis("bronze_ts_ms").alias("bronze_latest"),
        "status", "silver_ts", "gold_ts",
        ((silver_ms - F.col("bronze_ts_ms")) / F.lit(1000.0)).alias("bronze_to_silver_sec"),
        ((gold_ms - silver_ms) / F.lit(1000.0)).alias("silver_to_gold_sec"),
    )
    if n is None:
        return out
    return out.orderBy(F.col("bronze_latest").desc(), "expense_id").limit(n)


def ocr_amount_gap(ocr: DataFrame, expenses: DataFrame, n: int | None = 20, tolerance: float = 0.01) -> DataFrame:
    """Expenses whose OCR total is off by more than ``tolerance`` of the reported amount."""
    base = F.when(F.col("amount") > 0, F.col("amount").cast("double")).otherwise(1.0)
    gap = F.abs((F.col("ocr_total") - F.col("amount")).cast("double") / base)
    out = ocr.select("expense_id", "ocr_total", "avg_confidence", "extracted_at").join(
        expenses.select("expense_id", "amount"), "expense_id"
    ).withColumn("diff_pct", gap).where(F.col("diff_pct") > tolerance).select(
        "expense_id", "ocr_total", F.col("amount").alias("user_amount"), "diff_pct",
        "avg_confidence", "extracted_at",
    )
    return out if n is None else out.orderBy(F.col("extracted_at").desc(), "expense_id").limit(n)


def never_reached_ocr(events: DataFrame) -> DataFrame:
    """Expenses that were created but never started OCR, from one pass over the timeline."""
    def seen(kind: str) -> Column:
        return F.max(F.col("event_type") == kind)
    return (
        events.groupBy("expense_id")
        .agg(seen("created").alias("created"), seen("ocr_started").alias("ocr"))
        .where("created AND NOT ocr").select("expense_id")
    )


def expense_receipts(expenses: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipt of each expense, only within the same tenant."""
    return expenses.select("expense_id", "receipt_id", "tenant_id").join(
        receipts.select("receipt_id", "tenant_id", "s3_key", "content_type", "size_bytes", "uploaded_at"),
        ["receipt_id", "tenant_id"],
    )


def workflow_owner(workflows: DataFrame, expenses: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tenant of each workflow: through its expense, else through the chat session in its name."""
    by_expense = expenses.where(F.col("workflow_id").isNotNull()).groupBy("workflow_id").agg(
        F.min("tenant_id").alias("_expense_tenant")
    )
    by_session = sessions.groupBy("session_id").agg(F.min("tenant_id").alias("_session_tenant"))
    session_id = F.when(
        F.col("workflow_id").startswith("rag-"), F.try_element_at(F.split("workflow_id", "-"), F.lit(2))
    )
    return (
        workflows.withColumn("session_id", session_id)
        .join(by_expense, "workflow_id", "left")
        .join(by_session, "session_id", "left")
        .select("workflow_id", F.coalesce("_expense_tenant", "_session_tenant").alias("tenant_id"))
    )


def layer_reconcile(layers: Mapping[str, DataFrame], key: str = "expense_id") -> DataFrame:
    return _union([
        df.agg(F.countDistinct(key).alias("keys")).select(F.lit(name).alias("layer"), "keys")
        for name, df in layers.items()
    ])


def missing_downstream(upstream: DataFrame, downstream: DataFrame, key: str = "expense_id") -> DataFrame:
    """Keys of the earlier layer that the later one lacks."""
    return upstream.select(key).distinct().join(downstream, key, "left_anti")


# --- runs of the scheduled jobs -----------------------------------------------------------


def _runs_of(runs: DataFrame, jobs: DataFrame, name_like: str) -> DataFrame:
    named = jobs.where(F.col("name").like(name_like)).select("pipeline_id", "name")
    return runs.join(named, "pipeline_id")


def run_failures(runs: DataFrame, jobs: DataFrame, as_of: Column, name_like: str = "%", hours: int = 24) -> DataFrame:
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    failed = (F.col("result_state") == "FAILED") & (F.col("period_start_time") >= start)
    return _runs_of(runs.where(failed), jobs, name_like).agg(rows().alias("failed"))


def run_success_rate(runs: DataFrame, jobs: DataFrame, as_of: Column, name_like: str = "%", days: int = 7) -> DataFrame:
    start = as_of - F.make_dt_interval(F.lit(days))
    recent = _runs_of(runs.where(F.col("period_start_time") >= start), jobs, name_like)
    return recent.agg(_percent(F.col("result_state") == "COMPLETED").alias("pct"))


def layer_of(name: Column) -> Column:
    layer = F.lit("other")
    for known in ("gold", "silver", "bronze"):
        layer = F.when(name.contains(known), F.lit(known)).otherwise(layer)
    return layer


def runs_hourly(runs: DataFrame, jobs: DataFrame, as_of: Column, name_like: str = "%", hours: int = 24) -> DataFrame:
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    recent = _runs_of(runs.where(F.col("period_start_time") >= start), jobs, name_like)
    return recent.groupBy(
        F.date_trunc("hour", "period_start_time").alias("hour"), layer_of(F.col("name")).alias("layer"), "result_state"
    ).agg(rows().alias("n"))


def last_runs(runs: DataFrame, jobs: DataFrame, name_like: str = "%", n: int = 30) -> DataFrame:
    seconds = F.unix_seconds(F.col("period_end_time").cast("timestamp")) - F.unix_seconds(
        F.col("period_start_time").cast("timestamp")
    )
    return (
        _runs_of(runs, jobs, name_like)
        .orderBy(F.col("period_start_time").desc(), "update_id")
        .limit(n)
        .select(F.col("name").alias("pipeline"), "update_id", "result_state", "period_start_time",
                "period_end_time", seconds.alias("duration_sec"))
    )


def run_errors(logs: Mapping[str, DataFrame], n: int = 15) -> DataFrame:
    """Newest errors over several event logs, messages on one line."""
    parts = [
        df.where(F.col("level") == "ERROR").select(
            F.lit(name).alias("pipeline"), "timestamp", "event_type", "message"
        )
        for name, df in logs.items()
    ]
    # The report is cut to n rows before messages are rewritten.
    newest = _union(parts).orderBy(F.col("timestamp").desc(), "pipeline", "event_type", "message").limit(n)
    return newest.withColumn("message", one_line(F.col("message")))


# --- presence and funnel ------------------------------------------------------------------


def show_all_or_one(expense_id: str = "__none__") -> Column:
    """Dashboard parameter: the sentinel shows everything, an id only itself."""
    chosen = F.lit(expense_id)
    return (chosen == "__none__") | (F.col("expense_id") == chosen)


def presence(layers: Mapping[str, DataFrame], expense_id: str = "__none__") -> DataFrame:
    """Row counts of one expense (or of all) per layer, in pipeline order."""
    return _union([
        df.where(show_all_or_one(expense_id)).agg(rows().alias("row_count")).select(
            F.lit(name).alias("layer"), "row_count", F.lit(i).cast("bigint").alias("sort_order")
        )
        for i, (name, df) in enumerate(layers.items(), 1)
    ]).orderBy("sort_order")


def layer_funnel(layers: Mapping[str, DataFrame]) -> DataFrame:
    return presence(layers).withColumnRenamed("row_count", "n")


#: Views of one expense per layer, as (columns, order column, newest first).
TRACE_VIEWS: dict[str, tuple[tuple[str, ...], str | None, bool]] = {
    "silver_expense": ((
        "expense_id", "tenant_id", "user_id", "receipt_id", "workflow_id", "status", "amount", "currency",
        "vendor", "date", "category", "final_amount", "final_currency", "final_vendor", "final_date",
        "approved_at", "created_at", "updated_at"), None, False),
    "silver_timeline": (("created_at", "event_type", "actor", "workflow_id", "event_id"), "created_at", False),
    "silver_ocr": ((
        "expense_id", "tenant_id", "user_id", "ocr_total", "ocr_total_confidence", "ocr_vendor",
        "ocr_vendor_confidence", "ocr_date", "ocr_date_confidence", "ocr_currency", "avg_confidence",
        "textract_raw_s3_key", "extracted_at"), None, False),
    "silver_hitl": ((
        "task_id", "status", "decision", "resolved_by", "resolved_at", "created_at", "workflow_id",
        "discrepancy_fields", "resolved_fields"), "created_at", True),
    "gold_audit": ((
        "tenant_id", "expense_id", "user_id", "receipt_id", "final_amount", "final_currency", "final_vendor",
        "final_date", "category", "approved_at", "had_hitl", "hitl_decision", "hitl_resolved_by",
        "hitl_resolved_at"), None, False),
    "bronze_expense": ((
        "__source_ts_ms", "__op", "__deleted", "status", "amount", "currency", "vendor", "date",
        "final_amount", "final_vendor", "final_date", "created_at", "updated_at", "_cdc_ingestion_ts"),
        "__source_ts_ms", False),
    "bronze_receipt": ((
        "__source_ts_ms", "__op", "receipt_id", "s3_key", "content_type", "size_bytes", "uploaded_at"),
        "__source_ts_ms", False),
    "bronze_events": ((
        "__source_ts_ms", "__op", "event_type", "actor", "workflow_id", "event_id", "created_at"),
        "__source_ts_ms", False),
    "bronze_ocr": ((
        "__source_ts_ms", "__op", "ocr_total", "ocr_vendor", "ocr_date", "ocr_currency", "avg_confidence",
        "textract_raw_s3_key", "extracted_at"), "__source_ts_ms", False),
    "bronze_hitl": ((
        "__source_ts_ms", "__op", "task_id", "status", "decision", "resolved_by", "resolved_at", "created_at",
        "workflow_id"), "__source_ts_ms", False),
}


def trace_view(view: str, table: DataFrame, expense_id: str = "__none__") -> DataFrame:
    columns, order, newest_first = TRACE_VIEWS[view]
    found = table.where(show_all_or_one(expense_id)).select(*columns)
    if order is None:
        return found
    # A sort over all tasks looks at its rows twice, first for the ranges; staged, they are decoded or folded once.
    return staged(found, "trace-view").orderBy(F.col(order).desc() if newest_first else F.col(order).asc())


# --- windows ------------------------------------------------------------------------------


def breadcrumb(events: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Timeline with seconds since the previous event of the same expense (NULL for the first).

    With a trace id only that trace's events are looked at, before the window. Without one the
    whole table is processed.
    """
    scope = events if trace_id is None else events.where(F.col("trace_id") == trace_id)
    chained = skew.neighbour(scope, ["expense_id"], "created_at", ["event_id"], "created_at", "_prev")
    seconds = F.unix_seconds(F.col("created_at").cast("timestamp")) - F.unix_seconds(F.col("_prev").cast("timestamp"))
    return chained.select(
        "created_at", "event_type", "actor_type", "actor_id", "workflow_id", "expense_id", "event_id",
        seconds.alias("stage_duration_sec"),
    )


def stage_durations(events: DataFrame) -> DataFrame:
    """Whole seconds elapsed between consecutive events (fractions count towards the interval)."""
    chained = skew.neighbour(events, ["expense_id"], "created_at", ["event_id"], "created_at", "_prev")
    return chained.select(
        "expense_id", "event_id", "event_type",
        F.timestamp_diff("SECOND", F.col("_prev"), F.col("created_at")).alias("stage_sec"),
    )


BUFFER_CAP = 50


def channel_events(events: DataFrame) -> DataFrame:
    """Every event on its user channel and its workflow channel, where it has one."""
    def channel(kind: str, who: str) -> Column:
        known = F.col(who).isNotNull()
        return F.when(known, F.concat_ws(":", F.lit("tenant"), "tenant_id", F.lit(kind), who))
    channels = F.filter(F.array(channel("user", "user_id"), channel("workflow", "workflow_id")), lambda c: c.isNotNull())
    return events.withColumn("channel", F.explode(channels))


def channel_replay_buffer(
    events: DataFrame, as_of: Column, cap: int = BUFFER_CAP, ttl_seconds: int = 3600, after_ms: Column | None = None
) -> DataFrame:
    """Newest ``cap`` events per channel. A channel idle for longer than the time to live is empty;
    with ``after_ms`` only events strictly later are replayed."""
    fanned = channel_events(events)
    alive = (
        fanned.groupBy("channel").agg(F.max("created_at").alias("_last"))
        .where(F.col("_last") >= as_of - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))
        .select("channel")
    )
    newest = skew.top_per_key(
        fanned, ["channel"], [F.col("created_at").desc(), F.col("event_id").desc()], cap, "buffer_pos"
    ).join(alive, "channel", "left_semi")
    if after_ms is not None:
        newest = newest.where(F.unix_millis(F.col("created_at").cast("timestamp")) > after_ms)
    return newest


def replay_after_event(
    events: DataFrame, requests: DataFrame, as_of: Column, cap: int = BUFFER_CAP, ttl_seconds: int = 3600
) -> DataFrame:
    """What each returning client missed: held events of its channel strictly later than the time in ``last_event_id``.

    ``requests`` has channel, client_id and last_event_id; an identifier that cannot be read gets all held events, a null one
    none. At most ``cap`` rows per request, oldest first by ``position``.
    """
    asked = requests.where(F.col("last_event_id").isNotNull()).select(
        "channel", "client_id", "last_event_id", text.after_millis(F.col("last_event_id")).alias("_after"))
    held = channel_replay_buffer(events, as_of, cap, ttl_seconds).select("channel", "event_id", "created_at")
    missed = held.join(asked, "channel").where(F.unix_millis(F.col("created_at").cast("timestamp")) > F.col("_after")).drop("_after")
    place = Window.partitionBy("channel", "client_id", "last_event_id").orderBy("created_at", "event_id")
    return missed.withColumn("position", F.row_number().over(place) - 1)


def current_step(step_events: DataFrame) -> DataFrame:
    """Latest step per expense. Expects expense_id, event_id, step, created_at."""
    latest = F.max_by("step", F.struct("created_at", "event_id")).alias("step")
    known = F.col("step").isNotNull() & F.col("expense_id").isNotNull()
    return step_events.where(known).groupBy("expense_id").agg(latest)


def chat_history(turns: DataFrame, max_turns: int = 10) -> DataFrame:
    """The first ``max_turns`` turns per session as user and assistant messages; an unanswered turn is a user message alone."""
    kept = skew.top_per_key(turns, ["session_id", "tenant_id"], [F.col("turn")], max_turns, "_rn")
    def said(role: str, column: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(column).alias("content"))
    pair = F.array(said("user", "user_message"), said("assistant", "assistant_message"))
    gathered = kept.groupBy("session_id", "tenant_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", pair.alias("pair")))).alias("_turns")
    )
    return gathered.select(
        "session_id", "tenant_id", F.filter(F.flatten(F.transform("_turns", lambda t: t["pair"])), lambda m: m["content"].isNotNull()).alias("messages")
    )


# --- lists and pages ----------------------------------------------------------------------


def expenses_page(
    expenses: DataFrame, tenant: str, *, status: str | None = None, date_from: str | None = None,
    date_to: str | None = None, cursor: str | None = None, limit: int = 50,
) -> DataFrame:
    """One keyset page, ids descending; ``has_more`` tells whether another page follows."""
    page = expenses.where(F.col("tenant_id") == tenant)
    if status:
        page = page.where(F.col("status") == status)
    if date_from:
        page = page.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        page = page.where(F.col("date") <= F.lit(date_to).cast("date"))
    if cursor:
        page = page.where(F.col("expense_id") < cursor)
    ahead = page.orderBy(F.col("expense_id").desc()).limit(limit + 1)
    # The window sees at most limit + 1 rows.
    fetched = rows().over(Window.partitionBy(F.lit(1)))
    return ahead.withColumn("has_more", fetched > limit).orderBy(F.col("expense_id").desc()).limit(limit)


def newest(df: DataFrame, order: str, n: int, tiebreak: str, condition: Column | None = None) -> DataFrame:
    scope = df if condition is None else df.where(condition)
    return scope.orderBy(F.col(order).desc(), tiebreak).limit(n)


def oldest(df: DataFrame, order: str, n: int, tiebreak: str, condition: Column | None = None) -> DataFrame:
    scope = df if condition is None else df.where(condition)
    return scope.orderBy(F.col(order).asc(), tiebreak).limit(n)


def hitl_list(hitl: DataFrame, tenant: str, status: str | None = None, expense_id: str | None = None, n: int = 50) -> DataFrame:
    scope = hitl.where(F.col("tenant_id") == tenant)
    if status:
        scope = scope.where(F.col("status") == status)
    if expense_id:
        scope = scope.where(F.col("expense_id") == expense_id)
    return newest(scope, "created_at", n, "task_id")


def pending_tasks(hitl: DataFrame) -> DataFrame:
    return hitl.where(F.col("status") == "pending").orderBy("created_at", "task_id")


def expense_timeline(events: DataFrame, expense_id: str, tenant: str, n: int = 200) -> DataFrame:
    mine = (F.col("expense_id") == expense_id) & (F.col("tenant_id") == tenant)
    return oldest(events, "created_at", n, "event_id", mine)


def session_turns(turns: DataFrame, session_id: str, tenant: str, n: int = 200) -> DataFrame:
    mine = (F.col("session_id") == session_id) & (F.col("tenant_id") == tenant)
    return turns.where(mine).orderBy("turn").limit(n)


def latest_expenses(expenses: DataFrame, n: int = 20) -> DataFrame:
    return newest(expenses, "created_at", n, "expense_id").select(
        "expense_id", "tenant_id", "status", "amount", "currency", "vendor", "created_at", "updated_at"
    )


def expense_id_options(expenses: DataFrame, n: int = 500) -> DataFrame:
    seen = expenses.groupBy("expense_id").agg(F.max("created_at").alias("last_seen"))
    return newest(seen, "last_seen", n, "expense_id")


def ocr_low_confidence(ocr: DataFrame, n: int = 50, floor: float = 80) -> DataFrame:
    return newest(ocr, "extracted_at", n, "expense_id", F.col("avg_confidence") < floor).select(
        "expense_id", "tenant_id", "avg_confidence", "ocr_total", "ocr_vendor", "ocr_date", "extracted_at"
    )


def tenant_chunks(chunks: DataFrame, tenant: str, n: int = 10) -> DataFrame:
    return newest(chunks, "approved_at", n, "chunk_id", F.col("tenant_id") == tenant)


def recent_receipts(receipts: DataFrame, tenant: str, user_id: str, n: int = 20) -> DataFrame:
    mine = (F.col("tenant_id") == tenant) & (F.col("user_id") == user_id)
    return newest(receipts, "uploaded_at", n, "receipt_id", mine).select("receipt_id", "expense_id", "uploaded_at")


def recent_expenses_of_tenant(expenses: DataFrame, tenant: str, n: int = 10) -> DataFrame:
    return newest(expenses, "created_at", n, "expense_id", F.col("tenant_id") == tenant).select(
        "expense_id", "status", "amount", "vendor", "date", "workflow_id", "created_at"
    )


def recent_sessions(sessions: DataFrame, tenant: str, user_id: str, n: int = 10) -> DataFrame:
    mine = (F.col("tenant_id") == tenant) & (F.col("user_id") == user_id)
    return newest(sessions, "created_at", n, "session_id", mine).select("session_id", "created_at", "last_turn")


def in_flight(expenses: DataFrame, n: int | None = None) -> DataFrame:
    """Pending and processing expenses, newest first."""
    open_rows = expenses.where(F.col("status").isin("pending", "processing")).orderBy(
        F.col("created_at").desc(), "expense_id"
    )
    return open_rows if n is None else open_rows.limit(n)
