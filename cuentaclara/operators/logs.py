"""Analytics over structured service logs and model-call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.operators import skew

#: Price per input and per output token.
INPUT_PRICE = 0.0000008
OUTPUT_PRICE = 0.0000032


def _n() -> Column:
    return F.count(F.lit(1))


def traces(logs: DataFrame, n: int = 30) -> DataFrame:
    """Newest traces with event count, time span and number of services."""
    known = F.coalesce(F.col("trace_id"), F.lit("")) != ""
    return (
        logs.where(known).groupBy("trace_id")
        .agg(_n().alias("events"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"),
             F.countDistinct("stream").alias("services"))
        .orderBy(F.col("ended").desc(), "trace_id").limit(n)
    )


def recent_requests(logs: DataFrame, n: int = 30) -> DataFrame:
    done = logs.where(F.col("event") == "request.completed")
    return done.orderBy(F.col("timestamp").desc(), "request_id").limit(n).select(
        "timestamp", "request_id", "trace_id", "method", "path", "status_code", "elapsed_ms"
    )


def component_chain(logs: DataFrame, trace_id: str | None = None, request_id: str | None = None, n: int = 500) -> DataFrame:
    """What ran for one trace or request, oldest first."""
    mine = (F.col("trace_id") == F.lit(trace_id)) | (F.col("request_id") == F.lit(request_id))
    return logs.where(mine).orderBy("timestamp", "request_id").limit(n)


def component_time(logs: DataFrame, trace_id: str | None = None, n: int = 30) -> DataFrame:
    """Summed milliseconds per tool or event."""
    scope = logs if trace_id is None else logs.where(F.col("trace_id") == trace_id)
    return (
        scope.select(F.coalesce("tool", "event").alias("component"), F.coalesce("latency_ms", "elapsed_ms").alias("ms"))
        .where(F.col("ms").isNotNull())
        .groupBy("component").agg(F.sum("ms").alias("total_ms"), _n().alias("times"))
        .orderBy(F.col("total_ms").desc(), "component").limit(n)
    )


def tool_outcomes(logs: DataFrame, trace_id: str | None = None) -> DataFrame:
    scope = logs if trace_id is None else logs.where(F.col("trace_id") == trace_id)
    return scope.where(F.col("tool").isNotNull()).groupBy("tool", "outcome").agg(_n().alias("times"))


def latency_profile(logs: DataFrame, period: str = "1 hour", *, exact: bool = False) -> DataFrame:
    """p50, p95, p99 of request latency per service and period."""
    timed = logs.where(F.col("elapsed_ms").isNotNull()).select(
        "service", F.window("timestamp", period)["start"].alias("period_start"), "elapsed_ms"
    )
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    if exact:
        return skew.exact_percentiles(timed, ["service", "period_start"], "elapsed_ms", wanted)
    return timed.groupBy("service", "period_start").agg(
        *[F.percentile_approx("elapsed_ms", p).alias(name) for name, p in wanted.items()], _n().alias("n")
    )


def error_rate(logs: DataFrame, period: str = "1 hour") -> DataFrame:
    """Client-error and fault rates per service and period."""
    code = F.col("status_code")
    def share(hit: Column) -> Column:
        return F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6)
    return logs.where(code.isNotNull()).groupBy(
        "service", F.window("timestamp", period)["start"].alias("period_start")
    ).agg(
        share((code >= 400) & (code < 500)).alias("error_rate"), share(code >= 500).alias("fault_rate"), _n().alias("n")
    )


def recent_errors(logs: DataFrame, as_of: Column, hours: int = 24, n: int = 50) -> DataFrame:
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    bad = F.col("level").isin("error", "exception") & (F.col("timestamp") >= start)
    return logs.where(bad).orderBy(F.col("timestamp").desc(), "request_id").limit(n).select(
        "timestamp", "trace_id", "request_id", "workflow_id", "level", "event", "error", "msg"
    )


def error_patterns(logs: DataFrame, pattern: str) -> DataFrame:
    """How often each text matching ``pattern`` occurs."""
    found = logs.select(F.regexp_extract("msg", pattern, 0).alias("pattern")).where(F.col("pattern") != "")
    return found.groupBy("pattern").agg(_n().alias("times"))


def restarts_per_hour(logs: DataFrame, marker: str, limit: int = 3) -> DataFrame:
    """Start-up markers per hour; more than ``limit`` means a crash loop."""
    hits = logs.where(F.col("msg").contains(marker))
    return hits.groupBy(F.window("timestamp", "1 hour")["start"].alias("hour")).agg(_n().alias("restarts")).withColumn(
        "crash_loop", F.col("restarts") > limit
    )


def counters(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(_n().alias("total"))


# --- model calls --------------------------------------------------------------------------


def model_decisions(calls: DataFrame) -> DataFrame:
    """One record per model call: tools chosen with their argument names, text size, tokens.

    ``content`` is array<struct<text, tool_name, tool_input map>>; a block is a tool use when it
    has a tool name, else text.
    """
    uses = F.filter("content", lambda b: b["tool_name"].isNotNull())
    texts = F.filter("content", lambda b: b["tool_name"].isNull() & b["text"].isNotNull())
    emitted = F.transform(
        uses,
        lambda b: F.struct(
            b["tool_name"].alias("name"),
            F.coalesce(F.array_sort(F.map_keys(b["tool_input"])), F.array().cast("array<string>")).alias("input_keys"),
        ),
    )
    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    return calls.select(
        *[c for c in calls.columns if c not in ("content", "input_tokens", "output_tokens", "total_tokens", "latency_ms")],
        emitted.alias("tools_emitted"),
        F.size(uses).alias("tools_emitted_count"),
        F.size(texts).alias("text_blocks"),
        F.aggregate(texts, F.lit(0), lambda acc, b: acc + F.length(b["text"])).alias("text_chars"),
        tokens("input_tokens"), tokens("output_tokens"), tokens("total_tokens"),
        F.bround("latency_ms", 2).alias("latency_ms"),
    )


def recent_calls(calls: DataFrame, trace_id: str | None = None, n: int = 50) -> DataFrame:
    """Newest calls, or the calls of one trace in order."""
    if trace_id is None:
        return calls.orderBy(F.col("timestamp").desc(), "workflow_id").limit(n)
    return calls.where(F.col("trace_id") == trace_id).orderBy("timestamp", "workflow_id").limit(n)


#: How a logged tool list is read.
_TOOL_NAME = r'"name":"([^"]+)"'
_TOOL_KEYS = r'"name":"([^"]+)","input_keys":\[([^\]]*)\]'


def tools_chosen(calls: DataFrame) -> DataFrame:
    """First tool named in each logged call, counted. ``tools_emitted`` is JSON text."""
    used = calls.where(F.col("tools_emitted_count") > 0)
    return used.groupBy(F.regexp_extract("tools_emitted", _TOOL_NAME, 1).alias("tool_name")).agg(_n().alias("times"))


def stop_reasons(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stop_reason").agg(_n().alias("times"))


def turns_per_workflow(calls: DataFrame, n: int = 20) -> DataFrame:
    return calls.groupBy("workflow_id").agg(_n().alias("turns")).orderBy(F.col("turns").desc(), "workflow_id").limit(n)


def tool_input_keys(calls: DataFrame, n: int = 20) -> DataFrame:
    used = calls.where(F.col("tools_emitted_count") > 0)
    return (
        used.groupBy(
            F.regexp_extract("tools_emitted", _TOOL_KEYS, 1).alias("tool"),
            F.regexp_extract("tools_emitted", _TOOL_KEYS, 2).alias("keys"),
        ).agg(_n().alias("times"))
        .orderBy(F.col("times").desc(), "tool", "keys").limit(n)
    )


def hourly_cost(calls: DataFrame) -> DataFrame:
    """Token sums and their price per hour."""
    return (
        calls.groupBy(F.window("timestamp", "1 hour")["start"].alias("hour"))
        .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
        .withColumns({
            "input_cost": F.round(F.col("input_tokens") * INPUT_PRICE, 8),
            "output_cost": F.round(F.col("output_tokens") * OUTPUT_PRICE, 8),
            "total_cost": F.round(F.col("input_tokens") * INPUT_PRICE + F.col("output_tokens") * OUTPUT_PRICE, 8),
        })
    )
