"""Structured search over audited expenses: validated request -> Column predicates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a request may ask for.
CATEGORIES = ("travel", "food", "lodging", "office", "other")
CURRENCIES = ("COP", "USD", "EUR")
AGGREGATES = ("sum", "count", "list")
DEFAULT_LIMIT = 20
MAX_LIMIT = 50
SAMPLE_LIMIT = 10


class InvalidSearch(ValueError):
    """The request has no filter, or a value outside the allowed ones."""


@dataclass(frozen=True)
class SearchRequest:
    tenant: str
    predicates: tuple[Column, ...]
    aggregate: str
    limit: int


def _allowed(value: str, options: tuple[str, ...], what: str) -> str:
    if value not in options:
        raise InvalidSearch(f"invalid {what}: {value}")
    return value


def parse_request(request: Mapping[str, Any], tenant: str) -> SearchRequest:
    """Validate a request. The tenant comes from the caller only; any tenant named inside the
    request is never read."""
    if not tenant:
        raise InvalidSearch("a tenant is required")
    predicates: list[Column] = []

    if request.get("vendor"):
        fragment = str(request["vendor"]).strip().lower()
        # % and _ in the fragment keep their LIKE meaning.
        predicates.append(F.lower("final_vendor").like(f"%{fragment}%"))
    if request.get("category"):
        category = _allowed(str(request["category"]).strip().lower(), CATEGORIES, "category")
        predicates.append(F.lower("category") == category)
    for bound, compare in (("min", Column.__ge__), ("max", Column.__le__)):
        if request.get(f"amount_{bound}") is not None:
            try:
                amount = float(request[f"amount_{bound}"])
            except (TypeError, ValueError) as exc:
                raise InvalidSearch(f"invalid amount_{bound}") from exc
            predicates.append(compare(F.col("final_amount"), F.lit(amount)))
    for bound, compare in (("from", Column.__ge__), ("to", Column.__le__)):
        if request.get(f"date_{bound}"):
            try:
                day = F.lit(date.fromisoformat(str(request[f"date_{bound}"]).strip()[:10]))
            except ValueError as exc:
                raise InvalidSearch(f"invalid date_{bound}") from exc
            predicates.append(compare(F.col("final_date"), day))
    if request.get("currency"):
        currency = _allowed(str(request["currency"]).strip().upper(), CURRENCIES, "currency")
        predicates.append(F.col("final_currency") == currency)
    if not predicates:
        raise InvalidSearch("at least one filter is required")

    aggregate = _allowed(str(request.get("aggregate") or "list").lower(), AGGREGATES, "aggregate")
    try:
        limit = int(request.get("limit", DEFAULT_LIMIT))
    except (TypeError, ValueError) as exc:
        raise InvalidSearch(f"invalid limit: {request.get('limit')}") from exc
    return SearchRequest(tenant, tuple(predicates), aggregate, max(1, min(limit, MAX_LIMIT)))


def matching(audit: DataFrame, request: SearchRequest) -> DataFrame:
    rows = audit.where(F.col("tenant_id") == request.tenant)
    for predicate in request.predicates:
        rows = rows.where(predicate)
    return rows


def listing(audit: DataFrame, request: SearchRequest, limit: int | None = None) -> DataFrame:
    """Newest matches in the shape citations use."""
    return (
        matching(audit, request)
        .orderBy(F.col("final_date").desc(), "expense_id")
        .limit(limit or request.limit)
        .where(F.coalesce(F.col("expense_id"), F.lit("")) != "")
        .select(
            "expense_id",
            F.col("final_vendor").alias("vendor"),
            F.col("final_amount").cast("double").alias("amount"),
            F.col("final_currency").alias("currency"),
            F.col("final_date").cast("string").alias("date"),
            "category",
            F.concat(F.lit("/expenses/"), "expense_id").alias("link"),
            F.lit("sql").alias("_source"),
        )
    )


def total(audit: DataFrame, request: SearchRequest) -> DataFrame:
    """Sum, a currency and the row count; an empty match sums to 0.0."""
    return matching(audit, request).agg(
        F.coalesce(F.sum("final_amount").cast("double"), F.lit(0.0)).alias("aggregate_value"),
        F.min("final_currency").alias("currency"),
        F.count(F.lit(1)).alias("row_count_total"),
    )


def total_by_currency(audit: DataFrame, request: SearchRequest) -> DataFrame:
    """The sum kept apart per currency."""
    return matching(audit, request).groupBy(F.col("final_currency").alias("currency")).agg(
        F.sum("final_amount").cast("double").alias("aggregate_value"),
        F.count(F.lit(1)).alias("row_count_total"),
    )


def count(audit: DataFrame, request: SearchRequest) -> DataFrame:
    n = F.count(F.lit(1))
    return matching(audit, request).agg(n.alias("aggregate_value"), n.alias("row_count_total"))


def search(audit: DataFrame, request: Mapping[str, Any], tenant: str) -> dict[str, Any]:
    """Run a request. Returns lazy frames: ``summary`` (None for a list) and ``rows``, the
    matches of a list or the small sample that goes with an aggregate.
    An invalid request gives ``{"error": text}``."""
    try:
        parsed = parse_request(request, tenant)
    except InvalidSearch as problem:
        return {"error": str(problem)}
    if parsed.aggregate == "list":
        return {"aggregate_kind": "list", "summary": None, "rows": listing(audit, parsed)}
    summary = total(audit, parsed) if parsed.aggregate == "sum" else count(audit, parsed)
    return {
        "aggregate_kind": parsed.aggregate,
        "summary": summary,
        "rows": listing(audit, parsed, SAMPLE_LIMIT),
    }


def point_lookup(table: DataFrame, expense_id: str, tenant: str) -> DataFrame:
    """One expense of one tenant, dates rendered as text."""
    found = table.where((F.col("tenant_id") == tenant) & (F.col("expense_id") == expense_id))
    dates = [f.name for f in table.schema.fields if f.dataType.typeName() == "date"]
    return found.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else found
