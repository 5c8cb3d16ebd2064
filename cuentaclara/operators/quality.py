"""Row expectations in three strengths (warn, drop, fail) and their violation report.

A rule whose predicate evaluates to NULL counts as violated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cuentaclara.schemas import EXPENSE_STATUSES

Rules = Mapping[str, str]

_STATUS_LIST = ", ".join(f"'{s}'" for s in EXPENSE_STATUSES)

EXPENSE_WARN: Rules = {
    "valid_amount": "amount IS NULL OR (amount > 0 AND amount < 1e9)",
    "valid_tenant": "tenant_id IS NOT NULL",
}
EXPENSE_DROP: Rules = {"valid_status": f"status IN ({_STATUS_LIST})"}
EXPENSE_FAIL: Rules = {"pk_present": "expense_id IS NOT NULL"}
EXPENSE_STRICT: Rules = {
    "valid_currency": "currency RLIKE '^[A-Z]{3}$'",
    "tenant_prefix": "tenant_id IS NOT NULL AND tenant_id RLIKE '^t_'",
}
OCR_WARN: Rules = {
    "valid_confidence": "avg_confidence IS NULL OR avg_confidence BETWEEN 0 AND 100",
    "has_signal": "ocr_total IS NOT NULL OR ocr_vendor IS NOT NULL",
}
NEW_EXPENSE: Rules = {
    "positive_amount": "amount > 0",
    "currency_length": "length(currency) = 3",
    "vendor_length": "length(vendor) BETWEEN 1 AND 200",
    "category_length": "length(category) BETWEEN 1 AND 80",
}


def holds(predicate: str) -> Column:
    return F.coalesce(F.expr(predicate), F.lit(False))


def _violations(rules: Rules) -> list[Column]:
    return [F.count_if(~holds(p)).alias(name) for name, p in rules.items()]


def warn(df: DataFrame, rules: Rules, observation: Observation | str) -> DataFrame:
    """Keep every row; violation counts arrive with the observation once an action runs."""
    total = F.count(F.lit(1)).alias("total_rows")
    return df.observe(observation, total, *_violations(rules))


def flag(df: DataFrame, rules: Rules) -> DataFrame:
    """Keep every row with a boolean ``ok_<rule>`` column per rule."""
    return df.withColumns({f"ok_{name}": holds(p) for name, p in rules.items()})


def drop_invalid(df: DataFrame, rules: Rules) -> DataFrame:
    for predicate in rules.values():
        df = df.where(holds(predicate))
    return df


def fail_invalid(df: DataFrame, rules: Rules) -> DataFrame:
    """Abort the job on the first row that breaks a rule."""
    for name, predicate in rules.items():
        guard = F.when(holds(predicate), F.lit(True)).otherwise(
            F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")
        )
        df = df.where(guard)
    return df


def violation_report(df: DataFrame, table: str, rules: Rules) -> DataFrame:
    """(table, expectation, failed, total), all rules counted in a single pass."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *_violations(rules))
    entries = F.array(
        *[F.struct(F.lit(n).alias("expectation"), F.col(n).alias("failed")) for n in rules]
    )
    return counts.select(F.explode(entries).alias("e"), "total").select(
        F.lit(table).alias("table_name"), "e.expectation", "e.failed", "total"
    )
