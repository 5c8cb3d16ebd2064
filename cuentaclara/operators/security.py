"""Tenant guard and masks every read path goes through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuentaclara.functions.text import mask_email


@dataclass(frozen=True)
class Caller:
    """Who reads: an administrator, the application acting for one tenant, or anybody else."""

    tenant_id: str | None = None
    is_admin: bool = False


def visible(df: DataFrame, caller: Caller) -> DataFrame:
    """Administrators see all rows, a tenant its own, everybody else none."""
    if caller.is_admin:
        return df
    if not caller.tenant_id:
        return df.where(F.lit(False))
    return df.where(F.col("tenant_id") == caller.tenant_id)


def masked(df: DataFrame, caller: Caller, *email_columns: str) -> DataFrame:
    return df.withColumns({c: mask_email(F.col(c), caller.is_admin) for c in email_columns})
