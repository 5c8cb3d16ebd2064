"""Keyed change application: current state (SCD1) and history (SCD2) from a change log.

The sequence decides, never the arrival order, so replays, duplicates and late
events give the same state. Deletes are kept as tombstones until the visible view
is taken, which stops a late update from reviving a deleted key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.operators import skew

DELETE = "_op = 'd'"


def fold_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, tombstones included.

    Each map task keeps one row per key before the shuffle (WindowGroupLimit), so a key with
    a third of all changes costs one row per task; columns nobody reads are pruned below it.
    """
    newest = [F.col(c).desc() for c in order]
    return skew.top_per_key(df, keys, newest, 1, "_rank").drop("_rank")


def apply_changes(
    df: DataFrame,
    keys: Sequence[str],
    sequence_by: Sequence[str],
    *,
    apply_as_deletes: str | None = None,
    except_columns: Sequence[str] = (),
) -> DataFrame:
    """Current state of a change log: one row per key, deleted keys gone."""
    state = fold_latest(df, keys, sequence_by)
    if apply_as_deletes:
        state = state.where(~F.coalesce(F.expr(apply_as_deletes), F.lit(False)))
    return state.drop(*except_columns)


def history(
    df: DataFrame,
    keys: Sequence[str],
    clock: str,
    tiebreak: Sequence[str] = (),
    *,
    apply_as_deletes: str | None = None,
    except_columns: Sequence[str] = (),
    bucket_seconds: int = skew.DAY,
) -> DataFrame:
    """SCD2: each version with ``__start_at`` and ``__end_at`` (NULL while current).

    A delete closes the version before it and is not itself a version.
    """
    chained = skew.neighbour(
        df, keys, clock, tiebreak, clock, "__end_at", forward=True, bucket_seconds=bucket_seconds
    ).withColumn("__start_at", F.col(clock))
    if apply_as_deletes:
        chained = chained.where(~F.coalesce(F.expr(apply_as_deletes), F.lit(False)))
    return chained.drop(*except_columns)


def silver_state(clean: DataFrame, key: str, *, deletes: bool = True) -> DataFrame:
    """SCD1 with the conventions of the silver projections."""
    helper = [c for c in ("_op", "_source_ts_ms", "_tiebreak", "_deleted") if c in clean.columns]
    order = [c for c in ("_source_ts_ms", "_tiebreak") if c in clean.columns]
    return apply_changes(
        clean, [key], order, apply_as_deletes=DELETE if deletes else None, except_columns=helper
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write wins between a table and new rows of the same shape."""
    return fold_latest(current.unionByName(incoming, allowMissingColumns=True), keys, order)


def change_feed(bronze: DataFrame, n: int | None = None, *, newest_first: bool = True) -> DataFrame:
    """Change events by sequence; the newest ``n`` when a limit is given."""
    order = [F.col(c) for c in ("__source_ts_ms", "_kafka_offset") if c in bronze.columns]
    order = [c.desc() if newest_first else c.asc() for c in order]
    ordered = bronze.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def rows_changed_since(bronze: DataFrame, keys: Sequence[str], since_ms: Column | int) -> DataFrame:
    """Distinct keys touched after a sequence; drives a refresh of only those keys."""
    return bronze.where(F.col("__source_ts_ms") > since_ms).select(*keys).distinct()


def refresh_keys(
    published: DataFrame, recomputed: DataFrame, changed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Published rows of untouched keys plus the recomputed rows of the changed ones."""
    kept = published.join(changed, list(keys), "left_anti")
    return kept.unionByName(recomputed.join(changed, list(keys), "left_semi"))
