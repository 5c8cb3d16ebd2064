"""End-to-end refresh: drain bronze and silver streams, then bring gold up to date as a batch.

Gold is never a stream: silver rows are rewritten by later changes, so the rows of changed expenses are computed
again from the current state after silver has caught up. The first refresh computes all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.operators import gold, quality, retrieval, silver
from cuentaclara.operators.bronze import bronze_rows
from cuentaclara.schemas import TOPICS
from cuentaclara.sources import feeds, tables
from cuentaclara.streaming import changes
from cuentaclara.streaming.ingest import DRAIN, start_topic


@dataclass(frozen=True)
class Lake:
    """Where a lake keeps its tables and checkpoints."""

    root: str

    def bronze(self, topic: str) -> str:
        return f"{self.root}/bronze/{topic}/stream"

    def snapshot(self, topic: str) -> str:
        """Bootstrap rows. They have a folder of their own: the file sink of the stream hides what it did not write."""
        return f"{self.root}/bronze/{topic}/snapshot"

    def dead_letters(self, topic: str) -> str:
        return f"{self.root}/bronze/_dlq/{topic}"

    def silver(self, topic: str) -> str:
        return f"{self.root}/silver/{topic}"

    def gold(self, table: str) -> str:
        return f"{self.root}/gold/{table}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


#: What is counted per micro-batch. A delete needs no valid status, so it does not violate that rule.
EXPECTATIONS = {
    "expenses": quality.EXPENSE_WARN | {n: f"_op = 'd' OR ({p})" for n, p in quality.EXPENSE_DROP.items()},
    "ocr_extractions": quality.OCR_WARN,
}


def expectation_counts(spark: SparkSession, lake: Lake) -> DataFrame:
    """Violations per table, rule and micro-batch, over all silver tables with expectations."""
    return reduce(DataFrame.unionByName, [changes.expectation_counts(spark, lake.silver(name), name) for name in EXPECTATIONS])


def _rules(topic: str):
    if topic == "expenses":
        return silver.valid_changes
    return None


def ingest(spark: SparkSession, lake: Lake, sources: dict[str, DataFrame], trigger: dict | None = None) -> list:
    """Start one stream per topic, which fills its bronze table and its dead letters."""
    return [
        start_topic(raw, TOPICS[name], lake.bronze(name), lake.dead_letters(name), lake.checkpoint(f"topic_{name}"), trigger)
        for name, raw in sources.items()
    ]


def refresh_silver(spark: SparkSession, lake: Lake, topics: list[str]) -> None:
    """Bring silver up to date with bronze."""
    running = []
    for name in topics:
        clean, _ = silver.CLEANERS[name]
        apply_snapshot(spark, lake, name)
        if not changes.has_stream(spark, lake.bronze(name)):
            continue
        schema = spark.read.parquet(lake.bronze(name)).schema
        source = feeds.bronze_stream(spark, lake.bronze(name), schema)
        running.append(changes.start_apply_changes(
            source, clean, TOPICS[name].key, lake.silver(name), lake.checkpoint(f"silver_{name}"),
            rules=_rules(name), trigger=DRAIN, expectations=EXPECTATIONS.get(name),
        ))
    for query in running:
        query.awaitTermination()


def apply_snapshot(spark: SparkSession, lake: Lake, name: str) -> None:
    """Bootstrap rows as one folder of changes. They have no offset and so give way to any message of the same time."""
    if not changes.finished(spark, lake.snapshot(name)):
        return
    clean, _ = silver.CLEANERS[name]
    rows = clean(tables.read_table(spark, lake.snapshot(name)))
    if _rules(name) is not None:
        rows = _rules(name)(rows)
    changes.write_changes(rows, TOPICS[name].key, lake.silver(name), "snapshot", 0)


def silver_table(spark: SparkSession, lake: Lake, name: str, only: DataFrame | None = None) -> DataFrame:
    """Current rows of a silver table; with ``only`` just those of its keys."""
    clean, deletes = silver.CLEANERS[name]
    topic = TOPICS[name]
    empty = clean(bronze_rows(spark.createDataFrame([], feeds.MESSAGE), topic)).drop(*changes.HELPERS)
    return changes.current(spark, lake.silver(name), topic.key, empty.schema, deletes=deletes, only=only)


#: The silver tables that the audit table joins.
AUDITED = ("expenses", "ocr_extractions", "hitl_tasks", "expense_events")
COVERED = "table string, folder string"


def _covered(spark: SparkSession, lake: Lake) -> tuple[int, set[tuple[str, str]]]:
    """Number of the last finished gold version (-1: none) and the silver change folders that are in it."""
    root = lake.gold("_versions")
    numbers = [int(n.split("=")[1]) for n in tables.subfolders(spark, root) if n.startswith("n=")]
    for n in sorted(numbers, reverse=True):
        if tables.finished(spark, f"{root}/n={n}"):
            return n, {(r["table"], r["folder"]) for r in spark.read.schema(COVERED).parquet(f"{root}/n={n}").collect()}
    return -1, set()


def _dirty_expenses(spark: SparkSession, lake: Lake, name: str, folders: list[str]) -> DataFrame | None:
    """Expenses that new change folders of a silver table touch: those the changed rows name now, or named before."""
    rows, key = changes.rows_of(spark, lake.silver(name), folders), TOPICS[name].key
    if rows is None or key == "expense_id":
        return None if rows is None else rows.select("expense_id")
    # All folders, also those a snapshot covers: the snapshot no longer says what a row named before.
    stored = changes.rows_of(spark, lake.silver(name), changes.folders(spark, lake.silver(name)))
    named = stored.select(key, "expense_id")
    return named.join(rows.select(key).distinct(), key, "left_semi").select("expense_id")


def _rows_of_expenses(spark: SparkSession, lake: Lake, name: str, dirty: DataFrame) -> DataFrame:
    """Current silver rows that can belong to the dirty expenses; only their keys are folded."""
    key, keys = TOPICS[name].key, dirty
    stored = changes.versions(spark, lake.silver(name))
    if key != "expense_id" and stored is not None:
        keys = stored.select(key, "expense_id").join(dirty, "expense_id", "left_semi").select(key).distinct()
    return silver_table(spark, lake, name, keys if stored is not None else None)


def refresh_gold(spark: SparkSession, lake: Lake, embedder=None, now: Column | None = None) -> int:
    """Bring audit table, chunks and (with an embedder) embeddings up to date with silver; returns the dirty expenses.

    A change of any of the four silver tables makes its expenses dirty; only they are joined again, and only the
    partitions that hold them are written. What a version covers is written last: a refresh that died is done again.
    """
    number, covered = _covered(spark, lake)
    have = {(t, f) for t in AUDITED for f in changes.folders(spark, lake.silver(t))}
    new = sorted(have - covered)
    found = [_dirty_expenses(spark, lake, t, [f for name, f in new if name == t]) for t in AUDITED]
    found = [df for df in found if df is not None]
    if not found:
        return 0
    dirty = reduce(DataFrame.unionByName, found).where("expense_id IS NOT NULL").distinct()
    dirty = tables.staged(dirty, "gold-dirty")
    audit = gold.refresh_audit(lake.gold("expense_audit"), dirty, *[_rows_of_expenses(spark, lake, t, dirty) for t in AUDITED])
    chunks = gold.expense_chunks(audit)
    path = lake.gold("expense_chunks")
    before = tables.read_table(spark, path).join(dirty, "expense_id", "left_semi").select("chunk_id") if tables.has_rows_folder(spark, path) else None
    touched = chunks.select("chunk_id") if before is None else tables.staged(before.unionByName(chunks.select("chunk_id")).distinct(), "gold-chunks")
    tables.replace_keys(tables.bucketed(chunks, "expense_id"), dirty, path, "expense_id")
    if embedder is not None:
        retrieval.sync_embeddings(chunks, lake.gold("expense_embeddings"), embedder, now if now is not None else F.current_timestamp(), within=touched)
    spark.createDataFrame(sorted(have), COVERED).coalesce(1).write.mode("overwrite").parquet(f"{lake.gold('_versions')}/n={number + 1}")
    return dirty.count()


def refresh(spark: SparkSession, lake: Lake, sources: dict[str, DataFrame], embedder=None) -> None:
    """One full pass: everything available flows from the sources into gold."""
    for query in ingest(spark, lake, sources, DRAIN):
        query.awaitTermination()
    refresh_silver(spark, lake, list(sources))
    refresh_gold(spark, lake, embedder)
