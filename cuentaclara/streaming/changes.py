"""Streaming SCD1 over plain parquet.

Each micro-batch is folded to one row per key and written to ``<table>/changes/run=<stream>/batch=<n>``. The stream's id
lives in its checkpoint: a retried batch overwrites its own folder, and a replay with a fresh checkpoint, whose batch
numbers start anew, gets folders of its own. A snapshot lists the folders it covers; readers fold the newest
snapshot and all folders it does not list. Tombstones are part of the state, so the order in which batches arrive does
not matter. ``compact`` writes the next snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cuentaclara.operators import quality
from cuentaclara.operators.cdc import DELETE, fold_latest
from cuentaclara.sources.tables import finished, subfolders
from cuentaclara.streaming.ingest import REFRESH

EXPECTED = "run_id string, batch_id bigint, expectation string, failed bigint, total bigint"
HELPERS = ("_op", "_source_ts_ms", "_tiebreak", "_deleted")


def _order(columns: Sequence[str]) -> list[str]:
    """What decides between changes of a key. Rows without an offset, such as those of a snapshot, come first."""
    return [c for c in ("_source_ts_ms", "_tiebreak", "_op") if c in columns]


def has_stream(spark: SparkSession, folder: str) -> bool:
    """Whether a stream has written anything to the folder."""
    return any(n == "_spark_metadata" or n.startswith("batch=") for n in subfolders(spark, folder))


def _batches(spark: SparkSession, table: str) -> list[str]:
    """Finished change folders, relative to the table's changes."""
    found = []
    for run in subfolders(spark, f"{table}/changes"):
        found += [f"{run}/{b}" for b in subfolders(spark, f"{table}/changes/{run}") if finished(spark, f"{table}/changes/{run}/{b}")]
    return sorted(found)


def _snapshot(spark: SparkSession, table: str) -> tuple[int, set[str]]:
    """Number of the newest finished snapshot (-1: none) and the change folders it covers."""
    numbers = [int(n.split("=")[1]) for n in subfolders(spark, f"{table}/snapshots") if n.startswith("n=")]
    for n in sorted(numbers, reverse=True):
        if finished(spark, f"{table}/snapshots/n={n}/covers"):
            return n, {r["folder"] for r in spark.read.parquet(f"{table}/snapshots/n={n}/covers").collect()}
    return -1, set()


def write_changes(rows: DataFrame, key: str, table: str, run: str, number: int) -> None:
    """One folder of changes, folded per key; written again it replaces itself."""
    folded = fold_latest(rows, [key], _order(rows.columns))
    folded.write.mode("overwrite").parquet(f"{table}/changes/run={run}/batch={number}")


def start_apply_changes(
    source: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    key: str,
    table: str,
    checkpoint: str,
    *,
    rules: Callable[[DataFrame], DataFrame] | None = None,
    trigger: dict | None = None,
    expectations: quality.Rules | None = None,
) -> StreamingQuery:
    """Keep ``table`` in step with a bronze stream. ``rules`` may drop invalid rows.

    Violations of ``expectations`` are counted while a micro-batch is written, before rows are dropped, and kept beside
    its changes: ``expectation_counts`` reads them. A batch that is run again replaces its counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = clean(batch)
        seen = Observation() if expectations else None
        if seen is not None:
            rows = quality.warn(rows, expectations, seen)
        if rules is not None:
            rows = rules(rows)
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_changes(rows, key, table, stream, batch_id)
        if seen is not None:
            counts = seen.get
            found = [(stream, batch_id, rule, counts[rule], counts["total_rows"]) for rule in expectations]
            spark.createDataFrame(found, EXPECTED).coalesce(1).write.mode("overwrite").parquet(f"{table}/expectations/run={stream}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or REFRESH)).start()
    )


def expectation_counts(spark: SparkSession, table: str, name: str) -> DataFrame:
    """(table_name, run_id, batch_id, expectation, failed, total): one row per rule and micro-batch."""
    root = f"{table}/expectations"
    paths = [f"{root}/{run}/{b}" for run in subfolders(spark, root) for b in subfolders(spark, f"{root}/{run}") if finished(spark, f"{root}/{run}/{b}")]
    rows = spark.read.schema(EXPECTED).parquet(*paths) if paths else spark.createDataFrame([], EXPECTED)
    return rows.select(F.lit(name).alias("table_name"), "run_id", "batch_id", "expectation", "failed", "total")


def folders(spark: SparkSession, table: str) -> set[str]:
    """Names of all finished change folders."""
    return set(_batches(spark, table))


def rows_of(spark: SparkSession, table: str, names: Sequence[str]) -> DataFrame | None:
    """The changes of some folders. They are named one by one, so their names do not become columns."""
    paths = [f"{table}/changes/{n}" for n in sorted(names)]
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def versions(spark: SparkSession, table: str) -> DataFrame | None:
    """Every stored row: the newest snapshot and the changes it does not cover."""
    return _versions(spark, table)[0]


def _versions(spark: SparkSession, table: str) -> tuple[DataFrame | None, int, list[str]]:
    number, covered = _snapshot(spark, table)
    batches = _batches(spark, table)
    paths = [f"{table}/changes/{b}" for b in batches if b not in covered]
    if number >= 0:
        paths.append(f"{table}/snapshots/n={number}/rows")
    return (spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None), number, batches


def _state(spark: SparkSession, table: str, key: str, only: DataFrame | None = None) -> tuple[DataFrame | None, int, list[str]]:
    rows, number, batches = _versions(spark, table)
    if rows is None:
        return None, number, batches
    if only is not None:
        rows = rows.join(only.select(key), key, "left_semi")
    return fold_latest(rows, [key], _order(rows.columns)), number, batches


def current(spark: SparkSession, table: str, key: str, schema: T.StructType, *, deletes: bool = True, only: DataFrame | None = None) -> DataFrame:
    """The visible state: one row per live key, helper columns removed. With ``only`` just its keys are folded."""
    state, _, _ = _state(spark, table, key, only)
    if state is None:
        return spark.createDataFrame([], schema)
    if deletes:
        state = state.where(~F.coalesce(F.expr(DELETE), F.lit(False)))
    return state.drop(*HELPERS)


def compact(spark: SparkSession, table: str, key: str) -> int:
    """Fold everything so far (tombstones included) into a new snapshot, and return its number.

    The list of covered folders is written last: until then readers use the snapshot before. Covered folders are left
    for the retention job.
    """
    state, number, batches = _state(spark, table, key)
    if state is None:
        return number
    state.write.mode("overwrite").parquet(f"{table}/snapshots/n={number + 1}/rows")
    spark.createDataFrame([(b,) for b in batches], "folder string").coalesce(1).write.mode("overwrite").parquet(
        f"{table}/snapshots/n={number + 1}/covers")
    return number + 1
