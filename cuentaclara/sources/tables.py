"""Batch reads and the sinks of silver, gold and the embedding log (parquet)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.operators.bronze import snapshot_rows
from cuentaclara.operators.security import Caller, visible
from cuentaclara.schemas import Topic


#: Second level of tables by tenant: a refresh of few keys writes few files also of a large tenant.
BUCKETS = 16


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder has been committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a temporary one in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="cuentaclara-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a scratch table: computed once, and lost executors cost a re-read."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, *, merge_schema: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(path)


def read_for(spark: SparkSession, path: str, caller: Caller) -> DataFrame:
    """The read path for callers outside the pipeline: always behind the tenant guard."""
    return visible(read_table(spark, path), caller)


def read_collection(spark: SparkSession, path: str, topic: Topic) -> DataFrame:
    """Exported documents of one collection as JSON lines, read with the topic's schema."""
    return spark.read.schema(topic.json_schema).json(path)


def overwrite_snapshot(df: DataFrame, path: str) -> bool:
    """Replace a table unless the new content is empty. Returns whether it was written."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("mergeSchema", "true").parquet(path)
    return True


def seed_collection(spark: SparkSession, source: str, target: str, topic: Topic) -> bool:
    """Bootstrap one bronze table from an export of its collection."""
    return overwrite_snapshot(snapshot_rows(read_collection(spark, source, topic), topic), target)


def _balanced(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one partition value together, in tasks of even size: AQE splits a value that is
    too large over several tasks and packs small values, which keeps files few but not huge."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def overwrite_partitioned(
    df: DataFrame, path: str, by: Sequence[str] = ("tenant_id",), *, rows_per_file: int = 2_000_000
) -> None:
    """Replace a table laid out by tenant; files are cut by row count."""
    _balanced(df, by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def overwrite_clustered(df: DataFrame, path: str, by: Sequence[str] = ("tenant_id", "final_date", "expense_id")) -> None:
    """Replace a table range-clustered on ``by``, so that file statistics prune reads. The last column splits a date on
    which a tenant has very many rows."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def overwrite_touched_partitions(df: DataFrame, path: str, by: Sequence[str] = ("tenant_id",)) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    (
        _balanced(df, by).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """With the bucket of a key, the second level of tables of which only touched partitions are written."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def replace_keys(fresh: DataFrame, dirty: DataFrame, path: str, key: str, by: Sequence[str] = ("tenant_id", "bucket")) -> DataFrame:
    """All rows of the keys in ``dirty`` give way to ``fresh``; only partitions that had or get such rows are written.

    ``fresh`` has the columns of the table, and its keys are in ``dirty``; the columns of ``by`` are never null. A key may move
    between partitions; a partition that loses its last row is removed. ``fresh`` is computed once and returned as it was written;
    ``dirty`` is read twice, so it should be a table. A dynamic overwrite puts folders in place when all its rows are written beside
    them: the kept rows go straight from the table into it, and the job can be run again after a failure with the same result.
    """
    spark = fresh.sparkSession
    new, keys = staged(fresh, "replace-new"), dirty.select(key).distinct()
    if not has_rows_folder(spark, path):
        _balanced(new, by).write.mode("overwrite").partitionBy(*by).parquet(path)
        return new
    current = read_table(spark, path)
    placed = current.select(key, *by, F.col("_metadata.file_path").alias("_file")).join(keys.withColumn("_dirty", F.lit(True)), key, "left")
    files = placed.groupBy(*by, "_file").agg(F.count("_dirty").alias("_out"), F.count(F.lit(1)).alias("_n"))
    places = staged(files.select(*by, F.regexp_replace("_file", "/[^/]*$", "").alias("_folder"), "_out", "_n"), "replace-places")
    old, into = places.where("_out > 0").select(*by, "_folder"), new.select(*by).distinct()
    # The comparison lets Spark prune partitions by the join.
    touched = staged(old.select(*by).unionByName(into).distinct(), "replace-touched").where(F.col(by[-1]) >= 0)
    kept = current.join(touched, list(by), "left_semi").join(keys, key, "left_anti")
    filled = staged(places.where("_out < _n").select(*by).unionByName(into).distinct(), "replace-filled")
    overwrite_touched_partitions(kept.select(*new.columns).unionByName(new), path, by)
    for row in old.join(filled, list(by), "left_anti").select("_folder").distinct().toLocalIterator():
        remove_folder(spark, row["_folder"])
    return new


def has_rows_folder(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned table has a partition."""
    return any("=" in name for name in subfolders(spark, path))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_embeddings(df: DataFrame, path: str) -> None:
    """Append (chunk_id, tenant_id, embedding, updated_at), with text_hash if there is one; readers take the newest per chunk."""
    known = ["text_hash"] if "text_hash" in df.columns else []
    columns = df.select("chunk_id", "tenant_id", F.col("embedding").cast("array<float>").alias("embedding"), "updated_at", *known)
    _balanced(columns, ["tenant_id"]).write.mode("append").partitionBy("tenant_id").parquet(path)


def hourly_partitions(df: DataFrame, clock: str) -> DataFrame:
    ts = F.col(clock)
    return df.withColumns({
        "year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"), "hour": F.date_format(ts, "HH"),
    })
