"""Exact deduplication with streaming state: one state row per distinct text, kept on disk and without expiry.

A stream of (row, digest) pairs is folded by digest. The state of a digest holds the digest, the stable identifier
of the row that stays (smallest ``doc_id``, nulls last), the content locator of that row and the number of rows. The
state store is RocksDB, so its size is bound by disk and not by memory, and nothing ever leaves it. Each micro-batch is
combined per digest in the map tasks first: a text that a third of all rows share costs one state update per task.

A digest that meets again is only a candidate. Every such hit is compared with the full bytes of the row that its
locator names; rows that differ in spite of an equal digest are grouped by their bytes instead.

Defined results: a null text counts as empty, so empty and null texts are one group. Rows repeated in full are members
like any other; of several rows with the smallest doc_id exactly one is kept. A null doc_id never wins against a number.
An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.llm.common import own_columns, shared_dir, with_row_key, without_rows, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: State on disk, memory bounded per executor, and no files allocated ahead of what the state needs.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ARRIVALS = "row_key string, doc_id long, digest string"
#: Smallest identifier first, nulls last; the locator decides between rows that share the identifier.
KEEP_ORDER = "struct(doc_id IS NULL AS missing, doc_id, row_key)"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keep_state(arrivals: DataFrame) -> DataFrame:
    """Streaming state per digest: identifier and locator of the row that stays, and the number of rows.

    ``arrivals`` is a streaming frame of ``ARRIVALS``. No watermark is set, so no state expires.
    """
    return arrivals.groupBy("digest").agg(F.min(F.expr(KEEP_ORDER)).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_stream(spark: SparkSession, landing: str, files_per_batch: int, checkpoint: str | None = None,
               state_path: str | None = None) -> DataFrame:
    """Feed all files that landed and are not yet in the state, then return the state table.

    With the same ``checkpoint`` and ``state_path`` a later call continues where this one ended, also after a failure.
    """
    checkpoint = checkpoint or shared_dir(spark, "dedup-stream")
    state_path = state_path or shared_dir(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

        def publish(batch: DataFrame, batch_id: int) -> None:
            # A retried batch overwrites its own folder, so every batch counts once.
            batch.select("digest", "keep.doc_id", "keep.row_key", "n").write.mode("overwrite").parquet(
                f"{state_path}/batch={batch_id}")

        query = (keep_state(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).foreachBatch(publish).start())
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema("digest string, doc_id long, row_key string, n long, batch int").parquet(state_path)
    # The count of a digest only grows: its latest change is the one of the last batch.
    latest = changes.groupBy("digest").agg(F.max(F.struct("batch", "doc_id", "row_key", "n")).alias("s"))
    return latest.select("digest", F.col("s.doc_id").alias("keep_id"), F.col("s.row_key").alias("locator"),
                         F.col("s.n").alias("n"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 2000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest and row_key.

    Texts move once, by digest; only those of digests with more than one row are written and compared.
    """
    return _dedup(with_row_key(own_columns(docs, "doc_id", "text")), digest, files_per_batch)


def _dedup(keyed: DataFrame, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    spark = keyed.sparkSession
    rows = keyed.select(
        "row_key", F.col("`doc_id`").cast("long").alias("doc_id"), normalised(F.col("`text`")).alias("body")
    ).withColumn("digest", digest(F.col("body")))
    arrivals = written(rows.select("row_key", "doc_id", "digest"), "dedup-arrivals")
    landing = arrivals.inputFiles()[:1][0].rsplit("/", 1)[0]
    state = written(run_stream(spark, landing, files_per_batch), "dedup-latest")
    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "row_key"]
    single = arrivals.join(state.where("n = 1").drop("doc_id"), "digest").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        "digest", "row_key")
    # Hits: the bytes at the locator against the bytes of every row of the digest.
    members = written(rows.join(state.where("n > 1"), "digest"), "dedup-hits")
    at_locator = members.where("row_key = locator").select("digest", F.col("body").alias("kept_body"))
    verdict = written(members.join(at_locator, "digest").select(
        "row_key", "doc_id", "digest", "keep_id", "locator", "n", (F.col("body") == F.col("kept_body")).alias("same")), "dedup-verdict")
    clashes = written(verdict.where("not same").groupBy("digest").agg(F.count(F.lit(1)).alias("others")), "dedup-clashes")
    same = verdict.where("same").join(clashes, "digest", "left").select(
        "doc_id", "keep_id", (F.col("n") - F.coalesce("others", F.lit(0))).alias("group_size"),
        (F.col("row_key") == F.col("locator")).alias("kept"), "digest", "row_key")
    # Equal digests of different bytes: grouped by the bytes themselves.
    other = members.join(verdict.where("not same").select("row_key"), "row_key", "left_semi")
    by_bytes = other.groupBy("digest", "body").agg(F.min(F.expr(KEEP_ORDER)).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    differing = other.select("row_key", "doc_id", "digest", "body").join(by_bytes, ["digest", "body"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row_key") == F.col("keep.row_key")).alias("kept"), "digest", "row_key")
    return single.select(columns).unionByName(same.select(columns)).unionByName(differing.select(columns))


def kept_rows(docs: DataFrame, files_per_batch: int = 2000) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts."""
    keyed = with_row_key(docs)
    gone = written(_dedup(keyed, sha256, files_per_batch).where("NOT kept").select("row_key"), "dedup-gone")
    return without_rows(keyed, gone, docs.columns)
