"""Streaming bronze: decode, append, and put aside what cannot be decoded."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuentaclara.operators.bronze import bronze_columns, bronze_rows, dead_letter_columns, dead_letters, decode_all
from cuentaclara.schemas import Topic
from cuentaclara.sources.tables import finished, hourly_partitions

#: Trigger settings by name: bronze runs continuously, OCR files every half minute.
CONTINUOUS = {"processingTime": "5 seconds"}
RAW_FILES = {"processingTime": "30 seconds"}
REFRESH = {"processingTime": "1 minute"}
DRAIN = {"availableNow": True}


def start_bronze(raw: DataFrame, topic: Topic, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append decoded events; the file sink commits each batch exactly once."""
    return (
        bronze_rows(raw, topic)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or CONTINUOUS)).queryName(f"bronze_{topic.name}").start()
    )


def start_dead_letters(raw: DataFrame, topic: Topic, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append malformed events to the dead-letter table; good events are unaffected."""
    return (
        dead_letters(raw, topic)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or CONTINUOUS)).queryName(f"dead_letters_{topic.name}").start()
    )


def start_topic(
    raw: DataFrame, topic: Topic, bronze: str, dead: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Bronze rows and dead letters from one read and one parse of a topic.

    Each micro-batch goes to a folder of its own in both tables, named after stream and batch. A batch that is run again
    after a failure leaves a finished folder as it is and writes the one that is missing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        decoded = decode_all(batch, topic).persist(StorageLevel.DISK_ONLY)
        try:
            write_once(bronze_columns(decoded.where(~F.col("malformed")), topic), f"{bronze}/batch={run}-{batch_id}")
            write_once(dead_letter_columns(decoded.where("malformed"), topic), f"{dead}/batch={run}-{batch_id}")
        finally:
            decoded.unpersist()

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or CONTINUOUS)).queryName(f"topic_{topic.name}").start()
    )


def write_once(df: DataFrame, folder: str) -> None:
    """Write a folder unless a finished write is there already."""
    if not finished(df.sparkSession, folder):
        df.write.mode("overwrite").parquet(folder)


def start_backup(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hourly partitioned copy of raw messages, by message time."""
    return (
        hourly_partitions(messages, "timestamp")
        .writeStream.format("parquet").outputMode("append")
        .partitionBy("year", "month", "day", "hour")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or REFRESH)).queryName("message_backup").start()
    )


def start_raw_ocr(files: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        files.writeStream.format("parquet").outputMode("append")
        .partitionBy("_ingestion_date")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or RAW_FILES)).queryName("raw_ocr").start()
    )
