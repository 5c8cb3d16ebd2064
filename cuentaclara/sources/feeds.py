"""Streaming sources of change events. All yield ``value`` plus whatever message metadata exists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.schemas import Topic

#: Shape of a broker message; what file-based stand-ins must look like.
MESSAGE = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"


def broker(
    spark: SparkSession, servers: str, topic: str, *, starting: str = "latest", options: Mapping[str, str] | None = None
) -> DataFrame:
    """Subscribe to a broker topic. Needs the Kafka connector on the cluster's class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("failOnDataLoss", "false")
    )
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load()


def broker_avro(messages: DataFrame, avro_schema: str) -> DataFrame:
    """Avro payloads as the JSON text the decoder expects, message metadata kept.
    Needs the spark-avro module on the cluster's class path."""
    from pyspark.sql.avro.functions import from_avro

    return messages.withColumn("value", F.to_json(from_avro("value", avro_schema)).cast("binary"))


def messages_from_files(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Recorded broker messages in parquet, same columns as the broker source."""
    reader = spark.readStream.schema(MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def json_lines(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Change events as (gzipped) JSON lines under time-based folders."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(F.col("value").cast("binary").alias("value"))


def raw_ocr_files(spark: SparkSession, path: str, schema: str, *, stream: bool = True) -> DataFrame:
    """Raw OCR responses; tenant and expense come from ``tenant=.../expense=...`` in the path."""
    reader = spark.readStream if stream else spark.read
    files = (
        reader.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").json(path)
    )
    source = F.col("_metadata.file_path")
    return files.select(
        "*",
        source.alias("_source_file"),
        F.current_timestamp().alias("_ingestion_ts"),
        F.current_date().alias("_ingestion_date"),
        F.regexp_extract(source, "tenant=([^/]+)", 1).alias("tenant_id"),
        F.regexp_extract(source, "expense=([^/]+)", 1).alias("expense_id"),
    )


def bronze_stream(spark: SparkSession, path: str, schema: str | object, *, max_files: int | None = None) -> DataFrame:
    """A bronze table as a stream. Re-read files are harmless: the change fold is idempotent."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def topic_name(prefix: str, topic: Topic) -> str:
    return f"{prefix}.{topic.name}"
