"""Watermarked monitoring windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuentaclara.operators.operations import ocr_drift_profile


def drift_stream(ocr: DataFrame, granularity: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """The batch drift profile over a stream; a window is emitted once the watermark passes it."""
    return ocr_drift_profile(ocr.withWatermark("extracted_at", lateness), granularity)


def alerts(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("alert"))


def start_drift(ocr: DataFrame, path: str, checkpoint: str, granularity: str = "1 day", lateness: str = "1 hour",
                trigger: dict | None = None) -> StreamingQuery:
    return (
        drift_stream(ocr, granularity, lateness)
        .writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
