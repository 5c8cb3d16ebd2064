"""Change feed decoding: raw messages to typed, append-only bronze rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuentaclara.schemas import CORRUPT, Topic

#: Message metadata a broker source may carry; kept when present.
_MESSAGE_METADATA = {
    "timestamp": "_kafka_ts",
    "partition": "_kafka_partition",
    "offset": "_kafka_offset",
}


def drop_tombstones(raw: DataFrame) -> DataFrame:
    """Messages without a value carry no row and are skipped."""
    return raw.where(F.col("value").isNotNull())


def _is_malformed(doc: Column, topic: Topic) -> Column:
    # A single badly typed field leaves the rest of the record usable, so only text that yields neither key nor
    # operation counts as malformed: broken JSON, and JSON of another shape.
    return doc[topic.key].isNull() & doc["__op"].isNull()


#: Fields that a bronze column is made from, where that is not the field of its own name alone.
_MADE_FROM = {
    "uploaded_at": ("uploaded_at", "created_at"),
    "content_type": ("content_type", "mime_type"),
    "actor_type": ("actor",),
    "actor_id": ("actor",),
}


def _schema_of(topic: Topic, only: Sequence[str] | None) -> T.StructType:
    """What to parse for the bronze columns in ``only``; the rest of a message is skipped, though still checked to be JSON."""
    if only is None:
        return topic.json_schema
    used = {topic.key, "__op"}.union(*[_MADE_FROM.get(c, (c,)) for c in only])
    return T.StructType([f for f in topic.json_schema.fields if f.name in used])


def _parsed(topic: Topic, keep, only: Sequence[str] | None = None) -> Column:
    """Zero or one decoded documents: tombstones give none, nor do documents ``keep`` rejects.

    Deciding inside the array means the text is parsed exactly once per message. As a filter
    the decision would be pushed below the projection and parse every message again for each
    field it looks at.
    """
    doc = F.from_json(
        F.col("value").cast("string"),
        _schema_of(topic, only),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    return F.filter(F.array(doc), lambda d: d.isNotNull() & keep(d))


def decode(raw: DataFrame, topic: Topic, only: Sequence[str] | None = None) -> DataFrame:
    """Well-formed messages with their payload in ``doc``, or the part of it that the bronze columns in ``only`` need."""
    return raw.withColumn("doc", F.explode(_parsed(topic, lambda d: ~_is_malformed(d, topic), only)))


def decode_all(raw: DataFrame, topic: Topic) -> DataFrame:
    """Every message but tombstones with its payload in ``doc``, and whether it is ``malformed``: one parse for both tables."""
    both = raw.withColumn("doc", F.explode(_parsed(topic, lambda d: F.lit(True))))
    return both.withColumn("malformed", _is_malformed(F.col("doc"), topic))


def field_names(raw: Column) -> Column:
    """Normalise conflict lists: plain names, ``{"field": ...}`` objects, or the ``_0`` map form."""
    listed = F.from_json(raw, "array<string>")
    mapped = F.map_values(F.from_json(raw, "map<string,string>"))
    items = F.when(F.ltrim(raw).startswith("{"), mapped).otherwise(listed)
    return F.transform(items, lambda x: F.coalesce(F.get_json_object(x, "$.field"), x))


def _typed(name: str, topic: Topic) -> Column:
    value = F.col("doc")[name]
    if name in topic.money:
        value = value.try_cast("decimal(18,2)")
    elif name == "uploaded_at":
        value = F.coalesce(value, F.col("doc")["created_at"]).try_cast("timestamp")
    elif name in topic.timestamps:
        value = value.try_cast("timestamp")
    elif name == "content_type":
        value = F.coalesce(value, F.col("doc")["mime_type"])
    elif name == "discrepancy_fields":
        value = field_names(value)
    return value.alias(name)


def bronze_rows(raw: DataFrame, topic: Topic, ingested_at: Column | None = None, *, only: Sequence[str] | None = None) -> DataFrame:
    """Flat bronze rows. Text that does not fit its type becomes NULL; it never fails the job. A reader of few columns
    names them in ``only``: rows and values are the same, other fields are not parsed."""
    rows = bronze_columns(decode(raw, topic, only), topic, ingested_at, only=only)
    return rows if only is None else rows.select(*only)


def bronze_columns(decoded: DataFrame, topic: Topic, ingested_at: Column | None = None, *, only: Sequence[str] | None = None) -> DataFrame:
    """Bronze rows from messages whose payload is in ``doc`` already."""
    helper_only = {"mime_type"} | ({"created_at"} - set(topic.timestamps))
    have = set(_schema_of(topic, only).fieldNames())
    payload = [_typed(c, topic) for c in topic.columns if c not in helper_only and (only is None or c in only)]
    doc = F.col("doc")
    extra: list[Column] = []
    if "actor" in topic.columns and "actor" in have:
        extra += [
            F.get_json_object(doc["actor"], "$.type").alias("actor_type"),
            F.get_json_object(doc["actor"], "$.id").alias("actor_id"),
        ]
    extra += [
        doc[c].try_cast("boolean").alias(c) if c == "__deleted" else doc[c].alias(c)
        for c in ("__op", "__source_ts_ms", "__deleted") if c in have
    ]
    extra += [
        F.col(source).alias(target)
        for source, target in _MESSAGE_METADATA.items()
        if source in decoded.columns
    ]
    stamp = ingested_at if ingested_at is not None else F.current_timestamp()
    return (
        decoded.select(
            *payload,
            *extra,
            stamp.alias("_cdc_ingestion_ts"),
            stamp.cast("date").alias("_cdc_date"),
        )
    )


def dead_letters(raw: DataFrame, topic: Topic, received_at: Column | None = None) -> DataFrame:
    """Messages that could not be decoded, with enough context to replay them by hand."""
    bad = raw.withColumn("doc", F.explode(_parsed(topic, lambda d: _is_malformed(d, topic))))
    return dead_letter_columns(bad, topic, received_at)


def dead_letter_columns(decoded: DataFrame, topic: Topic, received_at: Column | None = None) -> DataFrame:
    """Dead letters from malformed messages whose payload is in ``doc`` already."""

    def meta(name: str, cast: str) -> Column:
        return (F.col(name) if name in decoded.columns else F.lit(None)).cast(cast)

    origin = F.col("topic") if "topic" in decoded.columns else F.lit(topic.name)
    return (
        decoded.select(
            origin.alias("topic_original"),
            meta("partition", "int").alias("partition"),
            meta("offset", "bigint").alias("offset"),
            F.base64(F.col("value").cast("binary")).alias("payload_raw"),
            F.when(F.col("doc")[CORRUPT].isNotNull(), "malformed JSON").otherwise("neither key nor operation").alias("error_message"),
            (received_at if received_at is not None else F.current_timestamp()).alias("received_at"),
        )
    )


# --- bootstrap snapshot -------------------------------------------------------------------

#: Per collection, the fallback of absent fields and the columns that order rows.
_SNAPSHOT = {
    "expenses": ({"currency": "USD", "status": "pending"}, ("updated_at", "created_at")),
    "receipts": ({}, ("uploaded_at", "created_at")),
    "hitl_tasks": ({"status": "pending"}, ("resolved_at", "created_at")),
    "ocr_extractions": ({}, ("extracted_at", "created_at")),
    "expense_events": ({}, ("created_at",)),
}


def snapshot_rows(docs: DataFrame, topic: Topic, ingested_at: Column | None = None) -> DataFrame:
    """Whole-collection bootstrap: every document becomes one create event."""
    defaults, clock = _SNAPSHOT[topic.name]
    present = set(docs.columns)
    typed = {f.name: f.dataType for f in topic.json_schema.fields}

    def source(name: str) -> Column:
        if name not in present:
            return F.lit(None).cast(typed[name])
        return F.col(name)

    def when_seen(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[source(n).try_cast("timestamp") for n in names])

    columns: list[Column] = []
    for name in topic.columns:
        if name == "mime_type" or (name == "created_at" and name not in topic.timestamps):
            continue
        value = source(name)
        if name in topic.money:
            value = value.cast("string").try_cast("decimal(18,2)")
        elif name in ("updated_at", "uploaded_at", "extracted_at"):
            value = when_seen((name, "created_at"))
        elif name in topic.timestamps:
            value = value.try_cast("timestamp")
        elif name in ("date", "final_date", "ocr_date"):
            value = F.left(value.cast("string"), F.lit(10))
        elif name == "content_type":
            value = F.coalesce(value, source("mime_type"))
        elif name == "discrepancy_fields":
            is_text = name in present and docs.schema[name].dataType.typeName() == "string"
            names = field_names(value) if is_text or name not in present else value
            value = F.coalesce(names, F.array().cast("array<string>"))
        elif name in ("source_per_field", "resolved_fields", "details"):
            value = F.coalesce(value, F.create_map().cast("map<string,string>"))
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]))
        columns.append(value.alias(name))

    stamp = ingested_at if ingested_at is not None else F.current_timestamp()
    return docs.select(
        *columns,
        F.lit("c").alias("__op"),
        F.coalesce(F.unix_millis(when_seen(clock)), F.lit(0).cast("bigint")).alias("__source_ts_ms"),
        F.lit(False).alias("__deleted"),
        stamp.alias("_cdc_ingestion_ts"),
        stamp.cast("date").alias("_cdc_date"),
    )
