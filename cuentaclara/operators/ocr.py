"""Normalisation of OCR responses. One document is one row, so all of it is row-local:
arrays are filtered and transformed in place and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara import schemas

#: Response field type -> column, for the three fields that drive the audit.
CORE_FIELDS = {
    "TOTAL": "ocr_total",
    "VENDOR_NAME": "ocr_vendor",
    "INVOICE_RECEIPT_DATE": "ocr_date",
}

#: Response field type -> name used in the extras; others are lower-cased.
EXTRA_FIELD_NAMES = {
    "SUBTOTAL": "subtotal",
    "TAX": "tax",
    "AMOUNT_PAID": "amount_paid",
    "AMOUNT_DUE": "amount_due",
    "INVOICE_RECEIPT_ID": "invoice_id",
    "PO_NUMBER": "po_number",
    "RECEIVER_NAME": "receiver_name",
    "RECEIVER_ADDRESS": "receiver_address",
    "VENDOR_ADDRESS": "vendor_address",
    "VENDOR_PHONE": "vendor_phone",
    "VENDOR_URL": "vendor_url",
    "VENDOR_GST_NUMBER": "vendor_tax_id",
    "PAYMENT_TERMS": "payment_terms",
    "DUE_DATE": "due_date",
    "DELIVERY_DATE": "delivery_date",
    "ORDER_DATE": "order_date",
    "ACCOUNT_NUMBER": "account_number",
    "TRACKING_NUMBER": "tracking_number",
    "STREET": "street",
    "CITY": "city",
    "STATE": "state",
    "ZIP_CODE": "zip_code",
    "COUNTRY": "country",
    "ADDRESS_BLOCK": "address_block",
}

#: Line item cell type -> struct field. EXPENSE_ROW keeps its first value.
CELL_FIELDS = {
    "ITEM": "item",
    "PRICE": "price",
    "QUANTITY": "quantity",
    "UNIT_PRICE": "unit_price",
    "PRODUCT_CODE": "product_code",
}
ROW_CELL = "EXPENSE_ROW"

#: Alias of a follow-up question -> column.
QUERY_ALIASES = {"TOTAL": "ocr_total", "VENDOR": "ocr_vendor", "DATE": "ocr_date"}

CONFIDENCE_FLOOR = 80


def _type_of(field: Column) -> Column:
    return F.coalesce(field["Type"]["Text"], F.lit("OTHER"))


def _of_type(fields: Column, kind: str) -> Column:
    return F.filter(fields, lambda f: _type_of(f) == kind)


def _confidence(field: Column) -> Column:
    return F.coalesce(field["ValueDetection"]["Confidence"], F.lit(0.0))


def _flat(arrays: Column) -> Column:
    """Flatten an array of arrays, treating missing inner arrays as empty."""
    return F.flatten(F.filter(arrays, lambda a: a.isNotNull()))


def _mean_confidence(fields: list[Column]) -> Column:
    """Mean over the fields that are present, to two places; 0.0 when none is."""
    present = F.filter(F.array(*fields), lambda f: f.isNotNull())
    total = F.aggregate(
        present, F.lit(0.0), lambda acc, f: acc + F.coalesce(f["confidence"], F.lit(0.0))
    )
    count = F.greatest(F.size(present), F.lit(1))
    return F.bround(total / count, 2)


def _documents(response: str) -> Column:
    return F.from_json(F.col(response), schemas.OCR_RESPONSE)["ExpenseDocuments"]


def _summary_fields(docs: Column) -> Column:
    return _flat(F.transform(docs, lambda d: d["SummaryFields"]))


def normalize(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``ocr_total``, ``ocr_vendor``, ``ocr_date`` as struct(value, confidence) and ``avg_confidence``.

    When a response repeats a field the last occurrence counts.
    """
    parsed = df.withColumn("_fields", _summary_fields(_documents(response)))
    for kind, name in CORE_FIELDS.items():
        last = F.try_element_at(_of_type(F.col("_fields"), kind), F.lit(-1))
        field = F.struct(
            last["ValueDetection"]["Text"].alias("value"), _confidence(last).alias("confidence")
        )
        parsed = parsed.withColumn(name, F.when(last.isNotNull(), field))
    core = [F.col(c) for c in CORE_FIELDS.values()]
    return parsed.withColumn("avg_confidence", _mean_confidence(core)).drop("_fields")


def _extra_fields(fields: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in EXTRA_FIELD_NAMES.items() for x in pair])

    def render(field: Column) -> Column:
        kind = _type_of(field)
        return F.struct(
            F.coalesce(F.try_element_at(names, kind), F.lower(kind)).alias("field"),
            field["ValueDetection"]["Text"].alias("value"),
            _confidence(field).alias("confidence"),
            field["LabelDetection"]["Text"].alias("label_text"),
        )

    others = F.filter(fields, lambda f: ~_type_of(f).isin(*CORE_FIELDS))
    return F.transform(others, render)


def _line_item(cells: Column) -> Column:
    def text_at(kind: str, position: int) -> Column:
        return F.try_element_at(_of_type(cells, kind), F.lit(position))["ValueDetection"]["Text"]

    known = [*CELL_FIELDS, ROW_CELL]
    other = F.filter(cells, lambda c: ~_type_of(c).isin(*known))
    # A repeated cell keeps its last text; building the map from the last occurrence of each
    # name avoids duplicate map keys.
    other_names = F.array_distinct(F.transform(other, lambda c: F.lower(_type_of(c))))
    other_map = F.map_from_arrays(
        other_names,
        F.transform(
            other_names,
            lambda n: F.try_element_at(
                F.filter(other, lambda c: F.lower(_type_of(c)) == n), F.lit(-1)
            )["ValueDetection"]["Text"],
        ),
    )
    sure = F.filter(F.transform(cells, _confidence), lambda c: c != 0.0)
    mean = F.aggregate(sure, F.lit(0.0), lambda acc, c: acc + c) / F.greatest(
        F.size(sure), F.lit(1)
    )
    return F.struct(
        *[text_at(kind, -1).alias(name) for kind, name in CELL_FIELDS.items()],
        text_at(ROW_CELL, 1).alias("row_text"),
        F.bround(mean, 2).alias("confidence_avg"),
        other_map.alias("other"),
    )


def _line_items(docs: Column) -> Column:
    groups = _flat(F.transform(docs, lambda d: d["LineItemGroups"]))
    lines = _flat(F.transform(groups, lambda g: g["LineItems"]))
    filled = F.filter(
        F.transform(lines, lambda li: li["LineItemExpenseFields"]), lambda c: F.size(c) > 0
    )
    return F.transform(filled, _line_item)


def extras(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``summary_extra`` and ``line_items``: everything beyond the three core fields."""
    docs = _documents(response)
    return df.withColumns({
        "summary_extra": F.coalesce(_extra_fields(_summary_fields(docs)), F.array()),
        "line_items": F.coalesce(_line_items(docs), F.array()),
    })


def extra_json(summary: str = "summary_extra", items: str = "line_items") -> Column:
    """The opaque text carried through bronze and silver."""
    return F.to_json(F.struct(F.col(summary).alias("summary_fields"), F.col(items).alias("line_items")))


def flat_summary(summary: str = "summary_extra") -> Column:
    """Core fields that are present, then the extras, as array of (field, value, confidence)."""
    core = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(F.lit(name).alias("field"), F.col(name)["value"].alias("value"),
                     F.col(name)["confidence"].alias("confidence")),
        )
        for name in CORE_FIELDS.values()
    ]
    present = F.filter(F.array(*core), lambda f: f.isNotNull())
    extra = F.transform(
        summary,
        lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"),
                           f["confidence"].alias("confidence")),
    )
    return F.concat(present, extra)


def query_answers(df: DataFrame, response: str = "response") -> DataFrame:
    """Core fields from a question-and-answer response.

    Answers fill the asked fields in order: the first answer goes to the first known alias,
    and so on. Answers beyond the last alias are ignored.
    """
    blocks = F.from_json(F.col(response), schemas.QUERY_RESPONSE)["Blocks"]
    asked = F.transform(F.filter(blocks, lambda b: b["BlockType"] == "QUERY"), lambda b: b["Query"]["Alias"])
    known = F.array_distinct(F.filter(asked, lambda a: a.isin(*QUERY_ALIASES)))
    found = df.withColumns({
        "_asked": known,
        "_answers": F.filter(blocks, lambda b: b["BlockType"] == "QUERY_RESULT"),
    })
    for alias, name in QUERY_ALIASES.items():
        # array_position is 0 for "not asked"; try_element_at rejects index 0.
        at = F.array_position("_asked", alias).cast("int")
        answer = F.try_element_at("_answers", F.nullif(at, F.lit(0)))
        field = F.struct(
            answer["Text"].alias("value"),
            F.coalesce(answer["Confidence"], F.lit(0.0)).alias("confidence"),
        )
        found = found.withColumn(name, F.when(answer.isNotNull(), field))
    core = [F.col(c) for c in QUERY_ALIASES.values()]
    return found.withColumn("avg_confidence", _mean_confidence(core)).drop("_asked", "_answers")


def merge(primary: DataFrame, fallback: DataFrame, key: str = "expense_id") -> DataFrame:
    """Per core field the more confident of two extractions; the primary one wins ties.

    Only extractions whose mean confidence is below the floor consult the fallback.
    """
    names = list(CORE_FIELDS.values())
    second = fallback.select(key, *[F.col(n).alias(f"_fb_{n}") for n in names])
    joined = primary.join(second, key, "left")
    weak = F.col("avg_confidence") < CONFIDENCE_FLOOR
    consulted = F.greatest(*[F.col(f"_fb_{n}").isNotNull() for n in names]) & weak

    merged, seen = {}, []
    for name in names:
        a, b = F.col(name), F.col(f"_fb_{name}")
        a_conf = F.coalesce(a["confidence"], F.lit(0.0))
        b_conf = F.coalesce(b["confidence"], F.lit(0.0))
        chosen = F.when(a_conf >= b_conf, a).otherwise(b)
        merged[name] = F.when(weak, chosen).otherwise(a)
        known = a.isNotNull() | (weak & b.isNotNull())
        seen.append(F.when(known, F.struct(
            F.when(weak, F.greatest(a_conf, b_conf)).otherwise(a_conf).alias("confidence"))))
    return joined.select(
        *[c for c in primary.columns if c not in (*names, "avg_confidence")],
        *[c.alias(n) for n, c in merged.items()],
        F.when(weak, _mean_confidence(seen)).otherwise(F.col("avg_confidence")).alias("avg_confidence"),
        F.coalesce(consulted, F.lit(False)).alias("used_fallback"),
    )
