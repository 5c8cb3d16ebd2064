import pytest
from pyspark.sql import functions as F

from cuentaclara.operators import audit

CASES = [
    (("100.0", "Starbucks", "2026-04-22"), ("100.5", "Starbucks", "2026-04-22"), []),
    (("100.0", "Starbucks", "2026-04-22"), ("120.0", "Starbucks", "2026-04-22"), ["amount"]),
    (("100.0", "Starbucks", "2026-04-22"), ("100.5", "McDonalds", "2026-04-22"), ["vendor"]),
    (("100.0", "Starbucks", "2026-04-22"), ("100.5", " starbuks ", "2026-04-22"), []),
    (("100.0", "Starbucks", "2026-04-22"), ("100.5", "Starbucks", "2026-04-23"), ["date"]),
    (("100.0", "Starbucks", "2026-04-22"), ("0", "Starbucks", "2026-04-22"), []),
    (("24395.0", "Starbucks", "2026-04-22"), ("24,395.00 COP", "Starbucks", "2026-04-22"), []),
    (("24395.0", "Starbucks", "2026-04-22"), ("24.395,00 €", "Starbucks", "2026-04-22"), []),
    (("100.0", "Starbucks", "2026-04-22"), (None, None, None), []),
    (("100.0", "", None), ("150", "Starbucks", "2026-04-22"), ["amount"]),
]


def test_compare_cases(spark):
    reported = spark.createDataFrame([(str(i), "t_1", *u) for i, (u, _, _) in enumerate(CASES)],
                                     "expense_id string, tenant_id string, amount string, vendor string, date string")
    found = spark.createDataFrame([(str(i), *o) for i, (_, o, _) in enumerate(CASES)],
                                  "expense_id string, ocr_total string, ocr_vendor string, ocr_date string")
    rows = audit.compare_fields(reported, found).collect()
    assert {int(r.expense_id): [c.field for c in r.conflicts] for r in rows} == {i: c for i, (_, _, c) in enumerate(CASES)}


def test_amount_conflict_values(spark):
    reported = spark.createDataFrame([("e", "t_1", 100.0, "Starbucks", "2026-04-22")],
                                     "expense_id string, tenant_id string, amount double, vendor string, date string")
    found = spark.createDataFrame([("e", 120.0, 99.0, "Starbucks", 96.0, "2026-04-22", 91.0)],
                                  "expense_id string, ocr_total double, ocr_total_confidence double, ocr_vendor string, "
                                  "ocr_vendor_confidence double, ocr_date string, ocr_date_confidence double")
    (conflict,) = audit.compare_fields(reported, found).first().conflicts
    assert (conflict.field, float(conflict.user_value), float(conflict.ocr_value), conflict.confidence) == ("amount", 100.0, 120.0, 99.0)


REVIEWS = [
    # decision, resolved_fields, OCR values -> amount, vendor, date, currency
    ("accept_ocr", {}, ("120.0", "Star", "22/04/2026"), (120.0, "Star", "2026-04-22", "COP")),
    ("accept_ocr", {}, (None, None, None), (None, None, None, "COP")),
    (None, {}, ("120.0", "Star", None), (120.0, "Star", None, "COP")),
    ("keep_user_value", {}, ("120.0", "Star", None), (100.0, "Starbucks", "2026-04-21", "COP")),
    ("custom", {"amount": "130", "currency": "USD"}, ("120.0", "Star", None), (130.0, "Starbucks", "2026-04-21", "USD")),
    ("accept_ocr", {"vendor": "Third"}, ("120.0", "Star", None), (120.0, "Third", None, "COP")),
]


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame(
        [(i, d, r, ["amount"], 100.0, "Starbucks", "2026-04-21", "COP", *o) for i, (d, r, o, _) in enumerate(REVIEWS)],
        "i int, decision string, resolved_fields map<string,string>, conflict_fields array<string>, amount double, vendor string, "
        "date string, currency string, ocr_total string, ocr_vendor string, ocr_date string")


def test_resolve(reviews):
    rows = audit.resolve(reviews).orderBy("i").collect()
    assert [(r.final_amount, r.final_vendor, r.final_date, r.final_currency) for r in rows] == [e for *_, e in REVIEWS]


def test_source_per_field(reviews):
    rows = [r.source_per_field for r in audit.source_per_field(reviews).orderBy("i").collect()]
    assert rows[0] == {"amount": "ocr", "vendor": "user", "date": "user", "currency": "user"}
    assert rows[3]["amount"] == "user"
    assert rows[4]["amount"] == rows[4]["currency"] == "hitl_custom"
    missing = audit.source_per_field(reviews.withColumn("vendor", F.lit(None).cast("string"))).orderBy("i").first()
    assert missing.source_per_field["vendor"] == "ocr"


def test_finalize_falls_back_to_ocr(spark):
    rows = spark.createDataFrame(
        [("a", 10.0, "V", "2026-01-01", "COP", "11", "W", "01/02/2026"), ("b", None, None, None, None, "11", "W", "01/02/2026")],
        "expense_id string, amount double, vendor string, date string, currency string, ocr_total string, ocr_vendor string, ocr_date string"
    ).withColumn("conflicts", F.array().cast("array<string>"))
    a, b = audit.finalize_without_conflict(rows).orderBy("expense_id").collect()
    assert (a.final_amount, a.final_vendor, a.source_per_field["currency"]) == (10.0, "V", "ocr_high_confidence")
    assert (b.final_amount, b.final_vendor, b.final_date, set(b.source_per_field)) == (11.0, "W", "2026-02-01", {"amount", "vendor", "date"})
