import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuentaclara.functions import text
from cuentaclara.functions.similarity import indel_ratio, lcs_length

AMOUNTS = [
    ("24,395.00 COP", 24395.0), ("24.395,00 €", 24395.0), ("1,234", 1.234), ("1,234,567", None), ("", None),
    (None, None), ("abc", None), ("-12.5", -12.5), ("1.234", 1.234), ("$ 99", 99.0), ("5.", 5.0), ("--5", None),
]
DATES = [
    ("2026-04-25", dt.date(2026, 4, 25)), ("25/04/2026", dt.date(2026, 4, 25)), ("04/25/2026", dt.date(2026, 4, 25)),
    ("5-4-2026", dt.date(2026, 4, 5)), ("2026/4/5", dt.date(2026, 4, 5)), ("31/02/2026", None), ("soon", None),
    (" 2026-4-5 ", dt.date(2026, 4, 5)), ("12026-04-25", None), ("", None), (None, None),
]


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_amounts(spark):
    assert _apply(spark, text.amount_value, [a for a, _ in AMOUNTS]) == [b for _, b in AMOUNTS]


def test_dates(spark):
    assert _apply(spark, text.date_value, [a for a, _ in DATES]) == [b for _, b in DATES]


def test_mask_and_one_line(spark):
    assert _apply(spark, text.mask_email, ["ana@mail.test", "a@mail.test"]) == ["an****@mail.test", "a@mail.test"]
    assert _apply(spark, lambda c: text.mask_email(c, True), ["ana@mail.test"]) == ["ana@mail.test"]
    assert _apply(spark, text.one_line, ["a\n\t\rb" + "c" * 300]) == ["a b" + "c" * 247]


def test_ulid(spark):
    # 01HQ... encodes milliseconds in its first ten characters; all zeros is the epoch.
    assert _apply(spark, text.ulid_millis, ["evt_00000000010000000000000000", "01ARZ3NDEKTSV4RRFFQ69G5FAV"]) == [1, 1469922850259]


@pytest.mark.parametrize(("a", "b", "expected"), [
    ("starbucks", "starbuks", 2 * 8 / 17), ("starbucks", "mcdonalds", None), ("", "", 1.0), ("abc", "", 0.0),
    ("x" * 150 + "y", "y" + "x" * 150, 2 * 150 / 302),
])
def test_similarity(a, b, expected):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert lcs_length(a, b) == table[-1][-1]
    if expected is not None:
        assert indel_ratio(a, b) == pytest.approx(expected)
