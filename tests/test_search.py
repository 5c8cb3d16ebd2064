import datetime as dt
from decimal import Decimal

import pytest

from cuentaclara.operators import search


@pytest.fixture(scope="module")
def audit(spark):
    rows = [
        ("t_A", "e1", Decimal("10.00"), "UBER BV", dt.date(2026, 1, 1), "COP", "travel"),
        ("t_A", "e2", Decimal("20.00"), "Uber Eats", dt.date(2026, 1, 2), "USD", "food"),
        ("t_A", "e3", Decimal("30.00"), "Cafe", dt.date(2026, 1, 3), "COP", "food"),
        ("t_B", "e4", Decimal("40.00"), "Uber", dt.date(2026, 1, 4), "COP", "travel"),
    ]
    return spark.createDataFrame(rows, "tenant_id string, expense_id string, final_amount decimal(18,2), final_vendor string, "
                                       "final_date date, final_currency string, category string")


def ids(result):
    return [r.expense_id for r in result["rows"].collect()]


def test_vendor_is_a_case_insensitive_fragment(audit):
    assert ids(search.search(audit, {"vendor": "UBER"}, "t_A")) == ["e2", "e1"]


def test_injection_text_is_only_text(audit):
    assert ids(search.search(audit, {"vendor": "' OR 1=1 --"}, "t_A")) == []


@pytest.mark.parametrize("key", ["tenant_id", "tenantId", "tenant", "tenant_filter"])
def test_tenant_in_the_request_is_ignored(audit, key):
    assert ids(search.search(audit, {"vendor": "uber", key: "t_B"}, "t_A")) == ["e2", "e1"]


@pytest.mark.parametrize("request_", [
    {}, {"tenant_id": "t_A"}, {"category": "food'; DROP"}, {"currency": "XYZ", "vendor": "u"}, {"vendor": "u", "aggregate": "delete"},
    {"vendor": "u", "limit": "many"}, {"amount_min": "lots"},
])
def test_rejected(audit, request_):
    assert "error" in search.search(audit, request_, "t_A")


def test_tenant_is_required():
    with pytest.raises(search.InvalidSearch):
        search.parse_request({"vendor": "u"}, "")


@pytest.mark.parametrize(("asked", "used"), [(999, 50), (0, 1), (7, 7)])
def test_limit_is_clamped(spark, asked, used):
    assert search.parse_request({"vendor": "u", "limit": asked}, "t_A").limit == used


def test_ranges_are_inclusive(audit):
    request = {"amount_min": 10, "amount_max": 20, "date_from": "2026-01-01", "date_to": "2026-01-02"}
    assert len(search.parse_request(request, "t_A").predicates) == 4
    assert ids(search.search(audit, request, "t_A")) == ["e2", "e1"]


def test_aggregates(audit):
    total = search.search(audit, {"category": "food", "aggregate": "sum"}, "t_A")
    assert total["summary"].first().aggregate_value == 50.0 and ids(total) == ["e3", "e2"]
    assert search.search(audit, {"vendor": "none", "aggregate": "sum"}, "t_A")["summary"].first().aggregate_value == 0.0
    assert search.search(audit, {"category": "food", "aggregate": "count"}, "t_A")["summary"].first().row_count_total == 2
