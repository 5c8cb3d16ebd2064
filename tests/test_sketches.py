"""Stored sketches against exact answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuentaclara.operators import sketches

WANTED = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


@pytest.fixture(scope="module")
def rows(spark):
    # Tenant a has two thirds of all rows, most of them in one hour; some values and tenants are null.
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 < 2, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("tenant"),
        F.timestamp_seconds(F.when(F.col("id") % 5 < 4, 1000).otherwise(F.col("id") * 7919 % 400_000)).alias("at"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 104_729 % 10_007).alias("v")).cache()


def test_quantiles_of_merged_sketches(rows):
    hours = sketches.quantile_sketches(rows, ["tenant"], "at", "v")
    total = sketches.quantiles(sketches.rolled_up(hours, ["tenant"]), WANTED)
    values = {}
    for r in rows.where("v IS NOT NULL").collect():
        values.setdefault(r.tenant, []).append(r.v)
    got = {r.tenant: r for r in total.collect()}
    assert set(got) == set(values) == {"a", "b", None}
    for tenant, vs in values.items():
        assert got[tenant].n == len(vs)
        for name, p in WANTED.items():
            assert abs(np.mean(np.array(vs) <= got[tenant][name]) - p) <= sketches.RANK_BOUND


def test_days_are_merged_hours_and_the_check_counts_ranks(rows):
    days = sketches.rolled_up(sketches.quantile_sketches(rows, ["tenant"], "at", "v"), ["tenant"], "day")
    found = sketches.quantiles(days, WANTED)
    dated = rows.withColumn("period", F.date_trunc("day", "at"))
    assert found.count() == dated.where("v IS NOT NULL").select("tenant", "period").distinct().count()
    checked = sketches.rank_check(found, dated, ["tenant", "period"], "v", WANTED)
    worst = checked.agg(*[F.max(f"{n}_error").alias(n) for n in WANTED], F.count(F.lit(1)).alias("k")).first()
    assert max(worst[n] for n in WANTED) <= sketches.RANK_BOUND and worst["k"] == found.count()
    # A wrong value is seen.
    wrong = sketches.rank_check(found.withColumn("p50", F.col("p95")), dated, ["tenant", "period"], "v", {"p50": 0.5})
    assert wrong.agg(F.max("p50_error")).first()[0] > 0.4


def test_partial_sketches_move_instead_of_rows(rows):
    plan = sketches.quantile_sketches(rows, ["tenant"], "at", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_kll" in plan


def test_nothing(rows):
    none = rows.where("false")
    assert sketches.quantiles(sketches.rolled_up(sketches.quantile_sketches(none, ["tenant"], "at", "v"), ["tenant"]), WANTED).count() == 0
    assert sketches.day_report(none, none, "tenant", "at").count() == 0


def test_layers(spark):
    def layer(*parts):
        return spark.createDataFrame([(k, d) for d, keys in parts for k in keys], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))

    many = [f"x{i}" for i in range(20_000)]
    upper = layer(("2024-01-01", many), ("2024-01-02", ["a", "b", "b", None]), ("2024-01-03", ["c"]), ("2024-01-05", ["e", "f"]), (None, ["n"]))
    # One of 20,000 is missing, one of two swapped for another, a day missing, a day only below.
    lower = layer(("2024-01-01", many[:-1]), ("2024-01-02", ["b", "a"]), ("2024-01-04", ["d"]), ("2024-01-05", ["e", "g"]), (None, ["n", "n"]))
    got = {str(r.day): r for r in sketches.day_report(upper, lower, "k", "at").collect()}
    assert {d: (r.upper_ids, r.lower_ids, r.missing, r.settled) for d, r in got.items()} == {
        "2024-01-01": (20_000, 19_999, 1, False), "2024-01-02": (2, 2, 0, True), "2024-01-03": (1, 0, 1, False),
        "2024-01-04": (0, 1, 0, False), "2024-01-05": (2, 2, 1, False), "None": (1, 1, 0, True)}
    assert all(r.in_bound for r in got.values())
    assert (got["2024-01-05"].only_upper, got["2024-01-05"].only_lower) == (1, 1)
    days = sketches.compared_days(sketches.layer_days(upper, "k", "at"), sketches.layer_days(lower, "k", "at"))
    assert {r.k for r in sketches.missing_keys(upper, lower, days, "k", "at").collect()} == {"x19999", "c", "f"}
