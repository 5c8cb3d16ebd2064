"""Sketches that are stored per closed interval and merged upward, beside the exact answer where it is asked for.

Quantiles: a sketch per key and hour is built once, in one aggregation whose partial results are sketches, so a hot key costs one
sketch per task and not its rows. Days, weeks and tenants are merges of those rows. ``RANK_ERROR`` bounds how far the rank of a
reported value may be from the one asked for; ``rank_check`` measures it against all rows.

Keys of a layer: one row per day holds a theta sketch of its keys, their exact number and the sum of their hashes. Days in which two
layers agree in number, sum and sketch are settled; only the others take part in the exact anti-join. Two different sets of keys
pass as equal only if their 64-bit hashes add up to the same sum.

Defined results: null values are left out of quantiles and keys without any value have no row; null keys are keys. Null identifiers
are left out of layers; rows without a clock belong to the null day, which is compared like any other. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch and the normalised rank error published for it (fixed values of the fit; 99 in 100 sketches).
KLL_K = 400
RANK_ERROR = 2.296 / KLL_K ** 0.9723
#: Twice the size: what queries hold results to, as several quantiles of many sketches are looked at together.
RANK_BOUND = 2 * RANK_ERROR
THETA_LG = 12


def quantile_sketches(df: DataFrame, keys: Sequence[str], clock: str, value: str, unit: str = "hour") -> DataFrame:
    """keys, period, n and sketch: one row per key and ``unit`` of the clock."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys, F.date_trunc(unit, F.col(clock)).alias("period")).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("sketch"), F.count(F.lit(1)).alias("n"))


def rolled_up(sketches: DataFrame, keys: Sequence[str], unit: str | None = None) -> DataFrame:
    """Stored sketches merged to fewer keys and a longer ``unit``; without one, over all periods."""
    period = [] if unit is None else [F.date_trunc(unit, "period").alias("period")]
    return sketches.groupBy(*keys, *period).agg(F.kll_merge_agg_double("sketch", KLL_K).alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, percents: Mapping[str, float]) -> DataFrame:
    """All columns but the sketch, and one column per wanted percentile."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in percents.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)


def rank_check(estimates: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, float]) -> DataFrame:
    """``estimates`` with, per percentile, the distance between its rank among ``rows`` and the rank asked for, as ``<name>_error``.

    A value that repeats covers a range of ranks; the distance is to the nearest. ``estimates`` has one row per key.
    """
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"r.{key}").eqNullSafe(F.col(f"e.{key}"))
    both = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).alias("r").join(
        estimates.alias("e"), on)
    counts = []
    for name in percents:
        counts += [F.count_if(F.col("_v") < F.col(f"e.{name}")).alias(f"_{name}_below"),
                   F.count_if(F.col("_v") <= F.col(f"e.{name}")).alias(f"_{name}_upto")]
    grouped = both.groupBy(*[F.col(f"e.{c}").alias(c) for c in estimates.columns]).agg(*counts, F.count(F.lit(1)).alias("_all"))
    errors = []
    for name, p in percents.items():
        below, upto = F.col(f"_{name}_below") / F.col("_all"), F.col(f"_{name}_upto") / F.col("_all")
        errors.append(F.greatest(below - F.lit(float(p)), F.lit(float(p)) - upto, F.lit(0.0)).alias(f"{name}_error"))
    return grouped.select(*estimates.columns, *errors)


def layer_days(layer: DataFrame, key: str, clock: str) -> DataFrame:
    """day, n_ids, id_sum and sketch of the distinct keys per day. Rows of closed days never change and can be stored."""
    ids = layer.where(F.col(key).isNotNull()).select(
        F.to_date(F.col(clock)).alias("day"), F.col(key).cast("string").alias("id")).distinct()
    return ids.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_ids"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("id_sum"),
        F.theta_sketch_agg("id", THETA_LG).alias("sketch"))


def _gone(one: Column, other: Column) -> Column:
    """Estimated number of keys in the first sketch and not in the second; a missing sketch holds none."""
    left = F.when(other.isNull(), F.theta_sketch_estimate(one)).otherwise(F.theta_sketch_estimate(F.theta_difference(one, other)))
    return F.when(one.isNull(), F.lit(0)).otherwise(left).cast("long")


def compared_days(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Per day of either layer: upper_ids, lower_ids, estimates of the keys only in one of them, and whether the day is settled."""
    both = upper.alias("u").join(lower.alias("l"), F.col("u.day").eqNullSafe(F.col("l.day")), "full")
    only_upper, only_lower = _gone(F.col("u.sketch"), F.col("l.sketch")), _gone(F.col("l.sketch"), F.col("u.sketch"))
    settled = F.col("u.n_ids").eqNullSafe(F.col("l.n_ids")) & F.col("u.id_sum").eqNullSafe(F.col("l.id_sum"))
    return both.select(
        F.coalesce("u.day", "l.day").alias("day"), F.coalesce("u.n_ids", F.lit(0)).alias("upper_ids"),
        F.coalesce("l.n_ids", F.lit(0)).alias("lower_ids"), only_upper.alias("only_upper"), only_lower.alias("only_lower"), settled.alias("same")
    ).select("day", "upper_ids", "lower_ids", "only_upper", "only_lower", (F.col("same") & (F.col("only_upper") + F.col("only_lower") == 0)).alias("settled"))


def missing_keys(upper: DataFrame, lower: DataFrame, days: DataFrame, key: str, clock: str) -> DataFrame:
    """day and key of everything in ``upper`` and not in ``lower`` on the same day, read from the days that are not settled."""
    open_days = days.where("NOT settled").select(F.col("day").alias("_open"))
    sides = []
    for layer in (upper, lower):
        ids = layer.where(F.col(key).isNotNull()).select(F.to_date(F.col(clock)).alias("day"), F.col(key).cast("string").alias(key))
        sides.append(ids.join(open_days, F.col("day").eqNullSafe(F.col("_open")), "left_semi").distinct())
    left, right = sides[0].alias("a"), sides[1].alias("b")
    return left.join(right, F.col("a.day").eqNullSafe(F.col("b.day")) & (F.col(f"a.{key}") == F.col(f"b.{key}")), "left_anti")


def day_report(upper: DataFrame, lower: DataFrame, key: str, clock: str) -> DataFrame:
    """``compared_days`` with ``missing``, the exact number of keys that the lower layer lacks, and whether the estimate is in its bound.

    The estimate of a difference is off by at most three standard errors of the larger sketch (relative 1 / sqrt(size - 1)).
    """
    days = compared_days(layer_days(upper, key, clock), layer_days(lower, key, clock))
    exact = missing_keys(upper, lower, days, key, clock).groupBy("day").agg(F.count(F.lit(1)).alias("missing"))
    bound = 3 * F.greatest("upper_ids", "lower_ids") / F.lit((2 ** THETA_LG - 1) ** 0.5)
    return days.alias("d").join(exact.alias("x"), F.col("d.day").eqNullSafe(F.col("x.day")), "left").select(
        "d.*", F.coalesce("x.missing", F.lit(0)).alias("missing")).withColumn(
        "in_bound", F.abs(F.col("only_upper") - F.col("missing")) <= bound)
