"""Mixing sources to target weights by capped water-filling, and seeded whole and fractional repetitions.

Each source has a weight and a cap (``max_epochs`` times its size). Targets share ``budget`` times all words in
proportion to the weights; a source above its cap is clamped and its excess goes to the others by weight, until none is
above. That fixed point has a level: target = min(cap, weight * level). Sources sorted by cap / weight give the level
from running sums, so no loop is needed.

A source with target t and size s takes each document floor(t / s) times, and fills the rest with one more repetition of
documents in seeded order: the first ones whole, the one that crosses the target in part. Where the order crosses is
found without sorting a source in one task: the seeded hash is cut into 1024 digits twice, word counts per digit
are summed in the map tasks, and only the documents that share the two leading digits of the crossing are sorted.

Defined results: a null text has size 0 and takes 0 words. A null source is a source of its own, last in the order.
Repeated rows are documents of their own; identical ones stand next to each other in the seeded order. An empty table
gives an empty result. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuentaclara.llm.common import own_columns, written

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 1024


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word, in its own spelling."""
    # Parts between positions where a word ends, each with the white space before its word.
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """source, source_size, target from a frame of source and source_size (one row per source)."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select(
        "source", "source_size", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))).alias("total"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    here_on = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if exactly the sources before this one were clamped; the first source that stays below its cap sets it.
    levels = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    return levels.withColumn("final", level).select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).alias("target"))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """The rows with their size and their place in the seeded order (``order``, whose leading digits are d1 and d2)."""
    parts = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in ("doc_id", "source", "text")]
    seeded = F.concat_ws("|", F.lit(str(seed)), *parts)
    placed = docs.withColumns({
        "size": size_in_words(F.col("`text`")),
        "order": F.conv(F.substring(F.md5(seeded.cast("binary")), 1, 15), 16, 10).cast("long")})
    return placed.withColumns({"d1": F.shiftright("order", 50), "d2": F.shiftright("order", 40) % DIGITS})


def crossing(words: DataFrame, digit: str, rest: str) -> DataFrame:
    """Per source the digit in which the running sum of words reaches ``rest``, and what is left of it there."""
    order = Window.partitionBy("source").orderBy(digit)
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = words.withColumn("before", before).where(
        (F.col(rest) > F.col("before")) & (F.col(rest) <= F.col("before") + F.col("words")))
    return reached.select("source", F.col(digit).alias("cut"), (F.col(rest) - F.col("before")).alias("left"))


def null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on source, null being a value; the right side has one row per source."""
    renamed = right.withColumnRenamed("source", "source_right")
    return left.join(renamed, F.col("source").eqNullSafe(F.col("source_right")), how).drop("source_right")


def plan(docs: DataFrame, weights: Sequence[float], budget: float, max_epochs: float, seed: int) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and the place in the order where the next one ends."""
    rows = written(keyed(own_columns(docs, "doc_id", "text", "source"), seed).select("source", "size", "d1", "d2"), "mix-sizes")
    sums = written(rows.groupBy("source", "d1").agg(F.sum("size").alias("words")), "mix-digits")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, budget, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = written(targets.withColumn(
        "rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-targets")
    first = written(crossing(null_safe(sums, targets.select("source", "rest"), "inner"), "d1", "rest"), "mix-first")
    inner = null_safe(rows, first, "inner").where("d1 = cut").groupBy("source", "d2", "left").agg(F.sum("size").alias("words"))
    second = crossing(inner, "d2", "left").select("source", F.col("cut").alias("cut2"), F.col("left").alias("left2"))
    return written(null_safe(null_safe(targets, first.select("source", F.col("cut").alias("cut1")), "left"), second, "left"), "mix-plan")


def taken_words(placed: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows with the columns of their source's plan and ``taken``. The plan joins by source, so a hot source is split."""
    rows = null_safe(placed, planned, "inner")
    place = F.struct("d1", "d2")
    end = F.struct(F.col("cut1").alias("d1"), F.col("cut2").alias("d2"))
    inside = F.coalesce(place == end, F.lit(False))
    extra = F.when(F.col("cut1").isNotNull() & (place < end), F.col("size")).otherwise(F.lit(0))
    plain = rows.where(~inside).withColumn("taken", F.col("whole") * F.col("size") + extra)
    # Only about one row in a million of a source shares both digits of its crossing.
    order = Window.partitionBy("source").orderBy("order", "`doc_id`", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("left2") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    edge = rows.where(inside).withColumn("taken", F.col("whole") * F.col("size") + part)
    return plain.unionByName(edge)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0,
        seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    planned = plan(docs, weights, budget, max_epochs, seed)
    placed = keyed(own_columns(docs, "doc_id", "text", "source"), seed).drop("text")
    return taken_words(placed, planned).select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0,
               seed: int = 17) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a document taken twice gives two rows.

    A repetition taken in part holds the document's first words up to the amount taken, in their own spelling and
    spacing; n_chars, where present, follows. Documents without words are not mixed.
    """
    planned = plan(docs, weights, budget, max_epochs, seed)
    inner = [f"_c{i}" for i in range(len(docs.columns))]  # any column names may come in
    names = dict(zip(docs.columns, inner, strict=True))
    body = docs.select(
        F.struct(*[F.col(f"`{n}`").alias(names[n]) for n in docs.columns]).alias("whole_row"), "`doc_id`", "`text`", "`source`")
    chosen = taken_words(keyed(body, seed), planned).where("size > 0 AND taken > 0").select(
        "whole_row", "text", "size", F.col("taken").cast("long").alias("taken"))
    copies = F.concat(
        F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")),
        F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.expr("array()").cast("array<bigint>")))
    repeated = chosen.withColumn("words", F.explode(copies))
    repeated = repeated.withColumn("head", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(
        first_words(F.col("text"), F.col("words"))))
    out = []
    for field in docs.schema.fields:
        value = F.col("whole_row")[names[field.name]]
        if field.name == "text":
            value = F.col("head")
        elif field.name == "n_chars":
            value = F.when(F.col("words") == F.col("size"), value).otherwise(F.length("head").cast(field.dataType))
        out.append(value.alias(field.name))
    return repeated.select(*out)
