"""License passages by diagonal voting: word grams of documents meet template positions, votes add up along diagonals.

Every position of every document gives the gram of the next two words, and of the next three where the template has
that many. A hash join with the positions of the templates gives hits; the words themselves are compared, so a hash clash
counts for nothing. A hit at word i of a document and word j of a template votes for the diagonal i - j. Votes are added per diagonal,
neighbouring diagonals (words inserted or lost in between) are merged, and the merged span is verified: the votes
must cover ``COVERAGE`` of the template's grams, and the span may not be longer than ``STRETCH`` times the template.

The templates are a parameter of fixed size, so their positions are broadcast. Texts are read once and never shuffled;
what moves are one row per document and its hits.

Defined results: a null or empty text has no words, no labels and score 0. Rows with the same doc_id are scored apart,
rows repeated in full give equal rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuentaclara.llm.common import once, own_columns

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COVERAGE = 0.6
STRETCH = 1.5
#: Diagonals that differ by at most so many words belong to one passage.
GAP = 4

# Short phrases that count wherever they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening sentences of public license notices, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "this work is licensed under a creative commons attribution sharealike": "cc-by-sa",
    "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential": "proprietary",
}


def positions(spark: SparkSession, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """One row per template position: template, label, base, length, grams, at, w1, w2, w3 (null for two-word phrases)."""
    rows = []
    for number, (text, label, base) in enumerate(
            [(t, v, True) for t, v in phrases.items()] + [(t, v, False) for t, v in notices.items()]):
        words = text.split()
        k = min(3, len(words))
        if k < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        for at in range(len(words) - k + 1):
            third = words[at + 2] if k == 3 else None
            rows.append((number, label, base, len(words), len(words) - k + 1, at, words[at], words[at + 1], third))
    schema = "template int, label string, base boolean, length int, grams int, at int, w1 string, w2 string, w3 string"
    return spark.createDataFrame(rows, schema)


def hits(docs: DataFrame, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """Template places found per row, template and diagonal; and one row without a template per document, so that none gets lost."""
    spark = docs.sparkSession
    rows = own_columns(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    plain = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = once(rows, words=F.array_remove(F.split(plain, SEPARATORS), "")).drop("text")
    # Place -1 stands for the document itself.
    placed = rows.select("doc_id", "row", "words", F.size("words").alias("n_words"),
                         F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("i"))
    grams = placed.select("doc_id", "row", "n_words", "i", *[F.get("words", F.col("i") + k).alias(f"d{k + 1}") for k in range(3)])
    grams = grams.withColumn("gram", F.when(F.col("i") >= 0, F.xxhash64("d1", "d2")))
    spots = positions(spark, phrases, notices).withColumn("spot", F.xxhash64("w1", "w2"))
    same = ((F.col("gram") == F.col("spot")) & (F.col("d1") == F.col("w1")) & (F.col("d2") == F.col("w2"))
            & (F.col("w3").isNull() | (F.col("w3") == F.col("d3"))))
    found = grams.join(F.broadcast(spots), same, "left").where("template IS NOT NULL OR i = -1")
    return found.groupBy(
        "row", "doc_id", "n_words", "template", "label", "base", "length", "grams", (F.col("i") - F.col("at")).alias("diagonal")
    ).agg(F.collect_set("at").alias("places"), F.min("i").alias("low"), F.max("i").alias("high"))


def passages(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged into spans: row, doc_id, n_words, label, base, first and last word, coverage."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(GAP)
    groups = voted.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("group", F.sum("new").over(order))
    # A template place counts once in a span, however often a phrase is repeated there.
    spans = groups.withColumn("place", F.explode_outer("places")).groupBy(
        "row", "doc_id", "n_words", "template", "label", "base", "length", "grams", "group").agg(
        F.size(F.collect_set("place")).alias("votes"), F.min("low").alias("first"), F.max("high").alias("last_gram"))
    width = F.col("last_gram") - F.col("first") + F.col("length") - F.col("grams") + 1
    coverage = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    verified = F.col("template").isNull() | ((coverage >= COVERAGE) & (width <= STRETCH * F.col("length")))
    return spans.select(
        "row", "doc_id", "n_words", "template", "label", "base", "first", (F.col("first") + width).alias("end"),
        coverage.alias("coverage"), verified.alias("verified"))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = passages(hits(docs, phrases, notices))
    base = F.col("verified") & F.col("base")
    mine = F.col("verified") & F.col("template").isNotNull()
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(mine, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(mine, F.col("coverage"))), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
