"""A stored inverted index for BM25: written once, updated by changed chunks, searched without reading a text.

An index folder holds numbered segments of four tables:

* ``forward``   one row per chunk version: length, hash of the text, terms with their counts; no terms for a deleted chunk;
* ``postings``  blocks of at most ``BLOCK`` entries of one term of one tenant, with the largest count and the smallest length
  in the block, which bound the score of every entry whatever the averages are by then;
* ``removed``   blocks of the entries of versions that a segment replaced or deleted;
* ``totals``    number of chunks and of words per tenant, added or taken away by the segment. It is written last: a segment
  without it does not count, and a build or an update that is run again writes its segment anew.

Postings lie in ``parts`` folders by hash of (tenant, term), so a search reads the folders of its terms only. A task makes
blocks of about ``RUN`` entries at a time, from the forward table, and sorts each term's entries in them by weight: no entry is
shuffled. A search opens the blocks of each term with the best bounds, takes the k-th best sum so far as a lower bound, and then
opens those blocks whose own bound and those of the query's other terms together reach it. What is left closed cannot be among the
first k, so results equal a full scan. Neither are texts shuffled, but those that an update finds changed and those of repeated keys.

Defined results: (tenant_id, chunk_id) is the key of a chunk; of repeated rows the one with the greatest text counts. A null
text is an empty one, which counts as a chunk without words.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.operators.retrieval import BM25_B, BM25_K1, DEFAULT_K, text_hash, tokens
from cuentaclara.operators.skew import top_per_key
from cuentaclara.sources.tables import finished, staged, subfolders

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 128
#: Entries that a task sorts at once.
RUN = 500_000
#: Rows with texts or words that go to Python at once; the usual 10,000 hold millions of words.
BATCH_ROWS = 500
PARTS = 64
#: Places of the hash of a key by which rows that cannot match are left out before a join; a bit each.
MARKS = 1 << 24
#: Blocks of a query's term that are opened first.
FIRST_BLOCKS = 2
#: Terms of a batch of queries up to which they are sent to all tasks, so that blocks of other terms are not shuffled.
FEW_TERMS = 100_000
#: Scores are rounded to six digits; closer bounds are not told apart.
MARGIN = 2e-6
KEY = ["tenant_id", "chunk_id"]
TERMS = "array<struct<term: string, tf: int>>"
FORWARD = f"tenant_id string, chunk_id string, length int, text_hash bigint, terms {TERMS}, version int, part int"
HEADERS = "tenant_id string, term string, block bigint, n int, max_tf int, min_length int, version int, part int"
BLOCKS = ("tenant_id string, term string, block bigint, n int, max_tf int, min_length int, "
          "entries array<struct<chunk_id: string, version: int, tf: int, length: int>>, version int, part int")
TOTALS = "tenant_id string, docs bigint, words bigint, version int"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    root: str
    parts: int = PARTS

    def segments(self) -> list[int]:
        folder = f"{self.root}/totals"
        numbers = [int(n.split("=")[1]) for n in subfolders(self.spark, folder) if n.startswith("segment=")]
        return sorted(n for n in numbers if finished(self.spark, f"{folder}/segment={n}"))

    def path(self, segment: int, table: str) -> str:
        return f"{self.root}/{table}/segment={segment}"

    def table(self, name: str, schema: str) -> DataFrame:
        """One table over all finished segments."""
        paths = [p for p in (self.path(n, name) for n in self.segments()) if finished(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).drop("segment")

    def part(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.parts)).cast("int")

    def of_parts(self, name: str, schema: str, rows: DataFrame) -> DataFrame:
        """Only the folders that ``rows`` (with a column part) point to. What is collected is at most one number per folder."""
        wanted = [r["part"] for r in rows.select("part").distinct().collect()]
        return self.table(name, schema).where(F.col("part").isin(wanted))

    def of_terms(self, name: str, schema: str, asked: DataFrame) -> DataFrame:
        """Only the blocks of the terms of ``asked``, read from their folders."""
        terms = asked.select("part", "tenant_id", "term").distinct()
        few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
        return self.of_parts(name, schema, asked).join(F.broadcast(terms) if few else terms, ["part", "tenant_id", "term"], "left_semi")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are evaluated once per row: the generator keeps them from being copied into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def latest_texts(chunks: DataFrame) -> DataFrame:
    """tenant_id, chunk_id and chunk_text, one row per key. Only texts of repeated keys are shuffled, which are found without any text."""
    rows = chunks.select(*KEY, F.coalesce(F.col("chunk_text"), F.lit("")).alias("chunk_text"))
    repeated = staged(chunks.select(*KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEY), "repeated-keys")
    if repeated.isEmpty():
        return rows
    marked = _marked(rows, repeated, KEY)
    several = marked.where("_marked").groupBy(*KEY).agg(F.max("chunk_text").alias("chunk_text"))
    return marked.where("NOT _marked").drop("_marked").unionByName(several)


def _marked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` and a column _marked: false where no row of ``keys`` has their columns ``on``. It is true of few others.

    Tasks get one bit for each of ``MARKS`` places of the hash of a key, so what is sent to them does not grow.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(MARKS)).cast("int")
    words = keys.select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits")).toArrow()
    marks = np.zeros(MARKS // 64, dtype="int64")
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared, carried = rows.sparkSession.sparkContext.broadcast(marks.view("uint8")), rows.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.column("_place").to_numpy()
            found = (shared.value[at >> 3] >> (at & 7).astype("uint8") & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(found)], names=[*carried, "_marked"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select("*", place.alias("_place")).mapInArrow(run, f"{kinds}, _marked boolean")


def _matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose columns ``on`` are those of a row of ``keys``, nulls included; few others are shuffled."""
    wanted = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return _marked(rows, keys, on).where("_marked").drop("_marked").join(wanted, same, "left_semi")


def counted_terms(rows: DataFrame) -> DataFrame:
    """tenant_id, chunk_id, length, text_hash and terms. Words are sorted, so equal ones are runs; no word is shuffled."""
    rows = _once(rows, _words=F.sort_array(tokens(F.col("chunk_text"))))
    at = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(F.array().cast("array<int>"))
    first = F.filter(at, lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    rows = _once(rows, _first=first)
    terms = F.transform("_first", lambda i, j: F.struct(
        F.get("_words", i).alias("term"), (F.coalesce(F.get("_first", j + 1), F.size("_words")) - i).alias("tf")))
    return rows.select(*KEY, F.size("_words").alias("length"), text_hash(F.col("chunk_text")).alias("text_hash"), terms.alias("terms"))


def build(index: Index, chunks: DataFrame) -> None:
    """The first segment, from a whole chunk table."""
    _write_segment(index, 0, counted_terms(latest_texts(chunks)), None)


def update(index: Index, changed: DataFrame, deleted: DataFrame | None = None) -> int | None:
    """A further segment from new or changed chunks and the keys of deleted ones; its number, or None where nothing differs.

    Chunks whose text is the one indexed already are left alone. The old versions come from the forward table.
    """
    have = index.segments()
    if not have:
        raise ValueError("build the index first")
    version = have[-1] + 1
    fresh, keys = latest_texts(changed), changed.select(*KEY).distinct()
    # Hashes say which texts differ; words are taken from those alone, once. Only folders that hold one of the keys are read.
    hashed = fresh.select(*KEY, text_hash(F.col("chunk_text")).alias("_new"))
    if deleted is not None:
        gone = deleted.select(*KEY).distinct().join(keys, KEY, "left_anti")
        hashed, keys = hashed.unionByName(gone.withColumn("_new", F.lit(None).cast("bigint"))), keys.unionByName(gone)
    known = current_forward(index, keys.withColumn("part", index.part(*KEY)), ["length", "text_hash"]).select(
        *KEY, F.col("text_hash").alias("_hash"), F.col("length").alias("_length"), F.col("version").alias("_version"))
    differs = staged(hashed.join(known, KEY, "left").where(~F.col("_new").eqNullSafe(F.col("_hash"))).select(
        *KEY, F.col("_new").isNotNull().alias("_there"), "_length", "_version"), "changed-keys")
    if differs.isEmpty():
        return None
    # A deleted chunk has no text, and neither words nor a hash.
    counted = counted_terms(_matching(fresh, differs.where("_there"), KEY)).unionByName(differs.where("NOT _there").select(
        *KEY, F.lit(None).cast("int").alias("length"), F.lit(None).cast("bigint").alias("text_hash"), F.lit(None).cast(TERMS).alias("terms")))
    _write_segment(index, version, counted, differs.where("_version IS NOT NULL"))
    return version


def current_forward(index: Index, keys: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The newest version of each chunk that still exists, of all chunks or of the given (tenant_id, chunk_id, part)."""
    rows = index.table("forward", FORWARD)
    if keys is not None:
        rows = index.of_parts("forward", FORWARD, keys).join(keys.select(*KEY), KEY, "left_semi")
    if columns is not None:
        rows = rows.select(*KEY, *columns, "version")
    return top_per_key(rows, KEY, [F.col("version").desc()], 1, "_rank").drop("_rank").where(F.col("length").isNotNull())


def _write_segment(index: Index, version: int, fresh: DataFrame, replaced: DataFrame | None) -> None:
    """``replaced`` has keys, _version and _length of the old versions of what is in ``fresh``."""
    def write(df: DataFrame, table: str) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = index.spark.conf.get(key)
        index.spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
        try:
            (writer.partitionBy("part") if "part" in df.columns else writer).parquet(index.path(version, table))
        finally:
            index.spark.conf.set(key, before)
        return index.spark.read.schema(df.schema).parquet(index.path(version, table))

    def write_blocks(rows: DataFrame, table: str) -> None:
        write(_blocks(rows).withColumn("part", index.part("tenant_id", "term")), table)

    spelled = F.lit(version).alias("version")
    if replaced is not None:
        keys = replaced.select(*KEY, F.col("_version").alias("version"))
        old = index.of_parts("forward", FORWARD, keys.select(index.part(*KEY).alias("part"))).select(*KEY, "length", "terms", "version")
        write_blocks(_matching(old, keys, [*KEY, "version"]), "removed")
    forward = write(fresh.select("*", spelled, index.part(*KEY).alias("part")), "forward")
    write_blocks(forward, "postings")
    added = forward.where("terms IS NOT NULL").select("tenant_id", F.lit(1).alias("docs"), "length")
    if replaced is not None:
        added = added.unionByName(replaced.select("tenant_id", F.lit(-1).alias("docs"), (-F.col("_length")).alias("length")))
    totals = added.groupBy("tenant_id").agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("length").cast("bigint").alias("words")).select("*", spelled)
    write(totals, "totals")


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of the entries of rows (tenant_id, chunk_id, length, version, terms): a task sorts ``RUN`` entries at a time by
    tenant, term and weight and cuts them, so what it holds does not grow with a term or with the table."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40

        def cut(held: list) -> pa.RecordBatch:
            def column(name: str):
                parts = [b.column(name) for b in held]
                return pa.concat_arrays([p.cast(pa.large_string()) if pa.types.is_string(p.type) else p for p in parts])

            terms = column("terms")
            n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype("int64")
            row, flat = np.repeat(np.arange(len(n)), n), terms.flatten()
            term, tenant = flat.field("term").dictionary_encode(), column("tenant_id").dictionary_encode()
            tf, length = flat.field("tf").to_numpy(), column("length").to_numpy(zero_copy_only=False)[row]
            owner = pc.fill_null(tenant.indices, len(tenant.dictionary)).to_numpy()[row].astype("int64")
            group = owner * (len(term.dictionary) + 1) + term.indices.to_numpy()
            weight = tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / 100.0))
            order = np.lexsort((-weight, group))
            group, row, tf, length = group[order], row[order], tf[order], length[order].astype("int32")
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(starts[1:], len(group))
            many = (ends - starts + BLOCK - 1) // BLOCK
            at = np.repeat(starts - (np.cumsum(many) - many) * BLOCK, many) + np.arange(int(many.sum())) * BLOCK
            bounds, rows_ = np.append(at, len(group)), pa.array(row)
            versions = column("version").take(rows_)
            entry = pa.StructArray.from_arrays(
                [column("chunk_id").take(rows_).cast(pa.string()), versions, pa.array(tf), pa.array(length)], names=["chunk_id", "version", "tf", "length"])
            return pa.RecordBatch.from_arrays(
                [column("tenant_id").take(rows_.take(pa.array(at))).cast(pa.string()), flat.field("term").take(pa.array(order[at])).cast(pa.string()),
                 pa.array(number + np.arange(len(at))), pa.array(np.diff(bounds), pa.int32()), pa.array(np.maximum.reduceat(tf, at)),
                 pa.array(np.minimum.reduceat(length, at)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entry), versions.take(pa.array(at))],
                names=["tenant_id", "term", "block", "n", "max_tf", "min_length", "entries", "version"])

        held, size = [], 0
        for batch in batches:
            amounts = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = int(amounts[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(amounts, before + RUN - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size, start = size + int(amounts[stop - 1]) - before, stop
                if size >= RUN or start < batch.num_rows:
                    if size:
                        made = cut(held)
                        number += made.num_rows
                        yield made
                    held, size = [], 0
        if size:
            yield cut(held)

    kinds = BLOCKS.removesuffix(", part int")
    return rows.select("tenant_id", "chunk_id", "length", "version", "terms").mapInArrow(run, kinds)


def _weight(tf: Column, length: Column, k1: float, b: float) -> Column:
    return F.col("_idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("_corpus_length")))


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "tenant_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term")).withColumn(
        "part", index.part("tenant_id", "term"))


def bounded_blocks(index: Index, queries: DataFrame, *, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Per query and block of its terms: idf, average length and the largest score that an entry can have. Reads no entries."""
    asked = asked_terms(index, queries)
    headers = index.of_terms("postings", HEADERS, asked)
    dead = index.of_terms("removed", HEADERS, asked).groupBy("tenant_id", "term").agg(F.sum("n").alias("_dead"))
    amounts = headers.groupBy("tenant_id", "term").agg(F.sum("n").alias("_all")).join(dead, ["tenant_id", "term"], "left").select(
        "tenant_id", "term", (F.col("_all") - F.coalesce("_dead", F.lit(0))).alias("_df"))
    totals = index.table("totals", TOTALS).groupBy("tenant_id").agg(F.sum("docs").alias("_docs"), (F.sum("words") / F.sum("docs")).alias("_corpus_length"))
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    rated = asked.join(amounts.where("_df > 0"), ["tenant_id", "term"]).join(totals, "tenant_id").withColumn("_idf", idf)
    found = headers.join(rated, ["part", "tenant_id", "term"])
    return found.select("query_id", "tenant_id", "term", "part", "version", "block", "_idf", "_corpus_length",
                        _weight(F.col("max_tf"), F.col("min_length"), k1, b).alias("_bound"))


def _scores(index: Index, opened: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """Sums per query and chunk over the entries of the opened blocks, without replaced versions."""
    place = ["part", "tenant_id", "term", "version", "block"]
    # Blocks of other terms are left out before the join with the opened ones, whose size is not known then.
    blocks = index.of_terms("postings", BLOCKS, asked).select(*place, "entries").join(opened, place)
    entries = blocks.select("query_id", "tenant_id", "term", "part", "_idf", "_corpus_length", F.inline("entries"))
    same = [*KEY, "part", "term", "version"]
    dead = index.of_terms("removed", BLOCKS, asked).select("tenant_id", "term", "part", F.inline("entries")).select(*same)
    alive = entries.join(dead, same, "left_anti")
    return alive.groupBy("query_id", *KEY).agg(F.sum(_weight(F.col("tf"), F.col("length"), k1, b)).alias("_sum"))


def opened_blocks(index: Index, queries: DataFrame, k: int = DEFAULT_K, *, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """The blocks that can hold one of the first ``k`` of a query."""
    blocks = staged(bounded_blocks(index, queries, k1=k1, b=b), "bounded-blocks")
    first = top_per_key(blocks, ["query_id", "tenant_id", "term"], [F.col("_bound").desc(), F.col("version"), F.col("block")], FIRST_BLOCKS, "_place").drop("_place", "_bound")
    ahead = top_per_key(_scores(index, first, asked_terms(index, queries), k1, b), ["query_id", "tenant_id"], [F.col("_sum").desc(), F.col("chunk_id")], k, "_place")
    floor = ahead.groupBy("query_id", "tenant_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("_sum")).alias("_floor"))
    best = blocks.groupBy("query_id", "tenant_id", "term").agg(F.max("_bound").alias("_best"))
    together = best.groupBy("query_id", "tenant_id").agg(F.sum("_best").alias("_together"))
    reach = blocks.join(best, ["query_id", "tenant_id", "term"]).join(together, ["query_id", "tenant_id"]).join(floor, ["query_id", "tenant_id"], "left")
    possible = F.col("_bound") + F.col("_together") - F.col("_best") >= F.coalesce("_floor", F.lit(0.0)) - MARGIN
    return reach.where(possible).select(*[c for c in blocks.columns if c != "_bound"])


def topk(index: Index, queries: DataFrame, k: int = DEFAULT_K, *, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 top ``k`` per query within its tenant, as ``retrieval.lexical_topk`` gives it from the texts."""
    opened = staged(opened_blocks(index, queries, k, k1=k1, b=b), "opened-blocks")
    scored = _scores(index, opened, asked_terms(index, queries), k1, b)
    rounded = scored.select("query_id", *KEY, F.round("_sum", 6).alias("lexical_score"))
    return top_per_key(rounded, ["query_id"], [F.col("lexical_score").desc(), F.col("chunk_id")], k, "rank")


def compact(index: Index, target: Index) -> None:
    """All segments as the first one of another folder, from the forward table alone."""
    rows = current_forward(index).select(*KEY, "length", "text_hash", "terms")
    _write_segment(target, 0, rows, None)

