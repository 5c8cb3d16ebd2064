"""Semantic, lexical and hybrid retrieval over expense chunks.

All searches take a *batch* of queries (query_id, tenant_id, ...), never a whole corpus on
both sides: a chunk meets only the queries of its own tenant, and each task keeps at most
k rows per query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuentaclara.functions import vectors
from cuentaclara.operators.cdc import fold_latest
from cuentaclara.operators.skew import top_per_key
from cuentaclara.sources.tables import bucketed, has_rows_folder, read_table, replace_keys, staged

DEFAULT_K = 10
#: Scores below the floor are noise; damping of reciprocal rank fusion; BM25 form.
MIN_SCORE = 0.55
RRF_K = 60
BM25_K1 = 1.2
BM25_B = 0.75

#: Parts into which the chunks of a tenant are cut for joins; queries are repeated for each.
SALTS = 32

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


# --- embedding log ------------------------------------------------------------------------


def latest_embeddings(log: DataFrame) -> DataFrame:
    """Newest embedding per (chunk, tenant) of the append-only log."""
    return fold_latest(log, ["chunk_id", "tenant_id"], ["updated_at"])


def with_latest_embedding(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Every chunk with its newest embedding, NULL where none was written yet."""
    newest = latest_embeddings(log.select("chunk_id", "tenant_id", "embedding", "updated_at"))
    return chunks.join(newest.withColumnRenamed("updated_at", "embedded_at"), ["chunk_id", "tenant_id"], "left")


def missing_embeddings(chunks: DataFrame, log: DataFrame) -> DataFrame:
    return chunks.join(log.select("chunk_id", "tenant_id"), ["chunk_id", "tenant_id"], "left_anti")


def embeddings_of_expenses(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings whose chunk belongs to one of the given chunks' expenses, with a short preview."""
    wanted = chunks.select("chunk_id").distinct()
    return log.join(wanted, "chunk_id", "left_semi").select(
        "chunk_id", "tenant_id", "updated_at",
        F.size("embedding").alias("dimensions"),
        F.slice("embedding", 1, 8).alias("head"),
    )


def embedding_coverage(chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Chunks and embedded chunks per tenant; re-embedded chunks count once."""
    have = latest_embeddings(log.select("chunk_id", "tenant_id", "updated_at")).select(
        "chunk_id", "tenant_id", F.lit(1).alias("_has")
    )
    return (
        chunks.join(have, ["chunk_id", "tenant_id"], "left")
        .groupBy("tenant_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.count("_has").alias("with_emb"))
    )


def embed(chunks: DataFrame, embedder: Embedder, *, batch_size: int = 16, text: str = "chunk_text",
          vector_type: str = "array<float>") -> DataFrame:
    """Embed chunk texts in batches inside the tasks; the embedder is supplied by the caller.

    A batch whose result count differs from its input count fails the task, so a partial
    answer can never shift vectors onto the wrong chunks.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.DataType.fromDDL(vector_type))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                texts = part[text].fillna("").tolist()
                found = embedder(texts)
                if len(found) != len(texts):
                    raise RuntimeError(f"asked for {len(texts)} embeddings, got {len(found)}")
                yield part.assign(embedding=[[float(x) for x in v] for v in found])

    return chunks.mapInPandas(run, schema)


def complete_embeddings(chunks: DataFrame, log: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunks with a vector each: stored ones as they are, the others embedded on the fly."""
    newest = latest_embeddings(log.select("chunk_id", "tenant_id", "embedding", "updated_at"))
    have = newest.where(F.size("embedding") > 0)
    stored = chunks.join(have.drop("updated_at"), ["chunk_id", "tenant_id"])
    # An empty vector is none; its chunk is embedded like one that was never written.
    fresh = embed(chunks.join(have.select("chunk_id", "tenant_id"), ["chunk_id", "tenant_id"], "left_anti"), embedder)
    return stored.unionByName(fresh)


def revectorize(
    chunks: DataFrame, log: DataFrame, selected: Column, embedder: Embedder, now: Column
) -> DataFrame:
    """New content of the embedding table: selected chunks re-embedded, all others untouched."""
    target = chunks.where(selected).select("chunk_id", "tenant_id", "chunk_text")
    kept = log.join(target.select("chunk_id"), "chunk_id", "left_anti")
    fresh = embed(target, embedder).select("chunk_id", "tenant_id", "embedding", now.alias("updated_at"))
    return kept.select("chunk_id", "tenant_id", "embedding", "updated_at").unionByName(fresh)


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def changed_chunks(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks that are new or whose text differs from the text last embedded.

    ``embedded`` holds (chunk_id, tenant_id, text_hash).
    """
    known = embedded.select("chunk_id", "tenant_id", F.col("text_hash").alias("_hash"))
    joined = chunks.withColumn("text_hash", text_hash(F.col("chunk_text"))).join(
        known, ["chunk_id", "tenant_id"], "left"
    )
    return joined.where(~F.col("text_hash").eqNullSafe(F.col("_hash"))).drop("_hash")


def sync_embeddings(
    chunks: DataFrame, path: str, embedder: Embedder, now: Column, *, within: DataFrame | None = None
) -> dict[str, int]:
    """Bring an embedding table in step with the chunks; returns how many were embedded and how many removed.

    The table keeps the hash of the text beside each vector. New and edited chunks are embedded, vectors of chunks that
    are no more go, and only the partitions they touch are written; a second run does nothing. ``within`` (chunk_id)
    says which chunks can have changed; without it the whole table is compared, hashes only.
    """
    spark = chunks.sparkSession
    if has_rows_folder(spark, path):
        known = read_table(spark, path).select("chunk_id", "tenant_id", "text_hash")
    else:
        known = spark.createDataFrame([], "chunk_id string, tenant_id string, text_hash bigint")
    if within is not None:
        chunks, known = (df.join(within.select("chunk_id").distinct(), "chunk_id", "left_semi") for df in (chunks, known))
    changed = changed_chunks(chunks.select("chunk_id", "tenant_id", "chunk_text"), known)
    fresh = staged(embed(changed, embedder).select(
        "chunk_id", "tenant_id", F.col("embedding").cast("array<float>").alias("embedding"), now.alias("updated_at"), "text_hash"), "embeddings")
    gone = staged(known.join(chunks.select("chunk_id", "tenant_id"), ["chunk_id", "tenant_id"], "left_anti").select("chunk_id"), "embeddings-gone")
    done = {"embedded": fresh.count(), "removed": gone.count()}
    if any(done.values()):
        replace_keys(bucketed(fresh, "chunk_id"), fresh.select("chunk_id").unionByName(gone), path, "chunk_id")
    return done


def revectorize_table(chunks: DataFrame, path: str, selected: Column, embedder: Embedder, now: Column) -> int:
    """Embed the selected chunks anew, whatever their text was, and write only the partitions they touch."""
    target = chunks.where(selected).select("chunk_id", "tenant_id", "chunk_text", text_hash(F.col("chunk_text")).alias("text_hash"))
    fresh = staged(embed(target, embedder).select(
        "chunk_id", "tenant_id", F.col("embedding").cast("array<float>").alias("embedding"), now.alias("updated_at"), "text_hash"), "embeddings")
    replace_keys(bucketed(fresh, "chunk_id"), fresh, path, "chunk_id")
    return fresh.count()


# --- search -------------------------------------------------------------------------------


def _parts(chunks: DataFrame) -> DataFrame:
    """Chunks with the part of their tenant they belong to, so that a large tenant is many tasks."""
    return chunks.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)))


def _for_parts(queries: DataFrame) -> DataFrame:
    """Queries once per part. Whether they are sent to every task is left to their measured bytes."""
    return queries.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def semantic_topk(embedded: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Exact cosine top ``k`` per query within the query's tenant.

    ``embedded`` has chunk_id, tenant_id, embedding (+ payload); ``queries`` has query_id,
    tenant_id, query_vec. Chunks without a vector are skipped.
    """
    side = queries.select(
        "query_id", "tenant_id", "query_vec", vectors.norm(F.col("query_vec")).alias("_query_norm")
    )
    # Lengths are taken once per vector, and only ids go through the ranking; the payload joins the k that remain.
    slim = embedded.where(F.size("embedding") > 0).select(
        "chunk_id", "tenant_id", "embedding", vectors.norm(F.col("embedding")).alias("_chunk_norm"))
    scored = _parts(slim).join(_for_parts(side), ["tenant_id", "_part"]).select(
        "query_id", "tenant_id", "chunk_id",
        vectors.cosine(F.col("query_vec"), F.col("embedding"), F.col("_query_norm"), F.col("_chunk_norm")).alias("_cosine"),
    )
    best = top_per_key(scored, ["query_id"], [F.col("_cosine").desc(), F.col("chunk_id")], k, "rank")
    payload = [c for c in embedded.columns if c != "embedding"]
    hits = best.withColumn("score", F.round("_cosine", 4)).drop("_cosine")
    return hits if payload == ["chunk_id", "tenant_id"] else hits.join(embedded.select(*payload), ["chunk_id", "tenant_id"])


BLOCK_ROWS = 8192
BLOCK_QUERIES = 4096


def semantic_topk_many(embedded: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """``semantic_topk`` for batches of queries that grow with the table: the same query_id, tenant_id, chunk_id, rank and score.

    All pairs are looked at, in blocks of bounded size: a matrix product says which rows of a block can be among the first ``k`` of
    a query, those are scored as ``vectors.cosine`` does it, and ``k`` of them leave the block. Vectors with null or extreme
    components or of an unusual width are scored pair by pair.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = embedded.where((F.size("embedding") > 0) & F.col("tenant_id").isNotNull()).select("chunk_id", "tenant_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where("tenant_id IS NOT NULL").select("query_id", "tenant_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    usual = rows.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("w", F.struct("n", "w")), F.sum("n")).first()
    width, n_rows, n_asked = usual[0] or 0, usual[1] or 0, asked.count()

    def plain(vector: str) -> Column:
        fine = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) <= 1e100)) & F.exists(vector, lambda x: F.abs(x) >= 1e-100)
        return F.coalesce(fine, F.lit(False))

    def parts(n: int, size: int) -> Column:
        return F.lit(max(1, -(-n // size))).cast("bigint")

    def each(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    row_parts, query_parts = parts(n_rows, BLOCK_ROWS), parts(n_asked, BLOCK_QUERIES)
    left = rows.where(plain("embedding")).withColumn("_r", F.pmod(F.xxhash64("chunk_id"), row_parts)).withColumn("_q", each(query_parts))
    right = asked.where(plain("query_vec")).withColumn("_q", F.pmod(F.xxhash64("query_id"), query_parts)).withColumn("_r", each(row_parts))

    def in_order(products):
        total = np.zeros(len(products))
        for j in range(products.shape[1]):  # as the column expressions add, so that equal vectors have equal scores
            total = total + products[:, j]
        return total

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def score(block, asked_rows):
        found: list[list] = [[], [], []]
        if block.num_rows and asked_rows.num_rows:
            block = block.take(pc.sort_indices(block, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
            have, want = matrix(block.column("embedding")), matrix(asked_rows.column("query_vec"))
            have_norm, want_norm = np.sqrt(in_order(have * have)), np.sqrt(in_order(want * want))
            units, take = have / have_norm[:, None], min(k, len(have))
            for i in range(0, len(want), 256):
                similar = (want[i: i + 256] / want_norm[i: i + 256, None]) @ units.T
                least = -np.partition(-similar, take - 1, axis=1)[:, take - 1: take]
                for q, near in enumerate(similar >= least - 1e-9, i):
                    what = np.flatnonzero(near)
                    exact = in_order(want[q] * have[what]) / (want_norm[q] * have_norm[what])
                    first = np.argsort(-exact, kind="stable")[:take]  # rows are in the order of their identifiers
                    found[0].append(np.full(len(first), q))
                    found[1].append(what[first])
                    found[2].append(exact[first])
        who, what, exact = (np.concatenate(x) if x else np.zeros(0) for x in found)
        picked = pa.array(who.astype("int64"))
        return pa.Table.from_arrays(
            [*[asked_rows.column(c).combine_chunks().take(picked) for c in ("query_id", "tenant_id")],
             block.column("chunk_id").combine_chunks().take(pa.array(what.astype("int64"))), pa.array(exact.astype("float64"))],
            names=["query_id", "tenant_id", "chunk_id", "_cosine"])

    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    schema = f"query_id {kinds['query_id']}, tenant_id {kinds['tenant_id']}, chunk_id {kinds['chunk_id']}, _cosine double"
    keys = ["tenant_id", "_r", "_q"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
    for some, others in ((rows.where(~plain("embedding")), asked), (rows.where(plain("embedding")), asked.where(~plain("query_vec")))):
        pairs = _parts(some).join(_for_parts(others), ["tenant_id", "_part"])
        scored = scored.unionByName(pairs.select("query_id", "tenant_id", "chunk_id", vectors.cosine(F.col("query_vec"), F.col("embedding")).alias("_cosine")))
    best = top_per_key(scored, ["query_id"], [F.col("_cosine").desc(), F.col("chunk_id")], k, "rank")
    return best.withColumn("score", F.round("_cosine", 4)).drop("_cosine")


def above_floor(hits: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Applied after the top k; hits without a score pass."""
    return hits.where(F.col("score").isNull() | (F.col("score") >= min_score))


def citable(hits: DataFrame) -> DataFrame:
    """Semantic hits in citation shape; hits without an expense cannot be cited."""
    return hits.where(F.coalesce(F.col("expense_id"), F.lit("")) != "").withColumns({
        "link": F.concat(F.lit("/expenses/"), "expense_id"),
        "_source": F.lit("semantic"),
    })


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexical_topk(
    chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, k1: float = BM25_K1, b: float = BM25_B,
) -> DataFrame:
    """BM25 top ``k`` per query within its tenant. ``queries`` has query_id, tenant_id, query_text.

    Texts are read twice, once for the statistics and once for the scores, and never shuffled:
    term counts are taken inside each row, and what leaves a task is one row per (query, chunk)
    that share a term.
    """
    distinct_terms = F.array_distinct(tokens(F.col("query_text")))
    terms = queries.select("query_id", "tenant_id", F.explode(distinct_terms).alias("term"))
    vocabulary = terms.groupBy("tenant_id").agg(F.collect_set("term").alias("_vocabulary"))

    matched = F.filter("_tokens", lambda t: F.array_contains("_vocabulary", t))
    counted = F.transform(
        F.array_distinct("_matched"),
        lambda t: F.struct(t.alias("term"), F.size(F.filter("_matched", lambda m: m == t)).alias("tf")),
    )
    docs = (
        _parts(chunks.select("chunk_id", "tenant_id", tokens(F.coalesce("chunk_text", F.lit(""))).alias("_tokens")))
        .join(_for_parts(vocabulary), ["tenant_id", "_part"])
        .select("chunk_id", "tenant_id", F.size("_tokens").alias("_length"), matched.alias("_matched"))
        .select("chunk_id", "tenant_id", "_length", counted.alias("_hits"))
    )
    # One row per matched term, and one with an empty term that stands for the chunk itself.
    marks = F.concat(F.array(F.lit("")), F.transform("_hits", lambda h: h["term"]))
    tally = docs.select("tenant_id", "_length", F.explode_outer(marks).alias("term")).groupBy("tenant_id", "term").agg(
        F.count(F.lit(1)).alias("_df"), F.avg("_length").alias("_avg_length")
    )
    # The tally is small (terms of the batch per tenant); the window spares a second text scan.
    whole = Window.partitionBy("tenant_id")

    def of_corpus(name: str) -> Column:
        return F.max(F.when(F.col("term") == "", F.col(name))).over(whole)

    stats = tally.select(
        "tenant_id", "term", "_df",
        of_corpus("_df").alias("_docs"), of_corpus("_avg_length").alias("_corpus_length"),
    ).withColumn("_idf", F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    asked = terms.join(stats, ["tenant_id", "term"])
    weight = F.col("_idf") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("_length") / F.col("_corpus_length"))
    )
    scored = (
        # The outer form keeps Spark from deriving a size filter that repeats the matching.
        docs.select("chunk_id", "tenant_id", "_length", F.inline_outer("_hits"))
        .join(asked, ["tenant_id", "term"])
        .groupBy("query_id", "tenant_id", "chunk_id")
        .agg(F.round(F.sum(weight), 6).alias("lexical_score"))
    )
    return top_per_key(scored, ["query_id"], [F.col("lexical_score").desc(), F.col("chunk_id")], k, "rank")


def reciprocal_rank_fusion(rankings: Sequence[DataFrame], k: int = DEFAULT_K, damping: int = RRF_K) -> DataFrame:
    """Fuse rankings of (query_id, tenant_id, chunk_id, rank): sum of 1 / (damping + rank)."""
    votes = None
    for ranking in rankings:
        part = ranking.select(
            "query_id", "tenant_id", "chunk_id", (F.lit(1.0) / (F.lit(damping) + F.col("rank"))).alias("_vote")
        )
        votes = part if votes is None else votes.unionByName(part)
    fused = votes.groupBy("query_id", "tenant_id", "chunk_id").agg(
        F.round(F.sum("_vote"), 8).alias("rrf_score")
    )
    return top_per_key(fused, ["query_id"], [F.col("rrf_score").desc(), F.col("chunk_id")], k, "rank")


def hybrid_topk(
    chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, depth: int | None = None
) -> DataFrame:
    """Dense and lexical rankings, fused. ``queries`` carries both query_vec and query_text; ``depth`` is how far down
    each ranking is fused. The lexical side reads the chunks' texts, the dense side the newest embeddings of
    chunks that still exist."""
    depth = depth or k
    current = embeddings.join(chunks.select("chunk_id", "tenant_id"), ["chunk_id", "tenant_id"], "left_semi")
    dense = semantic_topk(current.select("chunk_id", "tenant_id", "embedding"), queries, depth)
    lexical = lexical_topk(chunks.select("chunk_id", "tenant_id", "chunk_text"), queries, depth)
    return reciprocal_rank_fusion([dense, lexical], k)


# --- approximate path ---------------------------------------------------------------------


def approximate_topk(
    embedded: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *, planes: int = 12, tables: int = 16, flips: int = 3,
    seed: int = 7,
) -> DataFrame:
    """Approximate neighbours for corpora too large to score in full.

    Each table cuts the space by ``planes`` random hyperplanes; the signs are one composite bucket. A query looks into its own
    bucket and those that differ in up to ``flips`` of the planes. Chunks that share a bucket and the tenant are candidates, scored
    exactly. Recall grows with ``tables`` and ``flips``, the share of candidates falls with ``planes``. The defaults find at least
    nine of ten neighbours also where the nearest are as far as a cosine of 0.2.
    """
    candidates = approximate_candidates(embedded, queries, planes=planes, tables=tables, flips=flips, seed=seed)
    scored = candidates.join(embedded.where(F.size("embedding") > 0), ["chunk_id", "tenant_id"]).join(
        queries.select("query_id", "tenant_id", "query_vec"), ["query_id", "tenant_id"]
    ).withColumn("_cosine", vectors.cosine(F.col("query_vec"), F.col("embedding"))).drop("query_vec", "embedding")
    best = top_per_key(scored, ["query_id"], [F.col("_cosine").desc(), F.col("chunk_id")], k, "rank")
    return best.withColumn("score", F.round("_cosine", 4)).drop("_cosine")


def approximate_candidates(
    embedded: DataFrame, queries: DataFrame, *, planes: int = 12, tables: int = 16, flips: int = 3, seed: int = 7,
) -> DataFrame:
    """Distinct (query_id, tenant_id, chunk_id) that share a bucket."""
    import itertools

    import numpy as np
    import pyarrow as pa

    masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in itertools.combinations(range(planes), n)]

    def buckets(column: str, ids: list[str]):
        def run(batches: Iterator) -> Iterator:
            for batch in batches:
                vectors_, out = batch.column(column).to_pylist(), [[] for _ in range(len(batch))]
                for width in {len(v) for v in vectors_ if v}:
                    rows = [i for i, v in enumerate(vectors_) if v and len(v) == width]
                    x = np.array([[float("nan") if y is None else y for y in vectors_[i]] for i in rows], dtype="float64")
                    normals = np.random.default_rng(seed).normal(size=(width, tables * planes))
                    signs = (x @ normals > 0).reshape(len(rows), tables, planes)
                    codes = (signs << np.arange(planes)).sum(axis=2) + (np.arange(tables) << planes)
                    for i, own, fine in zip(rows, codes, np.isfinite(x).all(axis=1), strict=True):
                        out[i] = own.tolist() if fine else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ids] + [pa.array(out, pa.list_(pa.int64()))], names=[*ids, "_codes"])
        return run

    chunk_ids, query_ids = ["chunk_id", "tenant_id"], ["query_id", "tenant_id"]
    kinds = dict(embedded.dtypes) | dict(queries.dtypes)
    ddl = {tuple(ids): ", ".join(f"{c} {kinds[c]}" for c in ids) + ", _codes array<bigint>" for ids in (chunk_ids, query_ids)}
    left = embedded.select(*chunk_ids, "embedding").mapInArrow(buckets("embedding", chunk_ids), ddl[tuple(chunk_ids)])
    right = queries.select(*query_ids, "query_vec").mapInArrow(buckets("query_vec", query_ids), ddl[tuple(query_ids)])
    left = left.select(*chunk_ids, F.explode("_codes").alias("_bucket"))
    flipped = F.explode(F.array(*[F.lit(m) for m in masks]))
    right = right.select(*query_ids, F.explode("_codes").alias("_own")).select(
        *query_ids, "_own", flipped.alias("_mask")).select(*query_ids, F.col("_own").bitwiseXOR(F.col("_mask")).alias("_bucket"))
    return left.join(right, ["tenant_id", "_bucket"]).select("query_id", "tenant_id", "chunk_id").distinct()
