"""Inverted lists and the stored inverted index against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuentaclara.operators import ivf, postings, retrieval

# --- inverted lists ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 40 centres, two tenants, and a third of the rows as one repeated vector."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    rows = [(f"c{i:05}", f"t{i % 2}", [float(x) for x in centers[i % 40] + 0.15 * rng.normal(size=16)]) for i in range(2000)]
    rows += [(f"same{i:05}", "t0", [float(x) for x in centers[3]]) for i in range(1000)]
    return rows, spark.createDataFrame(rows, "chunk_id string, tenant_id string, embedding array<double>").repartition(6).cache()


def nearest(rows, vector, tenant, k):
    own = [(c, np.array(v)) for c, t, v in rows if t == tenant]
    q = np.array(vector) / np.linalg.norm(vector)
    scored = sorted(((round(float(-(v @ q) / np.linalg.norm(v)), 9), c) for c, v in own))
    return [c for _, c in scored[:k]]


def test_lists_find_the_neighbours_and_open_few(spark, clustered, monkeypatch):
    rows, df = clustered
    monkeypatch.setattr(ivf, "CELL_ROWS", 200)  # the repeated vector fills several cells
    monkeypatch.setattr(ivf, "CELL_QUERIES", 8)
    asked = [(f"q{i}", rows[i * 37][1], rows[i * 37][2]) for i in range(50)]
    queries = spark.createDataFrame(asked, "query_id string, tenant_id string, query_vec array<double>")
    quantiser = ivf.train(df, "chunk_id", "embedding", lists=48, sample_rows=1500)
    index = ivf.index_rows(df, "chunk_id", "embedding", quantiser, ("tenant_id",))
    assert index.count() == len(rows)
    hits = ivf.search(index, df, queries, quantiser, 10).collect()
    got = {}
    for r in hits:
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score, r.tenant_id))
    found = 0
    for q, tenant, vector in asked:
        want = nearest(rows, vector, tenant, 10)
        mine = sorted(got[q])
        assert len(mine) == 10 and all(t == tenant for *_, t in mine)
        assert [s for _, _, s, _ in mine] == sorted((s for _, _, s, _ in mine), reverse=True)
        worst = min(s for _, _, s, _ in mine)
        found += sum(c in {m[1] for m in mine} or round(1.0, 4) == worst for c in want)  # of equal vectors any ten will do
    assert found / 500 >= 0.9
    assert quantiser.probes <= 12
    assert ivf.opened_share(index, queries, quantiser, query_id="query_id", query_vec="query_vec").first()[0] < 0.6


def test_a_written_index_is_read_by_list_and_without_vectors(spark, clustered, tmp_path):
    rows, df = clustered
    quantiser = ivf.train(df, "chunk_id", "embedding", lists=16, sample_rows=1000)
    ivf.write_index(ivf.index_rows(df, "chunk_id", "embedding", quantiser, ("tenant_id",)), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert set(index.columns) == {"chunk_id", "tenant_id", "code", "scale", "list_id"} and index.count() == len(rows)
    one = index.where("list_id = 3")
    assert "PartitionFilters: [isnotnull(list_id" in one._jdf.queryExecution().executedPlan().toString()
    queries = spark.createDataFrame([("q", "t1", rows[41][2])], "query_id string, tenant_id string, query_vec array<double>")
    top = ivf.search(index, df, queries, quantiser, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == nearest(rows, rows[41][2], "t1", 3)


def test_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("b", [2.0, 0.1]), ("null", None), ("empty", []), ("zero", [0.0, 0.0]), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]),
            ("hole", [None, 1.0]), ("wide", [1.0, 2.0, 3.0]), ("huge", [1e200, 1e200]), ("tiny", [1e-200, 1e-200]), ("opposite", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    quantiser = ivf.train(df, "chunk_id", "embedding", lists=3)
    index = ivf.index_rows(df, "chunk_id", "embedding", quantiser)
    assert sorted(r.chunk_id for r in index.collect()) == ["a", "b", "b", "huge", "opposite", "tiny"]
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec")).distinct()
    tried = ivf.candidates(index, queries, quantiser, id_col="chunk_id", query_id="query_id", vec_col="query_vec", probes=3).collect()
    assert {r.query_id for r in tried} == {"a", "b", "huge", "opposite", "tiny"}
    by = {(r.query_id, r.chunk_id): r.approx for r in tried}
    assert abs(by["huge", "tiny"] - 1) < 0.02 and by["a", "opposite"] < -0.98
    assert ivf.train(df.where("false"), "chunk_id", "embedding") is None and ivf.train(df.where("chunk_id = 'zero'"), "chunk_id", "embedding") is None


def test_isotropic_vectors_keep_their_recall(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = df.where("chunk_id % 30 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    quantiser = ivf.train(df, "chunk_id", "embedding")
    hits = ivf.search(ivf.index_rows(df, "chunk_id", "embedding", quantiser), df, asked, quantiser, 10, scope=None).collect()
    matrix = np.array([v for _, v in rows])
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    truth = {i: set(np.argsort(-(matrix @ matrix[i]), kind="stable")[:10].tolist()) for i in range(0, 1500, 30)}
    assert sum(r.chunk_id in truth[r.query_id] for r in hits) / 500 >= 0.9


def test_a_cell_gives_few_rows_and_keeps_the_order_of_ties(monkeypatch):
    monkeypatch.setattr(ivf, "CELL_ROWS", 100)
    cells, placed = ivf.packed({0: 60, 2: 30, 3: 250, 4: 20, 5: 90}, 7)
    assert cells.tolist() == [0, -1, 0, 1, 2, 3, -1] and placed == [(0, 0, 1), (2, 0, 1), (3, 1, 3), (4, 2, 1), (5, 3, 1)]
    who, what = ivf.best_places(np.array([[1.0, 3.0, 2.0, 2.0, 2.0], [-np.inf, 1.0, -np.inf, -np.inf, -np.inf]]), 3)
    assert (who.tolist(), what.tolist()) == ([0, 0, 0, 1], [1, 2, 3, 1])


def test_a_query_meets_a_cell_once(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(1200)], "chunk_id long, embedding array<double>")
    asked = df.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    quantiser = ivf.train(df, "chunk_id", "embedding", lists=100, sample_rows=800)
    index = ivf.index_rows(df, "chunk_id", "embedding", quantiser).cache()
    sizes = {r[0]: r[1] for r in index.groupBy("list_id").count().collect()}
    cells, _ = ivf.packed(sizes, 100)
    opened = ivf.probes_of(asked, "query_id", "query_vec", quantiser, 70, (), cells).collect()
    assert len(opened) == 20  # 1400 when a row was one list
    lists = ivf.probes_of(asked, "query_id", "query_vec", quantiser, 70).select("query_id", "list_id").collect()
    assert sorted((r.query_id, int(x)) for r in opened for x in np.frombuffer(r.lists, "int32")) == sorted((q, x) for q, x in lists if x in sizes)
    tried = ivf.candidates(index, asked, quantiser, id_col="chunk_id", query_id="query_id", vec_col="query_vec", probes=70, rerank=15).collect()
    where = {r.chunk_id: r.list_id for r in index.collect()}
    matrix = np.array([r.embedding for r in df.orderBy("chunk_id").collect()])
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    for q in range(20):
        mine = {x for a, x in lists if a == q}
        near = [i for i in np.argsort(-(matrix @ matrix[q])) if where[i] in mine]
        got = {r.chunk_id for r in tried if r.query_id == q}
        assert len(got) == 15 and set(near[:8]) <= got and got <= set(near[:25])


def test_many_queries_have_the_neighbours_that_few_have(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 60)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 6, [nan, *[1.0] * 5], [inf, *[1.0] * 5], [None, *[1.0] * 5], [1.0] * 7, [1e200] * 6, [1e-200] * 6]
    rows = [(i, f"t{i % 2}", [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(1000 + i, "t0", [1.0, 2.0, 3.0, 4.0, 5.0, 6.1]) for i in range(150)]
    rows += [(2000 + i, "t0", v) for i, v in enumerate(odd)] + [(None, "t0", [1.0, 2.0, 3.0, 4.0, 5.0, 6.1]), (7, "t1", rows[7][2]), (9, None, rows[9][2])]
    df = spark.createDataFrame(rows, "chunk_id long, tenant_id string, embedding array<float>")
    asked = df.where("chunk_id % 5 = 0 or chunk_id >= 2000 or chunk_id in (7, 9)").select(F.col("chunk_id").alias("query_id"), "tenant_id", F.col("embedding").alias("query_vec"))

    def told(found):
        return sorted(map(str, found.select("query_id", "tenant_id", "chunk_id", "rank", "score").collect()))

    assert told(retrieval.semantic_topk_many(df, asked, 4)) == told(retrieval.semantic_topk(df, asked, 4))


# --- postings ---------------------------------------------------------------------------------

CHUNK = "chunk_id string, tenant_id string, chunk_text string"
QUERIES = [("q0", "t0", "alpha rare9 beta"), ("q1", "t1", "alpha ALPHA gamma"), ("q2", "t0", "nothing here"), ("q3", "t1", "beta"), ("q4", "t0", ""), ("q5", "t9", "alpha"),
           ("q6", "t0", "ñandú x1 alpha")]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta", "Ñandú", "x1"] + [f"rare{i}" for i in range(60)]
    weight = np.array([30, 12, 6, 4, 2, 2] + [0.4] * 60)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(1, 25)), p=weight / weight.sum()))
        rows.append((f"c{i:04}", f"t{i % 2}", text))
    return rows + [("void", "t0", ""), ("null", "t1", None), ("punct", "t0", "... !")]


def same(index, df, queries, k):
    got = postings.topk(index, queries, k).select("query_id", "tenant_id", "chunk_id", "lexical_score", "rank").collect()
    want = retrieval.lexical_topk(df, queries, k).select("query_id", "tenant_id", "chunk_id", "lexical_score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, tenant_id string, query_text string")


@pytest.mark.parametrize("block", [128, 4])
def test_index_equals_a_scan_of_texts_also_after_updates(spark, queries, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    rows = corpus(1, 300)
    df = spark.createDataFrame(rows, CHUNK)
    index = postings.Index(spark, f"{tmp_path}/index", parts=4)
    postings.build(index, df)
    same(index, df, queries, 10)
    # Changed, new and deleted chunks; one becomes empty, one had no words before.
    now = {c: (c, t, x) for c, t, x in rows}
    for c in ("c0001", "c0002", "c0040", "void"):
        now[c] = (c, now[c][1], "alpha beta rare9 rare9 fresh")
    now["c0050"] = ("c0050", "t0", "")
    now["new"] = ("new", "t1", "gamma gamma alpha")
    gone = [now.pop("c0003"), now.pop("null"), ("unknown", "t0", None)]
    after = spark.createDataFrame(list(now.values()), CHUNK)
    assert postings.update(index, after, spark.createDataFrame(gone, CHUNK)) == 1
    assert index.table("forward", postings.FORWARD).where("version = 1").count() == 8  # only what differs
    for k in (1, 10):
        same(index, after, queries, k)
    assert postings.update(index, after, spark.createDataFrame(gone, CHUNK)) is None and index.segments() == [0, 1]
    # A deleted chunk comes back, and an update that died before its last table does not count.
    now["c0003"] = rows[3]
    back = spark.createDataFrame(list(now.values()), CHUNK)
    with monkeypatch.context() as m:
        m.setattr(postings.Index, "path", lambda self, n, table: f"{self.root}/{table}/segment={n}" if table != "totals" else "/dev/null/no")
        with pytest.raises(Exception):
            postings.update(index, back)
    assert index.segments() == [0, 1] and postings.update(index, back) == 2
    whole = postings.Index(spark, f"{tmp_path}/whole", parts=2)
    postings.compact(index, whole)
    same(whole, back, queries, 10)
    assert whole.segments() == [0]


def test_search_reads_no_text_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rows = [(f"c{i:05}", "t0", "common " + "common " * (40 if i % 500 == 0 else 0) + f"pad{i % 7} " * (i % 30 + 5)) for i in range(4000)]
    df = spark.createDataFrame(rows, CHUNK)
    index = postings.Index(spark, f"{tmp_path}/index", parts=4)
    postings.build(index, df)
    asked = spark.createDataFrame([("q", "t0", "common")], "query_id string, tenant_id string, query_text string")
    total = postings.bounded_blocks(index, asked).count()
    assert total >= 250 and postings.opened_blocks(index, asked, 5).count() < total / 10
    plan = postings.topk(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=)", plan)
    headers = postings.bounded_blocks(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in headers
    same(index, df, asked, 5)


def test_an_update_takes_words_only_from_changed_texts(spark, queries, tmp_path, monkeypatch):
    rows = corpus(3, 200)
    df = spark.createDataFrame(rows, CHUNK)
    index = postings.Index(spark, f"{tmp_path}/index", parts=2)
    postings.build(index, df)
    counted, real = [], postings.counted_terms
    monkeypatch.setattr(postings, "counted_terms", lambda texts: counted.append(texts.count()) or real(texts))
    after = spark.createDataFrame([(c, t, "beta rare1 fresh" if c < "c0004" else x) for c, t, x in rows if c != "c0100"], CHUNK)
    assert postings.update(index, after, df.where("chunk_id = 'c0100'")) == 1
    assert counted == [4]  # every text of the table before, and that once for each reader of the rows
    same(index, after, queries, 10)


def test_no_entry_is_shuffled_and_texts_only_where_a_key_repeats(spark, queries, tmp_path, monkeypatch):
    """Before, every text was dealt out by key and every entry of a word by range, several times the input on disk."""
    rows = corpus(5, 120)
    df = spark.createDataFrame(rows, CHUNK).repartition(3)
    assert "Exchange" not in postings._blocks(postings.counted_terms(df).withColumn("version", F.lit(0)))._jdf.queryExecution().executedPlan().toString().replace(
        "Exchange RoundRobinPartitioning", "")
    whole = spark.createDataFrame(rows, CHUNK)
    assert "Exchange" not in postings.latest_texts(whole)._jdf.queryExecution().executedPlan().toString()
    # Runs of a few entries, and a chunk that is changed, repeated and of a null key.
    monkeypatch.setattr(postings, "RUN", 40)
    monkeypatch.setattr(postings, "FEW_TERMS", 0)
    index = postings.Index(spark, f"{tmp_path}/index", parts=3)
    odd = [(None, "t0", "alpha"), ("c0001", "t1", "alpha beta rare3"), ("c0001", "t1", "alpha")]
    postings.build(index, spark.createDataFrame(rows + odd, CHUNK))
    after = [(c, t, "beta rare9 rare9" if c == "c0005" else x) for c, t, x in rows if c != "c0007"]
    assert postings.update(index, spark.createDataFrame(after, CHUNK), spark.createDataFrame([("c0007", "t1", None), (None, "t0", None)], CHUNK)) == 1
    same(index, spark.createDataFrame([*after, odd[0]], CHUNK), queries, 10)  # a null key meets no other, so its chunk stays
    totals = index.table("totals", postings.TOTALS).groupBy("tenant_id").agg(F.sum("docs").alias("docs")).collect()
    assert sum(r.docs for r in totals) == len(after) + 1


def test_repeated_rows_and_an_empty_table(spark, queries, tmp_path):
    rows = [("a", "t0", "alpha"), ("a", "t0", "alpha beta"), ("a", "t1", "alpha"), ("b", "t0", "beta beta")]
    index = postings.Index(spark, f"{tmp_path}/index", parts=2)
    postings.build(index, spark.createDataFrame(rows, CHUNK))
    same(index, spark.createDataFrame(rows[1:], CHUNK), queries, 10)
    empty = postings.Index(spark, f"{tmp_path}/empty", parts=2)
    postings.build(empty, spark.createDataFrame([], CHUNK))
    assert postings.topk(empty, queries).count() == 0
    assert postings.update(empty, spark.createDataFrame(rows, CHUNK)) == 1
    same(empty, spark.createDataFrame(rows[1:], CHUNK), queries, 10)
