import datetime as dt
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from cuentaclara.operators import gold, ocr, retrieval
from cuentaclara.functions.embedders import HashingEmbedder

ARRAY = '{"summary_fields":[{"field":"tax","value":"26.30"}],"line_items":[{"quantity":"2x","item":"Latte grande","unit_price":"58.00","price":"116.00"}]}'
MAP = '{"summary_fields":{"_0":{"field":"tax","value":"26.30"}},"line_items":{"_0":{"item":"Croissant","price":"71.50"}}}'
MIXED = '{"summary_fields":[{"field":"tax","value":"1"}],"line_items":{"_0":{"item":"Pan","price":"2"}}}'
HEAD = "Gasto en Cafe por 10.50 COP el 2026-01-02 . Categoria: food . "


def test_chunk_text_for_every_shape(spark):
    rows = [(k, "t_1", Decimal("10.50"), "Cafe", dt.date(2026, 1, 2), "COP", "food", None, extra)
            for k, extra in zip("abcde", (ARRAY, MAP, MIXED, None, "not json"))]
    audit = spark.createDataFrame(rows, "expense_id string, tenant_id string, final_amount decimal(18,2), final_vendor string, "
                                        "final_date date, final_currency string, category string, approved_at timestamp, ocr_extra string")
    text = {r.expense_id: r.chunk_text for r in gold.expense_chunks(audit).collect()}
    assert text["a"] == HEAD + "Items: 2x Latte grande @58.00 116.00 . Detalles: tax: 26.30 ."
    # Absent cells stay as empty strings, so their separators remain.
    assert text["b"] == HEAD + "Items:  Croissant  71.50 . Detalles: tax: 26.30 ."
    assert text["c"] == HEAD + "Items:  Pan  2 . Detalles: tax: 1 ."
    assert text["d"] == text["e"] == HEAD + " "


def test_history_pages_hold_everything(spark):
    events = spark.range(2500).select(
        F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("event_id"), F.lit("e").alias("expense_id"), F.lit("t").alias("tenant_id"),
        F.col("id").cast("string").alias("event_type"), F.lit("a").alias("actor"), F.create_map(F.lit("k"), F.lit("v")).alias("details"),
        F.timestamp_seconds(F.col("id") * 500).alias("created_at"))
    pages = gold.event_history(events).orderBy("page").collect()
    assert [len(p.event_history) for p in pages] == [1000, 1000, 500]
    assert [e.event_type for p in pages for e in p.event_history] == [str(i) for i in range(2500)]


def test_hitl_rollup_takes_maxima_and_latest_takes_a_row(spark):
    rows = [("h1", "e", "resolved", "keep_user_value", "ana", dt.datetime(2026, 1, 1), ["vendor"]),
            ("h2", "e", "resolved", "accept_ocr", "zoe", dt.datetime(2026, 1, 2), ["amount"]),
            ("h3", "e", "pending", "z", "z", dt.datetime(2026, 1, 3), ["z"])]
    hitl = spark.createDataFrame(rows, "task_id string, expense_id string, status string, decision string, resolved_by string, resolved_at timestamp, discrepancy_fields array<string>")
    r, latest = gold.hitl_rollup(hitl).first(), gold.hitl_latest(hitl).first()
    assert (r.hitl_decision, r.hitl_resolved_by, r.hitl_conflict_fields) == ("keep_user_value", "zoe", ["vendor"])
    assert (latest.hitl_decision, latest.hitl_conflict_fields) == ("accept_ocr", ["amount"])


def test_ocr_empty_and_broken_responses(spark):
    df = spark.createDataFrame([("a", "{}"), ("b", "nope"), ("c", '{"ExpenseDocuments":[{"SummaryFields":[{"Type":{"Text":"TOTAL"}}]}]}')], "expense_id string, response string")
    rows = {r.expense_id: r for r in ocr.extras(ocr.normalize(df)).collect()}
    assert all(rows[k].ocr_total is None and rows[k].avg_confidence == 0.0 and rows[k].line_items == [] for k in "ab")
    assert (rows["c"].ocr_total.value, rows["c"].ocr_total.confidence, rows["c"].avg_confidence) == (None, 0.0, 0.0)


def vectors(spark):
    embed = HashingEmbedder(16)
    texts = [f"word{i} word{i % 7} shop{i % 3}" for i in range(200)]
    rows = [(f"c{i:03}", f"t_{i % 2}", t, v) for i, (t, v) in enumerate(zip(texts, embed(texts)))]
    chunks = spark.createDataFrame(rows, "chunk_id string, tenant_id string, chunk_text string, embedding array<float>")
    queries = spark.createDataFrame([("q", "t_1", "word3 shop1", embed(["word3 shop1"])[0])], "query_id string, tenant_id string, query_text string, query_vec array<double>")
    return chunks, queries


def test_semantic_stays_in_the_tenant_and_matches_brute_force(spark):
    chunks, queries = vectors(spark)
    q = queries.first().query_vec
    scored = []
    for c in chunks.where("tenant_id = 't_1'").collect():
        na, nb = sum(x * x for x in q) ** 0.5, sum(x * x for x in c.embedding) ** 0.5
        scored.append((-sum(x * y for x, y in zip(q, c.embedding)) / (na * nb) if na and nb else 0.0, c.chunk_id))
    expected = [c for _, c in sorted(scored)[:10]]
    got = retrieval.semantic_topk(chunks, queries).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == expected and {r.tenant_id for r in got} == {"t_1"}
    assert {r.tenant_id for r in retrieval.lexical_topk(chunks, queries).collect()} == {"t_1"}


def test_lexical_search_keeps_letters_of_all_scripts(spark):
    chunks = spark.createDataFrame([("a", "t", "Café Peñón"), ("b", "t", "Москва 東京"), ("c", "t", "caf pe n")],
                                   "chunk_id string, tenant_id string, chunk_text string")
    asked = spark.createDataFrame([("q1", "t", "CAFÉ peñón"), ("q2", "t", "москва")], "query_id string, tenant_id string, query_text string")
    got = {(r.query_id, r.chunk_id) for r in retrieval.lexical_topk(chunks, asked).collect()}
    assert got == {("q1", "a"), ("q2", "b")}


def test_history_keeps_the_grain_beyond_one_page(spark):
    events = spark.range(2500).selectExpr(
        "'t' AS tenant_id", "'e' AS expense_id", "cast(id AS string) AS event_type", "timestamp_seconds(id) AS created_at", "cast(id AS string) AS event_id")
    table = spark.createDataFrame([("t", "e", 5.0), ("t", "none", 7.0)], "tenant_id string, expense_id string, final_amount double")
    rows = {r.expense_id: r for r in gold.audit_with_history(table, events).collect()}
    assert len(rows) == 2 and rows["e"].event_count == 2500 and rows["e"].history_pages == 3 and rows["e"].last_event_type == "2499"
    assert rows["none"].event_count is None


def test_wide_buckets_make_the_approximate_search_exact(spark):
    chunks, queries = vectors(spark)
    exact = [r.chunk_id for r in retrieval.semantic_topk(chunks, queries, 5).orderBy("rank").collect()]
    near = [r.chunk_id for r in retrieval.approximate_topk(chunks, queries, 5, planes=4, flips=4).orderBy("rank").collect()]
    assert near == exact


def test_the_approximate_search_finds_nine_of_ten_neighbours(spark):
    from cuentaclara.plans.queries import QUERIES

    rng = np.random.default_rng(0)
    rows = [(f"c{i}", "t", rng.normal(size=64).tolist()) for i in range(300)]
    asked = [(f"q{i}", "t", rng.normal(size=64).tolist()) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, tenant_id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id string, tenant_id string, query_vec array<double>")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.semantic_topk(chunks, queries, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in retrieval.approximate_topk(chunks, queries, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    hits = QUERIES["semantic_approximate_hits"](spark, "/root/testdata/sf0.001").collect()
    assert len(hits) == 50 and all(0.9 <= r.recall <= 1 and 0 < r.candidate_share <= 0.7 for r in hits)


def test_embedder_must_answer_for_every_text(spark):
    import pytest

    chunks, _ = vectors(spark)
    with pytest.raises(Exception, match="asked for"):
        retrieval.embed(chunks.drop("embedding"), lambda texts: []).collect()
    assert retrieval.embed(chunks.drop("embedding"), HashingEmbedder(16), batch_size=16).count() == 200
