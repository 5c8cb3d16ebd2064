"""Gold follows silver by changed keys: same rows as a full recompute, and only touched partitions are written."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from cuentaclara.functions.embedders import CountingEmbedder
from cuentaclara.operators import gold, retrieval
from cuentaclara.plans.domain import Domain
from cuentaclara.sources import feeds, tables
from cuentaclara.streaming import changes, ingest, medallion
from tests.test_streaming import put_messages, rows_of

SF = "/root/testdata/sf0.001"
AUDIT = ["tenant_id", "expense_id", "user_id", "final_amount", "final_vendor", "final_date", "final_currency", "category", "approved_at", "had_hitl", "hitl_decision",
         "hitl_resolved_by", "trace_id", "ocr_extra"]


def now():
    return F.lit(dt.datetime(2026, 1, 1))


@pytest.fixture(scope="module")
def domain(spark):
    return Domain(spark, SF)


def files_of(path):
    return {f: open(f, "rb").read()[-64:] for f in glob.glob(f"{path}/tenant_id=*/bucket=*/*.parquet")}


def test_changes_reach_gold_by_key(spark, domain, tmp_path):
    lake = medallion.Lake(f"{tmp_path}/lake")

    def send(topic, df, op, seq):
        put_messages(domain.as_messages(df, topic, op, seq, seq), f"{tmp_path}/in/{topic}", 1)

    def step():
        names = [n for n in medallion.AUDITED if glob.glob(f"{tmp_path}/in/{n}/*")]
        sources = {n: feeds.messages_from_files(spark, f"{tmp_path}/in/{n}") for n in names}
        for query in medallion.ingest(spark, lake, sources, ingest.DRAIN):
            query.awaitTermination()
        medallion.refresh_silver(spark, lake, names)
        return medallion.refresh_gold(spark, lake, CountingEmbedder(), now())

    def check():
        whole = gold.expense_audit(*[medallion.silver_table(spark, lake, t) for t in medallion.AUDITED])
        got = tables.read_table(spark, lake.gold("expense_audit"))
        assert rows_of(got.select(*AUDIT)) == rows_of(whole.select(*AUDIT))
        chunks = gold.expense_chunks(whole)
        assert rows_of(tables.read_table(spark, lake.gold("expense_chunks")).select(*chunks.columns)) == rows_of(chunks)
        embedded = tables.read_table(spark, lake.gold("expense_embeddings"))
        want = retrieval.embed(chunks.select("chunk_id", "tenant_id", "chunk_text"), CountingEmbedder())
        columns = ["chunk_id", "tenant_id", "embedding"]
        assert rows_of(embedded.select(*columns)) == rows_of(want.select(*columns))
        return got.count()

    expenses = domain.expenses.drop("o_orderkey", "o_orderpriority", "rejection_reason").where("expense_id < 'exp_00000300' AND status <> 'bogus'").cache()
    send("expenses", expenses, "'c'", "1L")
    # The audited tables without a feed yet are empty; approval alone is enough for a row.
    assert step() == expenses.count()
    first = check()
    assert first > 50 and step() == 0
    before = files_of(lake.gold("expense_audit"))

    some = [r.expense_id for r in expenses.where("status = 'approved'").orderBy("expense_id").limit(6).collect()]
    row = expenses.where(F.col("expense_id") == some[0])
    send("expenses", row.withColumn("amount", F.lit(12.34).cast("decimal(18,2)")).withColumn("final_amount", F.lit(None).cast("decimal(18,2)")), "'u'", "2L")
    send("expenses", expenses.where(F.col("expense_id") == some[1]), "'d'", "2L")
    send("expenses", expenses.where(F.col("expense_id") == some[2]).withColumn("tenant_id", F.lit("t_moved")), "'u'", "2L")
    send("expenses", expenses.where(F.col("expense_id") == some[3]).withColumn("status", F.lit("rejected")), "'u'", "2L")
    send("expenses", row.withColumn("expense_id", F.lit("exp_new")), "'c'", "2L")
    assert step() == 5
    assert check() == first - 1
    after = files_of(lake.gold("expense_audit"))
    kept = [f for f in before if after.get(f) == before[f]]
    assert len(kept) >= len(before) - 6  # the other partitions were not written again
    assert any("tenant_id=t_moved" in f for f in after)

    # A review task that moves from one expense to another makes both dirty, also across a compaction.
    task = domain.hitl.where("status = 'resolved'").limit(1).withColumn("task_id", F.lit("task")).cache()
    send("hitl_tasks", task.withColumn("expense_id", F.lit(some[4])), "'c'", "3L")
    assert step() == 1 and check()
    send("hitl_tasks", task.withColumn("expense_id", F.lit(some[5])), "'u'", "4L")
    names = ["hitl_tasks"]
    for query in medallion.ingest(spark, lake, {n: feeds.messages_from_files(spark, f"{tmp_path}/in/{n}") for n in names}, ingest.DRAIN):
        query.awaitTermination()
    medallion.refresh_silver(spark, lake, names)
    changes.compact(spark, lake.silver("hitl_tasks"), "task_id")
    assert medallion.refresh_gold(spark, lake, CountingEmbedder(), now()) == 2
    check()
    got = {r.expense_id: r.had_hitl for r in tables.read_table(spark, lake.gold("expense_audit")).where(F.col("expense_id").isin(some)).collect()}
    assert got[some[4]] is False and got[some[5]] is True

    # A refresh that died before its last step is done again, with the same result.
    send("expenses", expenses.where(F.col("expense_id") == some[1]), "'u'", "5L")
    send("expenses", expenses.where(F.col("expense_id") == some[2]), "'u'", "5L")  # back from t_moved: that partition empties
    assert step() == 2
    last = max(int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{lake.gold('_versions')}/n=*"))
    tables.remove_folder(spark, f"{lake.gold('_versions')}/n={last}")
    assert medallion.refresh_gold(spark, lake, CountingEmbedder(), now()) == 2
    check()
    assert not any("tenant_id=t_moved" in f for f in files_of(lake.gold("expense_audit")))


AUDIT_READS = {
    "expenses": "expense_id string, tenant_id string, user_id string, receipt_id string, amount decimal(18,2), currency string, date date, vendor string, category string, "
                "status string, final_amount decimal(18,2), final_vendor string, final_date date, final_currency string, source_per_field map<string,string>, "
                "approved_at timestamp, updated_at timestamp",
    "ocr": "expense_id string, ocr_total decimal(18,2), ocr_vendor string, ocr_date date, ocr_currency string, ocr_extra string",
    "hitl": "expense_id string, status string, decision string, resolved_by string, resolved_at timestamp, discrepancy_fields array<string>",
    "events": "event_id string, expense_id string, trace_id string, created_at timestamp",
}


def silver_rows(spark, keys, tenant="t_a", vendor="old"):
    """One approved expense per key (tenant and vendor as said), every second with OCR, every third with a review and a trace."""
    at = dt.datetime(2026, 1, 1)
    rows = {
        "expenses": [(k, tenant, "u", None, None, "USD", at.date(), vendor, "food", "approved", None, None, None, None, {"date": "user"}, at, at) for k in keys],
        "ocr": [(k, None, None, at.date(), "EUR", "{}") for i, k in enumerate(keys) if i % 2 == 0],
        "hitl": [(k, "resolved", "custom", "rev", at, ["amount"]) for i, k in enumerate(keys) if i % 3 == 0],
        "events": [(f"e{k}", k, f"trace_{k}", at) for i, k in enumerate(keys) if i % 3 == 0],
    }
    return {t: spark.createDataFrame(rows[t], AUDIT_READS[t]) for t in rows}


@pytest.mark.parametrize("few", [1000, 0])
def test_refresh_writes_rows_once_and_takes_repeated_keys(spark, tmp_path, monkeypatch, few):
    """Beside the table, a refresh writes its keys and its new rows once, whatever number of rows stays; few and many keys give the same."""
    monkeypatch.setattr(gold, "FEW_KEYS", few, raising=False)
    keys = [f"k{i:03d}" for i in range(120)]
    old = silver_rows(spark, keys[:118])
    alone = silver_rows(spark, keys[118:], "t_alone")
    before = [old[t].unionByName(alone[t]) for t in AUDIT_READS]
    path = f"{tmp_path}/audit"
    tables.overwrite_partitioned(tables.bucketed(gold.expense_audit(*before), "expense_id"), path, ("tenant_id", "bucket"))
    # 0 to 9 change, 10 moves to another tenant, 11 is no longer approved, the tenant of 118 and 119 loses both, one is new.
    state = silver_rows(spark, keys[:10] + ["new"], vendor="edited")
    moved, same = silver_rows(spark, keys[10:11], "t_moved"), silver_rows(spark, keys[12:118])
    now = [state[t].unionByName(moved[t]).unionByName(same[t]) for t in AUDIT_READS]
    dirty = keys[:12] + keys[118:] + ["new"]
    shared = f"{tmp_path}/shared"
    monkeypatch.setattr(tables, "scratch_dir", lambda spark, purpose: f"{shared}/{purpose}-{len(glob.glob(f'{shared}/*'))}")
    frame = spark.createDataFrame([(k,) for k in dirty * 3 + [None]], "expense_id string")
    new = gold.refresh_audit(path, frame, *now)
    assert rows_of(new.select("expense_id", "tenant_id")) == sorted([*[(k, "t_a") for k in keys[:10] + ["new"]], (keys[10], "t_moved")])
    got = tables.read_table(spark, path)
    assert rows_of(got.select(*AUDIT)) == rows_of(gold.expense_audit(*now).select(*AUDIT))
    assert not glob.glob(f"{path}/tenant_id=t_alone/*")
    # Keys and new rows have a table each; others hold partitions. 106 rows stay, most of them in touched partitions.
    sizes = {f: spark.read.parquet(f) for f in glob.glob(f"{shared}/*")}
    written = sorted(df.count() for df in sizes.values() if {"expense_id"} <= set(df.columns))
    assert written == [len(new.collect()), len(dirty)]


def test_replaced_keys_may_repeat(spark, tmp_path):
    """Keys that come many times, and rows of a key that come twice, neither multiply nor stay; a null key stays."""
    path, schema = f"{tmp_path}/t", "k string, v int, tenant_id string"
    table = spark.createDataFrame([("a", 1, "t_x"), ("a", 2, "t_x"), ("b", 3, "t_x"), (None, 4, "t_x"), ("c", 5, "t_y"), ("c", 6, "t_y")], schema)
    tables.overwrite_partitioned(tables.bucketed(table, "k", 1), path, ("tenant_id", "bucket"))
    fresh = tables.bucketed(spark.createDataFrame([("a", 7, "t_x"), ("a", 7, "t_x")], schema), "k", 1)
    dirty = spark.createDataFrame([("a",), ("a",), ("c",), ("c",), (None,)], "k string")
    new = tables.replace_keys(fresh, dirty, path, "k")
    assert rows_of(new.select("k", "v")) == [("a", "7"), ("a", "7")]
    got = tables.read_table(spark, path)
    assert sorted((r.k or "", r.v) for r in got.collect()) == [("", 4), ("a", 7), ("a", 7), ("b", 3)]
    assert not glob.glob(f"{path}/tenant_id=t_y/*")


def test_refresh_query_folds_the_change_log_once(spark, monkeypatch):
    from cuentaclara.plans import queries

    seen = []
    refresh = gold.refresh_audit
    monkeypatch.setattr(gold, "refresh_audit", lambda path, dirty, expenses, ocr, hitl, events: (
        seen.append(hitl._jdf.queryExecution().toString()), refresh(path, dirty, expenses, ocr, hitl, events))[1])
    assert queries.QUERIES["changed_key_refresh"](spark, SF).count() > 100
    assert len(seen) == 1 and "Window" not in seen[0] and "lineitem" not in seen[0]


def test_sync_embeds_what_differs_and_nothing_else(spark, tmp_path):
    path = f"{tmp_path}/embeddings"

    def chunks(rows):
        return spark.createDataFrame(rows, "chunk_id string, tenant_id string, chunk_text string")

    rows = [(f"c{i}", f"t{i % 3}", f"text {i}") for i in range(40)] + [("void", "t0", None)]
    assert retrieval.sync_embeddings(chunks(rows), path, CountingEmbedder(), now()) == {"embedded": 41, "removed": 0}
    assert retrieval.sync_embeddings(chunks(rows), path, CountingEmbedder(), now()) == {"embedded": 0, "removed": 0}
    before = files_of(path)
    rows[5] = ("c5", "t2", "edited aaa")
    del rows[7]
    assert retrieval.sync_embeddings(chunks(rows), path, CountingEmbedder(), F.lit(dt.datetime(2026, 2, 1))) == {"embedded": 1, "removed": 1}
    after = files_of(path)
    assert len([f for f in before if after.get(f) == before[f]]) >= len(before) - 2
    table = tables.read_table(spark, path)
    assert sorted(r.chunk_id for r in table.collect()) == sorted(r[0] for r in rows)
    edited = table.where("chunk_id = 'c5'").first()
    assert list(edited.embedding) == CountingEmbedder()(["edited aaa"])[0] and edited.updated_at == dt.datetime(2026, 2, 1)
    assert table.where("updated_at > '2026-01-15'").count() == 1
    # Only chunks inside the given set are looked at.
    rows[0], rows[1] = ("c0", "t0", "new 0"), ("c1", "t1", "new 1")
    assert retrieval.sync_embeddings(chunks(rows), path, CountingEmbedder(), now(), within=spark.createDataFrame([("c1",)], "chunk_id string"))["embedded"] == 1
    assert retrieval.revectorize_table(chunks(rows), path, F.col("tenant_id") == "t1", CountingEmbedder("n"), now()) == 12
    got = tables.read_table(spark, path)
    assert {len(r.embedding) for r in got.where("tenant_id = 't1'").collect()} == {1} and {len(r.embedding) for r in got.where("tenant_id <> 't1'").collect()} == {10}
    assert retrieval.sync_embeddings(chunks([]), path, CountingEmbedder(), now()) == {"embedded": 0, "removed": 40}
    assert not glob.glob(f"{path}/tenant_id=*/bucket=*/*.parquet")
