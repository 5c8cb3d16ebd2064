"""Streams give what the batch functions give; restarts lose and repeat nothing."""

import pytest
from pyspark.sql import functions as F

from cuentaclara import schemas
from cuentaclara.operators import bronze, cdc, gold, silver
from cuentaclara.operators.operations import ocr_drift_profile, table_fingerprint
from cuentaclara.plans.domain import Domain
from cuentaclara.sources import feeds, tables
from cuentaclara.streaming import changes, drift, ingest, medallion

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def domain(spark):
    return Domain(spark, SF)


def put_messages(df, path, files):
    full = df
    for name, kind in (("key", "binary"), ("timestamp", "timestamp")):
        if name not in df.columns:
            full = full.withColumn(name, F.lit(None).cast(kind))
    full.select("key", "value", "topic", F.col("partition").cast("int"), F.col("offset").cast("bigint"), "timestamp").repartition(
        files).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_stream_equals_batch_and_survives_restarts(spark, domain, tmp_path):
    inbox, lake = f"{tmp_path}/inbox", medallion.Lake(f"{tmp_path}/lake")
    raw = domain.expense_messages
    early, late = raw.where("offset % 3 <> 0"), raw.where("offset % 3 = 0")
    for part in (early, late):  # the second half is older data that arrives late
        put_messages(part, inbox, 3)
        source = feeds.messages_from_files(spark, inbox, max_files=2)
        for q in medallion.ingest(spark, lake, {"expenses": source}, ingest.DRAIN):
            q.awaitTermination()
        medallion.refresh_silver(spark, lake, ["expenses"])
    medallion.refresh_silver(spark, lake, ["expenses"])  # nothing new: no change

    want = cdc.silver_state(silver.valid_changes(silver.clean_expenses(bronze.bronze_rows(raw, schemas.EXPENSES))), "expense_id")
    got = medallion.silver_table(spark, lake, "expenses")
    assert rows_of(got.select(*want.columns)) == rows_of(want)
    keys = ["expense_id", "status", "amount"]
    assert rows_of(table_fingerprint(got, keys)) == rows_of(table_fingerprint(want, keys))

    assert spark.read.parquet(lake.bronze("expenses")).count() == raw.where("value IS NOT NULL").count() - spark.read.parquet(
        lake.dead_letters("expenses")).count()
    assert spark.read.parquet(lake.dead_letters("expenses")).count() == domain.events_k.where("k = 7").count()

    upto = changes.compact(spark, lake.silver("expenses"), "expense_id")
    assert upto >= 0 and rows_of(medallion.silver_table(spark, lake, "expenses").select(*want.columns)) == rows_of(want)


def test_seeded_rows_reach_silver_beside_the_stream(spark, domain, tmp_path):
    lake = medallion.Lake(f"{tmp_path}/lake")
    columns = ["expense_id", "tenant_id", F.col("amount").cast("double"), "status", F.lit("2020-01-01T00:00:00Z").alias("updated_at")]
    domain.expenses.select(*columns).where("status <> 'bogus'").limit(7).write.json(f"{tmp_path}/export")
    assert tables.seed_collection(spark, f"{tmp_path}/export", lake.snapshot("expenses"), schemas.EXPENSES)
    put_messages(domain.expense_messages, f"{tmp_path}/inbox", 2)
    for q in medallion.ingest(spark, lake, {"expenses": feeds.messages_from_files(spark, f"{tmp_path}/inbox")}, ingest.DRAIN):
        q.awaitTermination()
    medallion.refresh_silver(spark, lake, ["expenses"])
    seeded = spark.read.parquet(lake.snapshot("expenses")).select("expense_id")
    silver_rows = medallion.silver_table(spark, lake, "expenses")
    assert seeded.count() == 7 and seeded.join(silver_rows, "expense_id", "left_anti").isEmpty()
    assert silver_rows.count() > 7


def test_replay_with_a_fresh_checkpoint_loses_nothing(spark, domain, tmp_path):
    inbox, lake = f"{tmp_path}/inbox", medallion.Lake(f"{tmp_path}/lake")
    put_messages(domain.expense_messages, inbox, 4)
    for q in medallion.ingest(spark, lake, {"expenses": feeds.messages_from_files(spark, inbox)}, ingest.DRAIN):
        q.awaitTermination()
    medallion.refresh_silver(spark, lake, ["expenses"])
    before = rows_of(medallion.silver_table(spark, lake, "expenses"))
    assert changes.compact(spark, lake.silver("expenses"), "expense_id") == 0
    clean, _ = silver.CLEANERS["expenses"]
    source = feeds.bronze_stream(spark, lake.bronze("expenses"), spark.read.parquet(lake.bronze("expenses")).schema)
    changes.start_apply_changes(source, clean, "expense_id", lake.silver("expenses"), f"{tmp_path}/fresh",
                                rules=silver.valid_changes, trigger=ingest.DRAIN).awaitTermination()
    assert rows_of(medallion.silver_table(spark, lake, "expenses")) == before
    assert changes.compact(spark, lake.silver("expenses"), "expense_id") == 1
    assert rows_of(medallion.silver_table(spark, lake, "expenses")) == before


def test_whole_refresh(spark, domain, tmp_path):
    lake = medallion.Lake(f"{tmp_path}/lake")
    feeds_of = {
        "ocr_extractions": domain.ocr_messages, "hitl_tasks": domain.hitl_messages, "expense_events": domain.event_messages,
        "expenses": domain.as_messages(domain.expenses.drop("o_orderkey", "o_orderpriority", "rejection_reason"), "expenses", "'c'", "1L", "0L"),
    }
    sources = {}
    for name, df in feeds_of.items():
        put_messages(df, f"{tmp_path}/in/{name}", 2)
        sources[name] = feeds.messages_from_files(spark, f"{tmp_path}/in/{name}")
    medallion.refresh(spark, lake, sources)
    valid = domain.expenses.where("status <> 'bogus'")
    want = gold.expense_audit(valid, domain.ocr, domain.hitl, domain.timeline)
    got = tables.read_table(spark, lake.gold("expense_audit"))
    columns = ["tenant_id", "expense_id", "final_amount", "final_vendor", "final_date", "approved_at", "hitl_decision", "trace_id", "ocr_extra"]
    assert rows_of(got.select(*columns)) == rows_of(want.select(*columns))
    chunks = tables.read_table(spark, lake.gold("expense_chunks")).where("tenant_id = 't_1'")
    assert "PartitionFilters: [isnotnull(tenant_id" in chunks._jdf.queryExecution().executedPlan().toString()
    assert chunks.count() == want.where("tenant_id = 't_1'").count()


def test_drift_windows(spark, domain, tmp_path):
    domain.ocr.write.parquet(f"{tmp_path}/ocr")
    source = feeds.bronze_stream(spark, f"{tmp_path}/ocr", spark.read.parquet(f"{tmp_path}/ocr").schema)
    drift.start_drift(source, f"{tmp_path}/out", f"{tmp_path}/ck", lateness="0 seconds", trigger=ingest.DRAIN).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    last = domain.ocr.agg(F.max("extracted_at")).first()[0]
    batch = ocr_drift_profile(domain.ocr).where(F.col("window_start") + F.expr("interval 1 day") <= F.lit(last))
    assert got.count() > 0 and rows_of(got.select(*batch.columns)) == rows_of(batch)
    assert drift.alerts(batch).where("NOT alert").isEmpty()


def test_json_lines_backup_and_raw_files(spark, domain, tmp_path):
    lines = domain.expense_messages.where("value IS NOT NULL").select(F.col("value").cast("string"))
    lines.write.option("compression", "gzip").text(f"{tmp_path}/lines/2024/01/01/00")
    read = bronze.bronze_rows(feeds.json_lines(spark, f"{tmp_path}/lines"), schemas.EXPENSES)
    read.writeStream.format("memory").queryName("from_lines").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("from_lines").count() == domain.events_k.where("k NOT IN (7, 9)").count()

    put_messages(domain.expense_messages, f"{tmp_path}/inbox", 2)
    messages = feeds.messages_from_files(spark, f"{tmp_path}/inbox")
    ingest.start_backup(messages, f"{tmp_path}/backup", f"{tmp_path}/ck", ingest.DRAIN).awaitTermination()
    backup = spark.read.parquet(f"{tmp_path}/backup")
    assert backup.count() == domain.expense_messages.count() and {"year", "month", "day", "hour"} <= set(backup.columns)

    folder = tmp_path / "ocr" / "tenant=t_1" / "expense=exp_9"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text('{"response": "x"}')
    row = feeds.raw_ocr_files(spark, f"{tmp_path}/ocr", "response string", stream=False).first()
    assert (row.tenant_id, row.expense_id, row.response) == ("t_1", "exp_9", "x")
    files = feeds.raw_ocr_files(spark, f"{tmp_path}/ocr", "response string")
    ingest.start_raw_ocr(files, f"{tmp_path}/raw", f"{tmp_path}/ck2", ingest.DRAIN).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 1


def test_sinks(spark, domain, tmp_path):
    docs = domain.expenses.select("expense_id", "tenant_id", "user_id", F.col("amount").cast("double"), "status",
                                  F.col("created_at").cast("string"))
    docs.write.json(f"{tmp_path}/export")
    assert tables.seed_collection(spark, f"{tmp_path}/export", f"{tmp_path}/seeded", schemas.EXPENSES)
    assert spark.read.parquet(f"{tmp_path}/seeded").count() == docs.count()
    assert not tables.overwrite_snapshot(docs.where("false"), f"{tmp_path}/seeded")
    assert spark.read.parquet(f"{tmp_path}/seeded").count() == docs.count()

    for _ in range(2):
        tables.append_embeddings(domain.embedding_log, f"{tmp_path}/emb")
    assert spark.read.parquet(f"{tmp_path}/emb").count() == 2 * domain.embedding_log.count()

    tables.overwrite_partitioned(docs, f"{tmp_path}/part")
    before = spark.read.parquet(f"{tmp_path}/part").count()
    tables.overwrite_touched_partitions(docs.where("tenant_id = 't_1'").limit(1), f"{tmp_path}/part")
    after = spark.read.parquet(f"{tmp_path}/part")
    assert after.where("tenant_id = 't_1'").count() == 1
    assert after.count() == before - docs.where("tenant_id = 't_1'").count() + 1
    admin = tables.read_for(spark, f"{tmp_path}/part", tables.Caller(is_admin=True))
    nobody = tables.read_for(spark, f"{tmp_path}/part", tables.Caller())
    assert admin.count() == after.count() and nobody.isEmpty()


def test_partitioned_files_are_few(spark, domain, tmp_path):
    import glob

    many = domain.expenses.select("expense_id", "tenant_id").repartition(16)
    tables.overwrite_partitioned(many, f"{tmp_path}/t")
    assert len(glob.glob(f"{tmp_path}/t/tenant_id=*/*.parquet")) == 5  # not 16 tasks x 5 tenants


def test_one_read_per_topic_survives_a_crash_between_its_tables(spark, domain, tmp_path, monkeypatch):
    lake = medallion.Lake(f"{tmp_path}/lake")
    put_messages(domain.expense_messages, f"{tmp_path}/inbox", 3)

    def drain():
        source = feeds.messages_from_files(spark, f"{tmp_path}/inbox", max_files=1)
        started = medallion.ingest(spark, lake, {"expenses": source}, ingest.DRAIN)
        assert len(started) == 1
        started[0].awaitTermination()

    real, calls = ingest.write_once, []

    def dies(df, folder):
        calls.append(folder)
        if len(calls) == 4:  # the second batch: bronze is there, its dead letters are not
            raise RuntimeError("lost")
        real(df, folder)

    with monkeypatch.context() as m:
        m.setattr(ingest, "write_once", dies)
        with pytest.raises(Exception, match="lost"):
            drain()
    assert len(calls) == 4 and calls[2].startswith(lake.bronze("expenses"))
    drain()
    want = bronze.bronze_rows(domain.expense_messages, schemas.EXPENSES)
    columns = ["expense_id", "amount", "status", "_kafka_offset", "__op"]
    assert rows_of(spark.read.parquet(lake.bronze("expenses")).select(*columns)) == rows_of(want.select(*columns))
    dead = bronze.dead_letters(domain.expense_messages, schemas.EXPENSES)
    columns = ["topic_original", "partition", "offset", "payload_raw", "error_message"]
    assert rows_of(spark.read.parquet(lake.dead_letters("expenses")).select(*columns)) == rows_of(dead.select(*columns))


def test_expectations_are_counted_per_batch_and_not_doubled_by_a_retry(spark, domain, tmp_path):
    lake = medallion.Lake(f"{tmp_path}/lake")

    def send(rows, number):
        df = spark.createDataFrame(rows, "expense_id string, tenant_id string, amount double, status string, op string")
        put_messages(domain.as_messages(df.drop("op"), "expenses", "'u'", f"{number}L", "1L") if number < 3 else domain.as_messages(df.drop("op"), "expenses", "'d'", "3L", "1L"),
                     f"{tmp_path}/in", 1)
        source = feeds.messages_from_files(spark, f"{tmp_path}/in")
        for q in medallion.ingest(spark, lake, {"expenses": source}, ingest.DRAIN):
            q.awaitTermination()
        medallion.refresh_silver(spark, lake, ["expenses"])

    def counts():
        rows = medallion.expectation_counts(spark, lake).groupBy("expectation").agg(F.sum("failed").alias("f"), F.sum("total").alias("t"), F.count("*").alias("n")).collect()
        return {r.expectation: (r.f, r.t, r.n) for r in rows}

    send([("e1", "t", 5.0, "approved", ""), ("e2", "t", -1.0, "approved", ""), ("e3", "t", 0.0, "bogus", ""), ("e4", "t", 2e9, None, "")], 1)
    assert counts() == {"valid_amount": (3, 4, 1), "valid_tenant": (0, 4, 1), "valid_status": (2, 4, 1)}
    assert {r.expense_id for r in medallion.silver_table(spark, lake, "expenses").collect()} == {"e1", "e2"}
    send([("e5", "t", -3.0, "bogus", "")], 2)
    send([("e1", "t", None, None, "")], 3)  # a delete carries nothing but the key
    want = {"valid_amount": (4, 6, 3), "valid_tenant": (0, 6, 3), "valid_status": (3, 6, 3)}
    assert counts() == want
    # The last batch is run again, as after a failure before its commit.
    commits = tmp_path / "lake" / "_checkpoints" / "silver_expenses" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for p in commits.iterdir():
        if p.name in (str(last), f".{last}.crc"):
            p.unlink()
    medallion.refresh_silver(spark, lake, ["expenses"])
    assert counts() == want
    assert {r.expense_id for r in medallion.silver_table(spark, lake, "expenses").collect()} == {"e2"}
