"""Domain tables derived from the generic star schema, whole tables each.

Every table is a narrow projection (or an equi-join) of one source table, so the work of a
query grows with its input. ``cuentaclara.plans.oracle`` states the same rules in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.functions import text
from cuentaclara.functions.embedders import HashingEmbedder

#: "Now" for tables derived from orders and lineitem, and for those derived from events.
ORDERS_NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"

CATEGORY = (
    "CASE (o_orderkey div 5) % 5 WHEN 0 THEN 'travel' WHEN 1 THEN 'food' WHEN 2 THEN 'lodging' "
    "WHEN 3 THEN 'office' ELSE 'other' END"
)

#: Search batch: (query_id, tenant, text). The vector is the hashed text.
QUESTIONS = (
    ("q0", "t_0", "retitioning ouen the of expenses"),
    ("q1", "t_1", "and reti thing whou travel"),
    ("q2", "t_2", "is the aux le ouentre"),
    ("q3", "t_3", "ouen th that reau"),
    ("q4", "t_4", "in er rest the onan"),
)
VECTOR_WIDTH = 64


def question_vectors() -> list[tuple[str, str, str, list[float]]]:
    embed = HashingEmbedder(VECTOR_WIDTH)
    return [(q, t, text, embed([text])[0]) for q, t, text in QUESTIONS]


def orders_now():
    return F.lit(ORDERS_NOW).cast("timestamp")


def events_now():
    return F.lit(EVENTS_NOW).cast("timestamp")


class Domain:
    """Lazy access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        # Results must not depend on the machine's zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- change feed of expenses, from events ---------------------------------------------

    @cached_property
    def events_k(self) -> DataFrame:
        return self.source("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def expense_messages(self) -> DataFrame:
        """Broker messages; some are tombstones (k = 9), some are cut off (k = 7)."""
        iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
        doc = self.events_k.selectExpr(
            "event_id", "ts", "user_id", "k",
            f"""to_json(named_struct(
                'expense_id', 'exp_' || user_id || '_' || (k % 20),
                'tenant_id', 't_' || (user_id % 5),
                'user_id', 'u_' || user_id,
                'workflow_id', 'expense-' || user_id || '-' || (k % 20),
                'amount', value,
                'currency', CASE user_id % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END,
                'date', cast(cast(ts AS date) AS string),
                'vendor', 'vendor ' || (user_id % 40),
                'category', CASE k % 5 WHEN 0 THEN 'travel' WHEN 1 THEN 'food' WHEN 2 THEN 'lodging'
                            WHEN 3 THEN 'office' ELSE 'other' END,
                'status', CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing'
                          WHEN 'signup' THEN 'hitl_required' ELSE 'approved' END,
                'final_amount', CASE WHEN event_type = 'purchase' THEN value END,
                'source_per_field', map('amount', CASE WHEN k % 2 = 0 THEN 'user' ELSE 'ocr' END),
                'approved_at', CASE WHEN event_type = 'purchase' THEN {iso} END,
                'created_at', {iso},
                'updated_at', {iso},
                '__op', CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END,
                '__source_ts_ms', unix_micros(ts) div 1000,
                '__deleted', CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END
            )) AS doc""",
        )
        value = F.when(F.col("k") == 9, None).when(F.col("k") == 7, F.left("doc", F.lit(25))).otherwise(F.col("doc"))
        return doc.select(
            value.cast("binary").alias("value"), F.lit("cdc.expenses").alias("topic"),
            (F.col("user_id") % 6).cast("int").alias("partition"), F.col("event_id").alias("offset"),
            F.col("ts").alias("timestamp"),
        )

    #: How timestamps are spelled on the wire.
    WIRE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

    @classmethod
    def as_messages(cls, df: DataFrame, topic: str, op: str, seq: str, offset: str) -> DataFrame:
        """Rows as broker messages of one topic; op, seq and offset are SQL expressions."""
        helpers = ("_op", "_source_ts_ms", "_tiebreak", "n", "k")
        payload = [F.col(c) for c in df.columns if c not in helpers]
        envelope = [F.expr(op).alias("__op"), F.expr(seq).alias("__source_ts_ms"), F.lit(False).alias("__deleted")]
        return df.select(
            F.to_json(F.struct(*payload, *envelope), cls.WIRE).cast("binary").alias("value"),
            F.lit(f"cdc.{topic}").alias("topic"), F.lit(0).alias("partition"), F.expr(offset).alias("offset"),
        )

    @cached_property
    def receipt_messages(self) -> DataFrame:
        """Half of the producers still send ``mime_type`` instead of ``content_type``."""
        jpeg = F.col("content_type") == "image/jpeg"
        shaped = self.receipts.withColumn("mime_type", F.when(jpeg, F.col("content_type"))).withColumn(
            "content_type", F.when(~jpeg, F.col("content_type"))
        )
        return self.as_messages(shaped, "receipts", "'c'", "unix_millis(uploaded_at)", "size_bytes")

    @cached_property
    def hitl_messages(self) -> DataFrame:
        """Conflict lists as names, as objects and as ``_0`` maps, depending on the task."""
        names = "discrepancy_fields"
        # The names are letters only, so joining them is JSON; to_json of each shape took a fifth of the messages' time.
        raw = f"""CASE WHEN decision IS NULL THEN '["' || array_join({names}, '","') || '"]'
            WHEN decision = 'accept_ocr' THEN '[{{"field":"' || array_join({names}, '","confidence":90}},{{"field":"') || '","confidence":90}}]'
            ELSE '{{' || array_join(transform({names}, (x, i) -> '"_' || i || '":"' || x || '"'), ',') || '}}' END"""
        shaped = self.hitl_changes.withColumn("_raw", F.expr(raw)).withColumn("discrepancy_fields", F.lit("@@"))
        text = F.to_json(F.struct(
            *[F.col(c) for c in shaped.columns if c not in ("_op", "_source_ts_ms", "_tiebreak", "_raw")],
            F.col("_op").alias("__op"), F.col("_source_ts_ms").alias("__source_ts_ms"),
        ), self.WIRE)
        return shaped.select(
            F.replace(text, F.lit('"@@"'), F.col("_raw")).cast("binary").alias("value"),
            F.lit("cdc.hitl_tasks").alias("topic"), F.lit(0).alias("partition"), F.col("_tiebreak").alias("offset"),
        )

    @cached_property
    def ocr_messages(self) -> DataFrame:
        return self.as_messages(
            self.ocr.drop("o_orderkey"), "ocr_extractions", "'u'", "unix_millis(extracted_at)", "0L"
        )

    @cached_property
    def event_messages(self) -> DataFrame:
        rows = self.timeline.drop("actor_type", "actor_id", "trace_id", "user_id")
        # The actor is an object on the wire.
        text = F.to_json(F.struct(
            *[F.col(c) for c in rows.columns if c not in ("n", "k", "actor")], F.lit("@@").alias("actor"),
            F.lit("c").alias("__op"), F.unix_millis("created_at").alias("__source_ts_ms"),
        ), self.WIRE)
        return rows.select(
            F.replace(text, F.lit('"@@"'), F.col("actor")).cast("binary").alias("value"),
            F.lit("cdc.expense_events").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("offset"),
        )

    # --- current state, from orders -------------------------------------------------------

    @cached_property
    def expenses(self) -> DataFrame:
        base = self.source("orders").selectExpr(
            "o_orderkey",
            "'exp_' || lpad(cast(o_orderkey AS string), 8, '0') AS expense_id",
            "'t_' || (o_orderkey % 5) AS tenant_id",
            "'u_' || o_custkey AS user_id",
            "CASE WHEN o_orderpriority <> '5-LOW' THEN 'rcp_' || lpad(cast(o_orderkey AS string), 8, '0') END AS receipt_id",
            "'expense-' || o_orderkey AS workflow_id",
            "cast(o_totalprice AS decimal(18,2)) AS amount",
            "CASE o_custkey % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency",
            "cast(o_orderdate AS date) AS date",
            "'vendor ' || (o_custkey % 40) AS vendor",
            f"{CATEGORY} AS category",
            """CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'processing' ELSE
               CASE o_orderkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending'
               WHEN 2 THEN 'hitl_required' ELSE 'bogus' END END AS status""",
            "cast(o_orderdate AS timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS created_at",
            "o_orderpriority",
        )
        decided = "status IN ('approved', 'rejected')"
        return base.selectExpr(
            "*",
            "created_at + make_dt_interval(0, 0, cast((o_orderkey % 50) * 7 + 1 AS int)) AS updated_at",
            f"CASE WHEN {decided} AND o_orderkey % 3 <> 0 THEN cast(amount + o_orderkey % 4 AS decimal(18,2)) END AS final_amount",
            "CASE WHEN status = 'approved' AND o_orderkey % 6 = 0 THEN 'final ' || vendor END AS final_vendor",
            "CASE WHEN status = 'approved' AND o_orderkey % 4 = 0 THEN date_add(date, 1) END AS final_date",
            "CASE WHEN status = 'approved' AND o_orderkey % 5 = 1 THEN lower(currency) END AS final_currency",
            """CASE WHEN status = 'approved' THEN map(
                'amount', CASE WHEN o_orderkey % 3 = 0 THEN 'ocr' ELSE 'user' END,
                'vendor', CASE WHEN o_orderkey % 6 = 0 THEN 'hitl_custom' ELSE 'user' END,
                'date', 'user', 'currency', 'user') END AS source_per_field""",
            """CASE WHEN status = 'approved' AND o_orderkey % 9 <> 0
               THEN created_at + make_dt_interval(0, 8, 0, o_orderkey % 60) END AS approved_at""",
            """CASE WHEN status = 'rejected' THEN CASE (o_orderkey div 4) % 3 WHEN 0 THEN 'VECTOR_SYNC_TIMEOUT'
               WHEN 1 THEN 'VECTOR_SYNC_FAILED' ELSE 'CANCELLED' END END AS rejection_reason""",
        )

    @cached_property
    def ocr(self) -> DataFrame:
        """Urgent orders have no extraction. ``ocr_extra`` comes in all shapes, valid or not."""
        count = "cast(o_orderkey % 4 AS int)"
        items = f"""transform(slice(array(1, 2, 3), 1, {count}), i -> named_struct(
            'quantity', i || 'x', 'item', 'item ' || (o_orderkey % 100) || '-' || i,
            'unit_price', CASE WHEN i % 2 = 1 THEN cast(o_orderkey % 90 + i AS string) END,
            'price', cast((o_orderkey % 90 + i) * i AS string)))"""
        fields = "array(named_struct('field', 'tax', 'value', cast(o_orderkey % 1000 AS string)))"

        def keyed(array: str) -> str:
            return f"map_from_entries(transform({array}, (x, i) -> struct('_' || i, x)))"

        return self.expenses.where("o_orderpriority <> '1-URGENT'").selectExpr(
            "o_orderkey", "expense_id", "tenant_id", "user_id",
            "CASE WHEN o_orderkey % 11 <> 0 THEN cast(amount + (o_orderkey % 5) * 500 AS decimal(18,2)) END AS ocr_total",
            "cast(70 + o_orderkey % 30 AS double) AS ocr_total_confidence",
            """CASE WHEN o_orderkey % 7 = 0 THEN replace(vendor, 'vendor', 'vendr')
               WHEN o_orderkey % 13 = 0 THEN 'acme' ELSE vendor END AS ocr_vendor""",
            "cast(65 + o_orderkey % 35 AS double) AS ocr_vendor_confidence",
            "CASE WHEN o_orderkey % 8 = 0 THEN date_add(date, 1) ELSE date END AS ocr_date",
            "cast(75 + o_orderkey % 25 AS double) AS ocr_date_confidence",
            "CASE WHEN o_orderkey % 6 <> 0 THEN currency END AS ocr_currency",
            "cast(60 + o_orderkey % 40 AS double) AS avg_confidence",
            f"""CASE WHEN o_orderkey % 12 = 5 THEN NULL WHEN o_orderkey % 12 = 7 THEN 'not json'
                WHEN o_orderkey % 2 = 0 THEN to_json(named_struct('summary_fields', {fields}, 'line_items', {items}))
                ELSE to_json(named_struct('summary_fields', {keyed(fields)}, 'line_items', {keyed(items)})) END AS ocr_extra""",
            "'raw/' || expense_id || '.json' AS textract_raw_s3_key",
            "created_at + make_dt_interval(0, 0, 0, 90) AS extracted_at",
        )

    @cached_property
    def receipts(self) -> DataFrame:
        """Receipts of urgent orders were stored before they knew their expense."""
        return self.expenses.where("receipt_id IS NOT NULL").selectExpr(
            "receipt_id", "tenant_id", "user_id",
            "CASE WHEN o_orderpriority <> '1-URGENT' THEN expense_id END AS expense_id",
            "'s3/' || receipt_id AS s3_key",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'image/jpeg' ELSE 'application/pdf' END AS content_type",
            "o_orderkey * 10 AS size_bytes",
            "created_at - make_dt_interval(0, 0, 1) AS uploaded_at",
        )

    # --- review tasks, from lineitem ------------------------------------------------------

    @cached_property
    def hitl_changes(self) -> DataFrame:
        """Change log of review tasks, in the shape of the silver projection."""
        return self.source("lineitem").selectExpr(
            "'hitl_' || l_orderkey || '_' || l_linenumber AS task_id",
            "'t_' || (l_orderkey % 5) AS tenant_id",
            "'exp_' || lpad(cast(l_orderkey AS string), 8, '0') AS expense_id",
            "'expense-' || l_orderkey AS workflow_id",
            "CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'resolved' END AS status",
            """CASE l_linenumber % 3 WHEN 0 THEN array('amount') WHEN 1 THEN array('amount', 'vendor')
               ELSE array('date') END AS discrepancy_fields""",
            """CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'A' THEN 'accept_ocr'
               WHEN 'R' THEN 'keep_user_value' ELSE 'custom' END END AS decision""",
            """CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N'
               THEN map('amount', cast(cast(l_extendedprice AS decimal(18,2)) AS string)) ELSE
               cast(map() AS map<string,string>) END AS resolved_fields""",
            "CASE WHEN l_linestatus = 'F' THEN 'rev_' || (l_suppkey % 10) END AS resolved_by",
            """CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS timestamp)
               + make_dt_interval(0, 0, cast(l_partkey % 1440 + l_quantity * 7 AS int), l_suppkey % 60) END AS resolved_at""",
            "cast(l_shipdate AS timestamp) + make_dt_interval(0, 0, cast(l_partkey % 1440 AS int)) AS created_at",
            "CASE WHEN l_discount = 0.1 THEN 'd' ELSE 'u' END AS _op",
            "unix_micros(cast(l_shipdate AS timestamp)) div 1000 AS _source_ts_ms",
            """l_partkey * 1000000000000 + l_suppkey * 100000000
               + cast(round(l_extendedprice * 100) AS bigint) % 100000000 AS _tiebreak""",
        )

    @cached_property
    def hitl(self) -> DataFrame:
        from cuentaclara.operators.cdc import silver_state

        return silver_state(self.hitl_changes, "task_id")

    # --- timeline, from events ------------------------------------------------------------

    @cached_property
    def timeline(self) -> DataFrame:
        return self.events_k.selectExpr(
            "'evt_' || lpad(cast(event_id AS string), 10, '0') AS event_id",
            "'exp_' || lpad(cast(event_id div 4 AS string), 8, '0') AS expense_id",
            "'t_' || ((event_id div 4) % 5) AS tenant_id",
            """CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'ocr_started'
               WHEN 'click' THEN 'ocr_completed' WHEN 'purchase' THEN 'approved' ELSE 'hitl_resolved' END AS event_type""",
            """'{"type":"' || CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'system' END || '","id":"a_' || user_id || '"}' AS actor""",
            """CASE WHEN event_type = 'error' THEN map('hitl_task_id', 'hitl_' || (event_id div 4) || '_1',
               'decision', 'keep_user_value', 'resolved_fields', '{"amount":"' || k || '"}')
               ELSE cast(map() AS map<string,string>) END AS details""",
            "'expense-' || (event_id div 4) AS workflow_id",
            """CASE WHEN k % 3 <> 0 THEN map('trace_id', 'trace_' || user_id)
               ELSE cast(map() AS map<string,string>) END AS metadata""",
            "ts AS created_at",
            "event_id AS n", "user_id", "k",
        ).selectExpr(
            "*",
            "CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'system' END AS actor_type",
            "'a_' || user_id AS actor_id",
            "try_element_at(metadata, 'trace_id') AS trace_id",
        )

    @cached_property
    def replay_requests(self) -> DataFrame:
        """Every seventh event is the last one that a client of its user channel saw; some clients send something else."""
        seen = self.timeline.where("n % 7 = 0")
        own = F.concat(F.lit("evt_"), text.ulid_head(F.unix_millis(F.col("created_at"))), F.lpad(F.col("n").cast("string"), 16, "0"))
        return seen.select(
            F.concat(F.lit("tenant:"), "tenant_id", F.lit(":user:u_"), "user_id").alias("channel"), F.concat(F.lit("client_"), "n").alias("client_id"),
            F.when(F.col("n") % 21 == 0, F.lit("evt_broken")).otherwise(own).alias("last_event_id"))

    # --- runs and logs, from events -------------------------------------------------------

    @cached_property
    def jobs(self) -> DataFrame:
        return self.source("region").selectExpr(
            "cast(r_regionkey AS bigint) AS pipeline_id",
            """'audit-' || CASE r_regionkey WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold'
               ELSE lower(r_name) END AS name""",
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.events_k.selectExpr(
            "user_id % 5 AS pipeline_id", "event_id AS update_id",
            """CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELED' ELSE 'COMPLETED' END AS result_state""",
            "ts AS period_start_time",
            "ts + make_dt_interval(0, 0, 0, k) AS period_end_time",
        )

    @cached_property
    def logs(self) -> DataFrame:
        tool = "CASE event_type WHEN 'view' THEN 'search_structured' WHEN 'purchase' THEN 'search_semantic' END"
        return self.events_k.selectExpr(
            "ts AS timestamp",
            "CASE WHEN k % 3 <> 0 THEN 'trace_' || user_id END AS trace_id",
            "'req_' || lpad(cast(event_id AS string), 10, '0') AS request_id",
            "'expense-' || user_id AS workflow_id",
            "CASE WHEN event_id % 2 = 0 THEN 'backend' ELSE 'worker' END AS service",
            "CASE WHEN event_id % 2 = 0 THEN 'backend' ELSE 'worker' END || '/' || (user_id % 4) AS stream",
            "CASE WHEN event_type = 'click' THEN 'request.completed' ELSE event_type END AS event",
            "CASE WHEN event_type = 'click' THEN 'GET' END AS method",
            "CASE WHEN event_type = 'click' THEN '/expenses/' || (k % 7) END AS path",
            """CASE WHEN event_type = 'click' THEN CASE WHEN k % 10 = 0 THEN 500 WHEN k % 10 < 3 THEN 404
               ELSE 200 END END AS status_code""",
            "CASE WHEN event_type = 'click' THEN value END AS elapsed_ms",
            f"{tool} AS tool",
            f"CASE WHEN {tool} IS NOT NULL THEN value END AS latency_ms",
            f"CASE WHEN {tool} IS NOT NULL THEN k % 4 END AS row_count",
            f"CASE WHEN {tool} IS NOT NULL THEN CASE WHEN k % 4 = 0 THEN 'empty' ELSE 'ok' END END AS outcome",
            "CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level",
            "CASE WHEN event_type = 'error' THEN 'code ' || (k % 6) END AS error",
            "event_type || ' at step ' || (k % 8) || '\\n\\tworker ' || (user_id % 4) || CASE WHEN k % 25 = 0 THEN ' Finished start' ELSE '' END AS msg",
        )

    @cached_property
    def tool_calls(self) -> DataFrame:
        return self.events_k.selectExpr(
            "CASE WHEN user_id % 2 = 0 THEN 'search_structured' ELSE 'search_semantic' END AS tool",
            "k % 4 AS row_count", "value AS latency_ms",
            "CASE WHEN event_type = 'error' THEN 'ValueError: bad' END AS error",
            "event_type = 'signup' AND k % 10 = 0 AS invalid",
        )

    @cached_property
    def model_calls(self) -> DataFrame:
        """Raw model calls with content blocks."""
        return self.events_k.selectExpr(
            "ts AS timestamp", "'trace_' || user_id AS trace_id", "'rag-' || user_id AS workflow_id",
            "event_id",
            "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'tool_use' ELSE 'end_turn' END AS stop_reason",
            """CASE WHEN event_type = 'view' THEN array(
                 named_struct('text', repeat('a', cast(k AS int)), 'tool_name', cast(NULL AS string), 'tool_input', cast(NULL AS map<string,string>)),
                 named_struct('text', cast(NULL AS string), 'tool_name', CASE WHEN k % 2 = 0 THEN 'search_structured' ELSE 'search_semantic' END,
                              'tool_input', map('vendor', 'x', 'amount_min', cast(k AS string))))
               ELSE array(
                 named_struct('text', repeat('b', cast(user_id % 50 AS int)), 'tool_name', cast(NULL AS string), 'tool_input', cast(NULL AS map<string,string>)))
               END AS content""",
            "k * 10 AS input_tokens", "user_id % 100 AS output_tokens",
            "CASE WHEN event_type <> 'error' THEN k * 10 + user_id % 100 END AS total_tokens",
            "value AS latency_ms",
        )

    # --- chat, from conversations ---------------------------------------------------------

    @cached_property
    def chat_turns(self) -> DataFrame:
        said = self.source("conversations")
        user = said.where("role = 'user'").selectExpr("conv_id", "turn", "text AS user_message")
        answer = said.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS assistant_message")
        return user.join(answer, ["conv_id", "turn"], "left").selectExpr(
            "'sess_' || conv_id AS session_id", "turn", "'t_' || (conv_id % 5) AS tenant_id", "'u_' || (conv_id % 50) AS user_id",
            "user_message", "assistant_message",
            "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(conv_id * 37 AS int), turn) AS created_at",
        )

    @cached_property
    def chat_log(self) -> DataFrame:
        """Turn writes, each stored twice: a draft and its final text."""
        return self.chat_turns.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
            "assistant_message", F.when(F.col("version") == 1, F.lit("...")).otherwise(F.col("assistant_message"))
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Assistant texts with a link to a real expense and, on some turns, an invented one."""
        return self.source("conversations").where("role = 'assistant'").selectExpr(
            "conv_id", "turn",
            """text || '\\n\\n\\n\\n[ver](/expenses/exp_' || lpad(cast(conv_id AS string), 8, '0') || ')'
               || CASE WHEN turn >= 3 THEN ' [otro]( /expenses/exp_zz' || turn || ' )' ELSE '' END
               || ' [ver](/expenses/exp_' || lpad(cast(conv_id + turn AS string), 8, '0') || ') ' AS text""",
        )

    @cached_property
    def tool_rows(self) -> DataFrame:
        rows = self.source("conversations").where("role = 'assistant'").selectExpr(
            "conv_id", "turn", "explode(sequence(0, cast(turn % 3 + 1 AS int))) AS i"
        )
        return rows.selectExpr(
            "conv_id", "turn * 10 + i AS pos",
            """CASE i WHEN 0 THEN 'exp_' || lpad(cast(conv_id AS string), 8, '0')
               WHEN 1 THEN 'exp_' || lpad(cast(conv_id + turn AS string), 8, '0')
               WHEN 2 THEN NULL ELSE '' END AS expense_id""",
            "'vendor ' || (conv_id % 40) AS vendor",
            "CASE WHEN i = 0 THEN cast(conv_id AS string) ELSE 'n/a' END AS amount",
            "'COP' AS currency", "'2024-01-01' AS date", "'food' AS category",
            "CASE WHEN i = 1 THEN '/custom/' || conv_id END AS link",
            "CASE WHEN turn % 4 = 1 THEN 'sql' WHEN i = 0 THEN 'semantic' END AS _source",
            "CASE WHEN turn = 7 THEN 'timeout' END AS error",
        )

    @cached_property
    def tool_messages(self) -> DataFrame:
        """Tool results as messages: a list, an object with rows, a failed call that still names a row, an aggregate."""
        row = """'{"expense_id":"exp_' || lpad(cast(conv_id + @n AS string), 8, '0') || '","vendor":"vendor ' || (conv_id % 40) || '","amount":' || turn || ',"_source":"sql"}'"""
        return self.source("conversations").where("role = 'assistant'").selectExpr(
            "conv_id", "turn", "CASE WHEN turn % 8 = 5 THEN 'assistant' ELSE 'user' END AS role",
            f"""'[{{"text":"x"}},{{"toolResult":{{"content":[{{"json":' ||
                CASE turn % 4 WHEN 0 THEN '[' || {row.replace("@n", "0")} || ',' || {row.replace("@n", "1")} || ']' WHEN 1 THEN '{{"rows":[' || {row.replace("@n", "2")} || ']}}'
                WHEN 2 THEN '{{"error":"timeout","rows":[' || {row.replace("@n", "3")} || ']}}' ELSE '{{"total":' || turn || '}}' END || '}}]}}}}]' AS content""",
        )

    # --- retrieval, from documents and embeddings -----------------------------------------

    @cached_property
    def chunks(self) -> DataFrame:
        return self.source("documents").selectExpr(
            "'chk_' || doc_id AS chunk_id", "'t_' || (doc_id % 5) AS tenant_id",
            "'exp_' || lpad(cast(doc_id AS string), 8, '0') AS expense_id", "text AS chunk_text",
            "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int)) AS approved_at",
        )

    @cached_property
    def embedding_log(self) -> DataFrame:
        """Every third vector was written twice; the older version is reversed."""
        versions = "explode(CASE WHEN vec_id % 3 = 0 THEN array(0, 1) ELSE array(1) END)"
        return self.source("embeddings").selectExpr("vec_id", "embedding", f"{versions} AS v").selectExpr(
            "'chk_' || vec_id AS chunk_id", "'t_' || (vec_id % 5) AS tenant_id",
            "CASE WHEN v = 0 THEN reverse(embedding) ELSE embedding END AS embedding",
            "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(v) AS updated_at",
        )

    @cached_property
    def questions(self) -> DataFrame:
        return self.spark.createDataFrame(
            question_vectors(), "query_id string, tenant_id string, query_text string, query_vec array<double>"
        )

    # --- OCR responses, from orders -------------------------------------------------------

    @cached_property
    def ocr_responses(self) -> DataFrame:
        """Raw OCR responses as JSON, one per order; totals repeat, extras and line items vary."""
        def field(kind: str, text: str, confidence: str, label: str = "NULL") -> str:
            return (
                f"named_struct('Type', named_struct('Text', '{kind}'), 'ValueDetection', "
                f"named_struct('Text', {text}, 'Confidence', cast({confidence} AS double)), "
                f"'LabelDetection', named_struct('Text', cast({label} AS string)))"
            )
        def cell(kind: str, text: str, confidence: str) -> str:
            return (
                f"named_struct('Type', named_struct('Text', '{kind}'), 'ValueDetection', "
                f"named_struct('Text', {text}, 'Confidence', cast({confidence} AS double)))"
            )
        amount = "cast(amount AS string)"
        summary = f"""concat(
            array({field('TOTAL', "'0.00'", '10')}),
            CASE WHEN o_orderkey % 5 <> 0 THEN array({field('VENDOR_NAME', 'vendor', '60 + o_orderkey % 40')}) ELSE array() END,
            array({field('TOTAL', amount + " || ' ' || currency", '50 + o_orderkey % 50')}),
            CASE WHEN o_orderkey % 7 <> 0 THEN array({field('INVOICE_RECEIPT_DATE', "date_format(date, 'dd/MM/yyyy')", '90')}) ELSE array() END,
            array({field('TAX', 'cast(o_orderkey % 1000 AS string)', '80', "'IVA'")},
                  {field('LOYALTY_ID', "'L' || substr(user_id, 3)", '0')}))"""
        items = f"""transform(slice(array(1, 2, 3), 1, cast(o_orderkey % 4 AS int)), i -> named_struct('LineItemExpenseFields', array(
            {cell('ITEM', "'item ' || i", '90')}, {cell('PRICE', 'cast(i * 10 AS string)', '80 + o_orderkey % 10')},
            {cell('EXPENSE_ROW', "'row ' || i", '0')}, {cell('EXPENSE_ROW', "'again'", '0')}, {cell('COLOR', "'c' || i", '70')})))"""
        empty_line = "array(named_struct('LineItemExpenseFields', filter(array({}), x -> false)))".format(cell("ITEM", "'x'", "1"))
        return (
            self.expenses.select(
                "o_orderkey", "expense_id", "tenant_id", "user_id", "amount", "currency", "date", "vendor")
            .selectExpr(
                "expense_id", "tenant_id", "o_orderkey",
                f"""to_json(named_struct('ExpenseDocuments', array(named_struct(
                    'SummaryFields', {summary},
                    'LineItemGroups', array(named_struct('LineItems', concat({items}, {empty_line}))))))) AS response""",
            )
        )

    @cached_property
    def query_responses(self) -> DataFrame:
        """Follow-up question responses; the date answer is missing on some."""
        block = (
            "named_struct('BlockType', '{0}', 'Id', '{1}', 'Text', {2}, 'Confidence', cast({3} AS double), "
            "'Query', named_struct('Alias', cast({4} AS string)))"
        )
        asked = ", ".join(
            block.format("QUERY", f"q{i}", "cast(NULL AS string)", "NULL", f"'{a}'") for i, a in enumerate(("TOTAL", "DATE", "VENDOR"))
        )
        total = block.format("QUERY_RESULT", "r0", "cast(amount AS string)", "95", "NULL")
        day = block.format("QUERY_RESULT", "r1", "cast(date AS string)", "40 + o_orderkey % 60", "NULL")
        vendor = block.format("QUERY_RESULT", "r2", "upper(vendor)", "70", "NULL")
        orders = self.expenses.select("o_orderkey", "expense_id", "tenant_id", "amount", "date", "vendor")
        return orders.selectExpr(
            "expense_id", "tenant_id", "o_orderkey",
            f"""to_json(named_struct('Blocks', concat(array({asked}), array({total}, {day}),
                CASE WHEN o_orderkey % 3 <> 0 THEN array({vendor}) ELSE array() END))) AS response""",
        )
