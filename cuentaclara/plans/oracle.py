"""The derived tables of ``plans.domain`` in plain SQL, for checking results with another engine."""

from __future__ import annotations

import re

from cuentaclara.plans.domain import EVENTS_NOW, ORDERS_NOW, question_vectors


def _questions() -> str:
    rows = []
    for query_id, tenant, text, vector in question_vectors():
        values = ", ".join(repr(x) for x in vector)
        rows.append(f"('{query_id}', '{tenant}', '{text}', [{values}]::DOUBLE[])")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS q(query_id, tenant_id, query_text, query_vec)"


_LPAD8 = "'exp_' || lpad(CAST({} AS VARCHAR), 8, '0')"

TABLES: dict[str, str] = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "bronze_expenses": """
        SELECT 'exp_' || user_id || '_' || (k % 20) AS expense_id, 't_' || (user_id % 5) AS tenant_id,
               'u_' || user_id AS user_id, 'expense-' || user_id || '-' || (k % 20) AS workflow_id,
               CAST(value AS DECIMAL(18,2)) AS amount,
               CASE user_id % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
               CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'vendor ' || (user_id % 40) AS vendor,
               CASE k % 5 WHEN 0 THEN 'travel' WHEN 1 THEN 'food' WHEN 2 THEN 'lodging' WHEN 3 THEN 'office' ELSE 'other' END AS category,
               CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'hitl_required' ELSE 'approved' END AS status,
               CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS final_amount,
               CASE WHEN k % 2 = 0 THEN 'user' ELSE 'ocr' END AS amount_source,
               CASE WHEN event_type = 'purchase' THEN ts END AS approved_at, ts AS created_at, ts AS updated_at,
               CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
               epoch_us(ts) // 1000 AS source_ts_ms, event_type = 'error' AS deleted, event_id AS off
        FROM ev WHERE k NOT IN (7, 9)""",
    "cdc_state": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY expense_id ORDER BY source_ts_ms DESC, off DESC) AS rn
                       FROM bronze_expenses) t WHERE rn = 1 AND op <> 'd'""",
    "exp0": f"""
        SELECT o_orderkey, {_LPAD8.format('o_orderkey')} AS expense_id, 't_' || (o_orderkey % 5) AS tenant_id,
               'u_' || o_custkey AS user_id,
               CASE WHEN o_orderpriority <> '5-LOW' THEN 'rcp_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS receipt_id,
               'expense-' || o_orderkey AS workflow_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
               CASE o_custkey % 3 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
               CAST(o_orderdate AS DATE) AS date, 'vendor ' || (o_custkey % 40) AS vendor,
               CASE (o_orderkey // 5) % 5 WHEN 0 THEN 'travel' WHEN 1 THEN 'food' WHEN 2 THEN 'lodging' WHEN 3 THEN 'office' ELSE 'other' END AS category,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'processing' ELSE
                 CASE o_orderkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' WHEN 2 THEN 'hitl_required' ELSE 'bogus' END END AS status,
               o_orderdate + to_seconds(o_orderkey % 86400) AS created_at, o_orderpriority
        FROM orders""",
    "expenses": """
        SELECT *, created_at + to_minutes((o_orderkey % 50) * 7 + 1) AS updated_at,
               CASE WHEN status IN ('approved', 'rejected') AND o_orderkey % 3 <> 0 THEN CAST(amount + o_orderkey % 4 AS DECIMAL(18,2)) END AS final_amount,
               CASE WHEN status = 'approved' AND o_orderkey % 6 = 0 THEN 'final ' || vendor END AS final_vendor,
               CASE WHEN status = 'approved' AND o_orderkey % 4 = 0 THEN CAST(date + 1 AS DATE) END AS final_date,
               CASE WHEN status = 'approved' AND o_orderkey % 5 = 1 THEN lower(currency) END AS final_currency,
               CASE WHEN status = 'approved' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'ocr' ELSE 'user' END END AS src_amount,
               CASE WHEN status = 'approved' THEN CASE WHEN o_orderkey % 6 = 0 THEN 'hitl_custom' ELSE 'user' END END AS src_vendor,
               CASE WHEN status = 'approved' AND o_orderkey % 9 <> 0 THEN created_at + to_seconds(28800 + o_orderkey % 60) END AS approved_at,
               CASE WHEN status = 'rejected' THEN CASE (o_orderkey // 4) % 3 WHEN 0 THEN 'VECTOR_SYNC_TIMEOUT' WHEN 1 THEN 'VECTOR_SYNC_FAILED' ELSE 'CANCELLED' END END AS rejection_reason
        FROM exp0""",
    "ocr": """
        SELECT o_orderkey, expense_id, tenant_id, user_id,
               CASE WHEN o_orderkey % 11 <> 0 THEN CAST(amount + (o_orderkey % 5) * 500 AS DECIMAL(18,2)) END AS ocr_total,
               CAST(70 + o_orderkey % 30 AS DOUBLE) AS ocr_total_confidence,
               CASE WHEN o_orderkey % 7 = 0 THEN replace(vendor, 'vendor', 'vendr') WHEN o_orderkey % 13 = 0 THEN 'acme' ELSE vendor END AS ocr_vendor,
               CAST(65 + o_orderkey % 35 AS DOUBLE) AS ocr_vendor_confidence,
               CASE WHEN o_orderkey % 8 = 0 THEN CAST(date + 1 AS DATE) ELSE date END AS ocr_date,
               CAST(75 + o_orderkey % 25 AS DOUBLE) AS ocr_date_confidence,
               CASE WHEN o_orderkey % 6 <> 0 THEN currency END AS ocr_currency,
               CAST(60 + o_orderkey % 40 AS DOUBLE) AS avg_confidence,
               'raw/' || expense_id || '.json' AS textract_raw_s3_key, created_at + to_seconds(90) AS extracted_at
        FROM expenses WHERE o_orderpriority <> '1-URGENT'""",
    "receipts": """
        SELECT receipt_id, tenant_id, user_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN expense_id END AS expense_id,
               's3/' || receipt_id AS s3_key, CASE WHEN o_orderkey % 2 = 0 THEN 'image/jpeg' ELSE 'application/pdf' END AS content_type,
               o_orderkey * 10 AS size_bytes, created_at - to_minutes(1) AS uploaded_at
        FROM expenses WHERE receipt_id IS NOT NULL""",
    "hitl_changes": f"""
        SELECT 'hitl_' || l_orderkey || '_' || l_linenumber AS task_id, 't_' || (l_orderkey % 5) AS tenant_id,
               {_LPAD8.format('l_orderkey')} AS expense_id, 'expense-' || l_orderkey AS workflow_id,
               CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'resolved' END AS status,
               CASE l_linenumber % 3 WHEN 0 THEN ['amount'] WHEN 1 THEN ['amount', 'vendor'] ELSE ['date'] END AS discrepancy_fields,
               CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'A' THEN 'accept_ocr' WHEN 'R' THEN 'keep_user_value' ELSE 'custom' END END AS decision,
               CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS resolved_amount,
               CASE WHEN l_linestatus = 'F' THEN 'rev_' || (l_suppkey % 10) END AS resolved_by,
               CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_minutes(CAST(l_partkey % 1440 + l_quantity * 7 AS BIGINT)) + to_seconds(l_suppkey % 60) END AS resolved_at,
               l_shipdate + to_minutes(l_partkey % 1440) AS created_at,
               CASE WHEN l_discount = 0.1 THEN 'd' ELSE 'u' END AS op, epoch_us(l_shipdate) // 1000 AS source_ts_ms,
               l_partkey * 1000000000000 + l_suppkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000000 AS tiebreak
        FROM lineitem""",
    "hitl": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY source_ts_ms DESC, tiebreak DESC) AS rn
                       FROM hitl_changes) t WHERE rn = 1 AND op <> 'd'""",
    "timeline": f"""
        SELECT 'evt_' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS event_id, {_LPAD8.format('event_id // 4')} AS expense_id,
               't_' || ((event_id // 4) % 5) AS tenant_id,
               CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'ocr_started' WHEN 'click' THEN 'ocr_completed' WHEN 'purchase' THEN 'approved' ELSE 'hitl_resolved' END AS event_type,
               CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'system' END AS actor_type, 'a_' || user_id AS actor_id,
               'expense-' || (event_id // 4) AS workflow_id, CASE WHEN k % 3 <> 0 THEN 'trace_' || user_id END AS trace_id,
               CASE WHEN event_type = 'error' THEN 'hitl_' || (event_id // 4) || '_1' END AS hitl_task_id,
               ts AS created_at, event_id AS n, user_id, k
        FROM ev""",
    "hitl_agg": """
        SELECT expense_id, max(resolved_at) AS hitl_resolved_at, max(decision) AS hitl_decision, max(resolved_by) AS hitl_resolved_by,
               max(discrepancy_fields) AS hitl_conflict_fields
        FROM hitl WHERE status = 'resolved' GROUP BY expense_id""",
    "trace1": """
        SELECT expense_id, trace_id FROM (SELECT expense_id, trace_id,
               row_number() OVER (PARTITION BY expense_id ORDER BY created_at, event_id) AS rn FROM timeline WHERE trace_id IS NOT NULL) t WHERE rn = 1""",
    "audit": """
        SELECT e.tenant_id, e.expense_id, e.user_id, e.receipt_id, e.o_orderkey,
               coalesce(e.final_amount, o.ocr_total, e.amount) AS final_amount, coalesce(e.final_vendor, o.ocr_vendor, e.vendor) AS final_vendor,
               coalesce(e.final_date, o.ocr_date, e.date) AS final_date, coalesce(e.final_currency, o.ocr_currency, e.currency) AS final_currency,
               e.category, coalesce(e.approved_at, e.updated_at) AS approved_at, h.hitl_decision IS NOT NULL AS had_hitl,
               h.hitl_decision, h.hitl_conflict_fields, h.hitl_resolved_by, h.hitl_resolved_at, t.trace_id, o.expense_id IS NOT NULL AS has_ocr,
               o.avg_confidence
        FROM expenses e LEFT JOIN ocr o USING (expense_id) LEFT JOIN hitl_agg h USING (expense_id) LEFT JOIN trace1 t USING (expense_id)
        WHERE e.status = 'approved'""",
    "jobs": """
        SELECT CAST(r_regionkey AS BIGINT) AS pipeline_id,
               'audit-' || CASE r_regionkey WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE lower(r_name) END AS name
        FROM region""",
    "runs": """
        SELECT user_id % 5 AS pipeline_id, event_id AS update_id,
               CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELED' ELSE 'COMPLETED' END AS result_state,
               ts AS period_start_time, ts + to_seconds(k) AS period_end_time
        FROM ev""",
    "logs": """
        SELECT *, CASE WHEN tool IS NOT NULL THEN value END AS latency_ms,
               CASE WHEN tool IS NOT NULL THEN CASE WHEN k % 4 = 0 THEN 'empty' ELSE 'ok' END END AS outcome
        FROM (SELECT ts AS timestamp, CASE WHEN k % 3 <> 0 THEN 'trace_' || user_id END AS trace_id,
               'req_' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS request_id, 'expense-' || user_id AS workflow_id,
               CASE WHEN event_id % 2 = 0 THEN 'backend' ELSE 'worker' END AS service,
               CASE WHEN event_id % 2 = 0 THEN 'backend' ELSE 'worker' END || '/' || (user_id % 4) AS stream,
               CASE WHEN event_type = 'click' THEN 'request.completed' ELSE event_type END AS event,
               CASE WHEN event_type = 'click' THEN 'GET' END AS method, CASE WHEN event_type = 'click' THEN '/expenses/' || (k % 7) END AS path,
               CASE WHEN event_type = 'click' THEN CASE WHEN k % 10 = 0 THEN 500 WHEN k % 10 < 3 THEN 404 ELSE 200 END END AS status_code,
               CASE WHEN event_type = 'click' THEN value END AS elapsed_ms,
               CASE event_type WHEN 'view' THEN 'search_structured' WHEN 'purchase' THEN 'search_semantic' END AS tool,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
               CASE WHEN event_type = 'error' THEN 'code ' || (k % 6) END AS error,
               event_type || ' at step ' || (k % 8) || chr(10) || chr(9) || 'worker ' || (user_id % 4) || CASE WHEN k % 25 = 0 THEN ' Finished start' ELSE '' END AS msg,
               value, k FROM ev) x""",
    "chat_turns": """
        SELECT 'sess_' || u.conv_id AS session_id, u.turn, 't_' || (u.conv_id % 5) AS tenant_id, 'u_' || (u.conv_id % 50) AS user_id,
               u.text AS user_message, a.text AS assistant_message,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(u.conv_id * 37) + to_seconds(u.turn) AS created_at
        FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn AND a.role = 'assistant'
        WHERE u.role = 'user'""",
    "answers": f"""
        SELECT conv_id, turn, text || chr(10) || chr(10) || chr(10) || chr(10) || '[ver](/expenses/' || {_LPAD8.format('conv_id')} || ')'
               || CASE WHEN turn >= 3 THEN ' [otro]( /expenses/exp_zz' || turn || ' )' ELSE '' END
               || ' [ver](/expenses/' || {_LPAD8.format('conv_id + turn')} || ') ' AS text
        FROM conversations WHERE role = 'assistant'""",
    "tool_rows": f"""
        SELECT conv_id, turn, turn * 10 + i AS pos,
               CASE i WHEN 0 THEN {_LPAD8.format('conv_id')} WHEN 1 THEN {_LPAD8.format('conv_id + turn')} WHEN 2 THEN NULL ELSE '' END AS expense_id,
               'vendor ' || (conv_id % 40) AS vendor, CASE WHEN i = 0 THEN CAST(conv_id AS DOUBLE) END AS amount,
               CASE WHEN i = 1 THEN '/custom/' || conv_id END AS link,
               CASE WHEN turn % 4 = 1 THEN 'sql' WHEN i = 0 THEN 'semantic' END AS src,
               CASE WHEN turn = 7 THEN 'timeout' END AS error
        FROM (SELECT conv_id, turn, unnest(range(0, turn % 3 + 2)) AS i FROM conversations WHERE role = 'assistant') x""",
    "citations": """
        SELECT * FROM (SELECT conv_id, expense_id, pos, vendor, amount, coalesce(link, '/expenses/' || expense_id) AS link,
               coalesce(src, 'unknown') AS source, row_number() OVER (PARTITION BY conv_id, expense_id ORDER BY pos) AS rn
        FROM tool_rows WHERE coalesce(expense_id, '') <> '' AND error IS NULL) t WHERE rn = 1""",
    "chunks": f"""
        SELECT 'chk_' || doc_id AS chunk_id, 't_' || (doc_id % 5) AS tenant_id, {_LPAD8.format('doc_id')} AS expense_id, text AS chunk_text,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS approved_at
        FROM documents""",
    "embedding_log": """
        SELECT 'chk_' || vec_id AS chunk_id, 't_' || (vec_id % 5) AS tenant_id,
               CASE WHEN v = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(v) AS updated_at
        FROM (SELECT vec_id, embedding, unnest(CASE WHEN vec_id % 3 = 0 THEN [0, 1] ELSE [1] END) AS v FROM embeddings) x""",
    "latest_emb": """
        SELECT chunk_id, tenant_id, embedding, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, tenant_id ORDER BY updated_at DESC) AS rn
        FROM embedding_log) t WHERE rn = 1""",
    "questions": _questions(),
    "dense": """
        SELECT query_id, tenant_id, chunk_id, c, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS rank
        FROM (SELECT q.query_id, q.tenant_id, e.chunk_id, list_cosine_similarity(q.query_vec, CAST(e.embedding AS DOUBLE[])) AS c
              FROM latest_emb e JOIN questions q USING (tenant_id)) s""",
    "doc_tokens": r"""
        SELECT chunk_id, tenant_id, regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+') AS toks FROM chunks""",
    "query_terms": r"""
        SELECT query_id, tenant_id, unnest(list_distinct(regexp_extract_all(lower(query_text), '[\p{L}\p{N}]+'))) AS term FROM questions""",
    "bm25": """
        WITH n AS (SELECT tenant_id, count(*) AS docs, avg(len(toks)) AS avg_len FROM doc_tokens GROUP BY 1),
        tf AS (SELECT chunk_id, tenant_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, tenant_id, len(toks) AS dl, unnest(toks) AS term FROM doc_tokens) x
               WHERE (tenant_id, term) IN (SELECT tenant_id, term FROM query_terms) GROUP BY ALL),
        df AS (SELECT tenant_id, term, count(*) AS df FROM tf GROUP BY ALL),
        s AS (SELECT q.query_id, tf.tenant_id, tf.chunk_id,
                     round(sum(ln(1 + (n.docs - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.dl / n.avg_len))), 6) AS lexical_score
              FROM tf JOIN df USING (tenant_id, term) JOIN n USING (tenant_id) JOIN query_terms q USING (tenant_id, term) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS rank FROM s""",
}

_NAMES = re.compile(r"\b(" + "|".join(sorted(TABLES, key=len, reverse=True)) + r")\b")


def _needed(sql: str, found: list[str]) -> list[str]:
    code = re.sub(r"'[^']*'", "''", sql)
    for name in dict.fromkeys(_NAMES.findall(code)):
        if name not in found:
            _needed(TABLES[name], found)
            if name not in found:
                found.append(name)
    return found


def complete(sql: str) -> str:
    """``sql`` preceded by the derived tables it mentions."""
    sql = sql.replace(":orders_now", f"TIMESTAMP '{ORDERS_NOW}'").replace(":events_now", f"TIMESTAMP '{EVENTS_NOW}'")
    sql = sql.strip()
    names = _needed(sql, [])
    if not names:
        return sql
    body = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in names)
    if sql.upper().startswith("WITH "):
        return f"WITH {body},\n{sql[5:].strip()}"
    return f"WITH {body}\n{sql}"
