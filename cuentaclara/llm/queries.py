"""The registered queries of this package, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.llm import (
    conversations,
    cover_tree,
    exact_dedup,
    fill_in_middle,
    jaccard_join,
    language_id,
    licenses,
    mixing,
    pii,
    quality,
    secret_scan,
    sentence_pieces,
    warc,
)
from cuentaclara.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op1_cover_tree", """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
    finite AS (
        SELECT * FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND isfinite(list_sum(e))),
    ok AS (
        SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM finite),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
    FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
    JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = e.vec_id""")
def _(spark, sf_dir):
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_warc")
def _(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_pii")
def _(spark, sf_dir):
    return pii.summary(table(spark, sf_dir, "documents"))


@query("op4_licenses")
def _(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op5_mixing", r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
               CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
        FROM documents),
    s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
        FROM d GROUP BY source),
    fill AS (
        SELECT 0 AS step, source, source_size, CAST(weight AS DOUBLE) AS weight, CAST(0 AS DOUBLE) AS target, false AS clamped FROM s
        UNION ALL
        SELECT step + 1, source, source_size, weight,
               CASE WHEN clamped THEN target ELSE least(2.0 * source_size, share) END,
               clamped OR share >= 2.0 * source_size
        FROM (SELECT *, weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN clamped THEN target ELSE 0 END) OVER ())
                        / nullif(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER (), 0) AS share FROM fill) f
        WHERE step < 40)
    SELECT doc_id, size, source_size, round(target, 6) AS target,
           CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
    FROM (
        SELECT d.doc_id, d.size, f.source_size, f.target, floor(f.target / nullif(f.source_size, 0)) AS whole,
               round(f.target - floor(f.target / nullif(f.source_size, 0)) * f.source_size) AS rest,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN (SELECT * FROM fill WHERE step = 40) f ON d.source IS NOT DISTINCT FROM f.source) t""")
def _(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op6_jaccard_join")
def _(spark, sf_dir):
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op7_exact_dedup", r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
           sha256(body) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents) t
    WINDOW g AS (PARTITION BY body)""")
def _(spark, sf_dir):
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op8_sentence_pieces")
def _(spark, sf_dir):
    return sentence_pieces.encode(
        table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op9_quality")
def _(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_language_id")
def _(spark, sf_dir):
    return language_id.classify(table(spark, sf_dir, "documents"))


@query("op11_fill_in_middle", r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
               sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    k AS (
        SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                         OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
                    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
    c AS (
        SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
               array_to_string(u[greatest(a, b) + 1:], '') AS s FROM k)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM c""")
def _(spark, sf_dir):
    return fill_in_middle.transform(
        table(spark, sf_dir, "documents"),
        outputs=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"))


@query("op12_secret_scan")
def _(spark, sf_dir):
    return secret_scan.summary(table(spark, sf_dir, "documents"))


@query("op13_conversation_repair", r"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    poly AS (
        SELECT i, i AS v, 0 AS step FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)) b
        UNION ALL
        SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM poly WHERE step < 8),
    crc AS (
        SELECT DISTINCT k, 0 AS done, CAST(4294967295 AS BIGINT) AS c FROM keyed
        UNION ALL
        SELECT k, done + 1, xor(c >> 8, p.v) FROM crc JOIN (SELECT i, v FROM poly WHERE step = 8) p
            ON p.i = xor(c & 255, CAST(ascii(substr(k, done + 1, 1)) AS BIGINT)) WHERE done < length(k)),
    hit AS (SELECT x.*, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS h FROM keyed x JOIN crc ON x.k = crc.k AND done = length(x.k)),
    turns AS (
        SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM turns),
    faults AS (
        SELECT conv_id, turn, role, text, pos, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS b,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faults GROUP BY conv_id),
    steps(state, role, goal) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
    keeps(c, state, goal) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
    ins(state, goal, letters, more, price) AS (
        SELECT state, state, '', '', 0 FROM steps
        UNION ALL SELECT state, goal, 'I', chr(10) || role || ':', 2 FROM steps
        UNION ALL SELECT a.state, b.goal, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':', 4 FROM steps a JOIN steps b ON b.state = a.goal),
    dp AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS pos, ins.goal AS state, price AS cost, letters AS audit, more AS body FROM counts, ins WHERE ins.state = 0
        UNION ALL
        SELECT conv_id, pos, state, cost, audit, body FROM (
            SELECT e.conv_id, e.pos, ins.goal AS state, e.cost + price AS cost, e.audit || letters AS audit, e.body || more AS body,
                   row_number() OVER (PARTITION BY e.conv_id, ins.goal ORDER BY e.cost + price, e.audit || letters) AS best
            FROM (
                SELECT d.conv_id, f.pos, d.state, d.cost + 3 AS cost, d.audit || 'D' AS audit, d.body
                FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
                UNION ALL
                SELECT d.conv_id, f.pos, k.goal, d.cost + CASE WHEN fault IS NULL THEN 0 ELSE 1 END, d.audit || 'K', d.body || chr(10) || f.role || ':' || f.text
                FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
                JOIN keeps k ON k.c = f.c AND k.state = d.state WHERE fault IS NULL OR fault = 'truncated'
                UNION ALL
                SELECT d.conv_id, f.pos, s.goal, d.cost + 2 + CASE WHEN fault IS NULL THEN 0 ELSE 1 END, d.audit || 'R', d.body || chr(10) || s.role || ':' || f.text
                FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos + 1
                JOIN steps s ON s.state = d.state WHERE fault IS NULL OR fault = 'truncated') e
            JOIN ins ON ins.state = e.state) t
        WHERE best = 1),
    ended AS (
        SELECT d.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, d.cost, d.audit, substr(d.body, 2) AS body,
               row_number() OVER (PARTITION BY d.conv_id ORDER BY d.cost, d.audit) AS best
        FROM dp d JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.pos WHERE d.state IN (0, 3))
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (SELECT * FROM ended WHERE best = 1) e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(rows), rows)
