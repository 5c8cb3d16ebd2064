"""Spans, licenses, pieces, archives, mixtures and classifiers against plain Python, the library, or held-out rows."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuentaclara.llm import language_id, licenses, mixing, pii, quality, sentence_pieces, warc

# --- personal data ----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub(r"\D", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def test_personal_data(spark):
    rng = np.random.default_rng(2)
    parts = ["a", "b@", "@c", ".d", "_", "x.y@z.w", ".", "-", " ", "1", "23", "4111111111111111", "4012 8888 8888 1881", "+1 (22", "33) 44-5566", "255.1.2.3",
             "256.", "7.8.9.10.11.12", "00000000001.2.3.4", "é", "日", "\n", "\U0001f600", "+", "card"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(400)] + [None, "", "a@b." * 900, "1 " * 900, "a@b.c " * 900, "1." * 900]
    got = {r.doc_id: r for r in pii.summary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = got[i]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and row.spans.startswith(joined)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == s[0] for s in spans) for k in BASE]


def test_checksums_and_context_decide_further_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "amex card 378282246310005", "n 378282246310005", "ssn 123-45-6789", "123-45-6789"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in rows] == [["iban"], [], ["card_short"], [], ["ssn"], []]


def test_very_long_runs_and_odd_rows(spark, odd, nothing):
    long = spark.createDataFrame([(1, "a" * 300_000 + "@"), (2, "1" * 200_000), (3, "+1 " + "2 " * 100_000)], "doc_id long, text string")
    assert [r.spans for r in pii.summary(long).collect()] == [""] * 3
    assert pii.summary(odd).count() == odd.count() and pii.summary(nothing).count() == 0


# --- licenses ---------------------------------------------------------------------------------


def license_expected(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i:i + len(wanted)] == wanted:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, odd, nothing):
    rng = np.random.default_rng(4)
    parts = ["CC", "BY", "cc by", "general", "public", "license", "all rights", "reserved", "é", "x", "-", "General Public License"]
    notice, other = list(licenses.NOTICES)[:2]
    words = other.split()
    texts = [" ".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(300)] + [
        None, "", notice + ". foo", " ".join(words[:6] + ["inserted"] + words[6:]), " ".join(words[:4]), "cc by " * 3000]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == license_expected(text)
        assert 0 <= row.score <= 1
    assert [got[len(texts) - k].labels for k in (4, 3, 2)] == ["mit", "apache-2.0", ""]
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(nothing).count() == 0


def test_a_repeated_phrase_is_no_notice(spark):
    bsd = next(n for n, label in licenses.NOTICES.items() if label == "bsd")
    texts = ["following conditions are met " * 6, "conditions are met following " * 40, bsd + " " + "x " * 30 + "conditions are met " * 5, bsd.replace("forms", "shapes")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["", "", "bsd", "bsd"] and 0 < rows[3].score < 1 and rows[2].score == 1


# --- pieces -----------------------------------------------------------------------------------


def test_pieces_are_those_of_the_library(spark, odd, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    rng = np.random.default_rng(1)
    parts = [" ", " ", "▁", "a", "th", "é", "\n", "<s>", "日", "\U0001f600", "1", "\t", "  ", "▁▁", "\x00"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(500)]
    df = odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).unionByName(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    given = [(r.doc_id, r.text) for r in df.collect()]
    encoded = sentence_pieces.encode(df, outputs=("n_tokens", "ids", "decoded", "ids_sha256"))
    want = sorted((i or -1, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in given)
    rows = encoded.collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in rows) == [(i, tuple(ids), d) for i, ids, d in want]
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in rows)
    assert sorted((r.decoded for r in sentence_pieces.decode(encoded).collect())) == sorted(r.decoded for r in rows)


def test_no_texts_and_small_slices(spark, nothing, documents, monkeypatch):
    assert sentence_pieces.encode(nothing).count() == 0
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    whole = sorted(map(str, sentence_pieces.encode(documents, outputs=outputs).collect()))
    monkeypatch.setattr(sentence_pieces, "TABLE_BYTES", 20_000)
    monkeypatch.setattr(sentence_pieces, "slices", lambda batch, limit: ((i, min(i + 3, batch.num_rows)) for i in range(0, batch.num_rows, 3)))
    assert sorted(map(str, sentence_pieces.encode(documents, outputs=outputs).collect())) == whole


def test_a_full_table_changes_nothing(monkeypatch):
    table = sentence_pieces.Chunks(sentence_pieces.default_model())
    texts = ["one two three", "two three four", "three  four", "z" * 2000]
    whole = list(sentence_pieces.encode_texts(table, texts))
    monkeypatch.setattr(sentence_pieces, "TABLE_CHUNKS", 1)
    assert [next(sentence_pieces.encode_texts(table, [t])) for t in texts] == whole


# --- archives ---------------------------------------------------------------------------------

PAGES = [
    (1, "http://a", "x"), (2, "http://b", "x"), (2, "http://b", "x"), (3, None, None), (4, "u v\n", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"),
    (None, "n", "x"), (None, "n2", "é日"), (7, "q", ""), (9, "z", "\r\n\r\n\r\n"), (10, "long", "y" * 300_000)]


def test_archives_and_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.round_trip(pages).collect()
    want = []
    for page_id, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        data = (html or "").encode()
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page_id == first else "revisit",
                     None if page_id == first else first))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    import gzip

    lengths = [10] * 30 + [20_000] * 30 + [500_000] * 9 + [3 << 20]
    rows = [(i, f"http://a/{i}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(lengths)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.archive(pages, str(tmp_path / "w"), file_bytes=2 << 20)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert sorted(sizes)[-2] <= 2 << 20 < max(sizes) < (3 << 20) + 8192 and len(sizes) >= 6
    assert warc.read_records(spark, str(tmp_path / "w")).where("type = 'response'").count() == len(rows)


def test_captures_join_records_either_way(spark):
    def record(name, kind, *others):
        return (name, kind, "t", "d", list(others), None, None, 0, {}, None)

    rows = [record("r1", "response"), record("q1", "request", "r1"), record("m1", "metadata", "q1"), record("r2", "response", "q2"),
            record("q2", "request"), record("m9", "metadata", "lost"), record("r3", "revisit")]
    got = {r.record_id: ([x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []])
           for r in warc.captures(spark.createDataFrame(rows, warc.RECORDS)).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], []), "r3": ([], [])}


def test_one_gzip_member_per_record_is_read(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(head % (i, len(body)) + body + b"\r\n\r\n") for i in range(3)))
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert [(r.record_id, bytes(r.payload), r.payload_bytes) for r in rows] == [(f"<urn:{i}>", b"hello", 5) for i in range(3)]


def test_a_wrong_digest_or_a_cut_record_is_an_error(spark, tmp_path):
    text = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200\r\n\r\nhello\r\n\r\n"
    (tmp_path / "bad.warc").write_bytes(text)
    with pytest.raises(Exception, match="digest"):
        warc.read_records(spark, str(tmp_path)).collect()


# --- mixtures ---------------------------------------------------------------------------------


def mix_expected(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in above} if above else share
        open_ -= above or open_
    return size, total, target


def test_mixture(odd, nothing, documents):
    for df in (odd, documents):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        size, total, target = mix_expected(rows)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size)
        taken = {}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size and r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
            taken[r.source] = taken.get(r.source, 0) + r.taken
        assert all(abs(taken[s] - target[s]) <= 1 for s in total)
        again = mixing.mix(df.repartition(3)).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
        words = mixing.mixed_rows(df).select(mixing.size_in_words(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
        assert words == sum(taken.values())
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


# --- classifiers ------------------------------------------------------------------------------


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.classify(docs, train_rows=800, landmarks=150).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.97
    found = language_id.classify(odd, train_rows=100, landmarks=20).collect()
    texts = [r.text for r in odd.collect()]
    assert len(found) == len(texts) and sum(r.lang_pred == "und" for r in found) == sum(not re.search(r"[^\W\d_]", t or "") for t in texts)
    assert language_id.classify(nothing).count() == 0
    assert language_id.identified_rows(odd).columns == odd.columns


def test_the_fit_is_a_plain_kernel_ridge_regression():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list(a), int(rng.integers(2, 60)))) for a in ("abcde ", "cdefg ", "éßüab ") for _ in range(30)]
    langs = [lang for lang in ("x", "y", "z") for _ in range(30)]
    model = language_id.fit(language_id.packed(texts), langs, landmarks=20, ridge=1e-2)

    def grams(text):  # the kernel by sets of Python integers
        data, found = text.lower().encode(), []
        for n in language_id.ORDERS:
            places = set()
            for i in range(len(data) - n + 1):
                h = 0
                for byte in data[i:i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ byte
                places.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language_id.BITS))
            found.append(places)
        return found

    def kernel(a, b):
        return sum(len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for x, y in zip(a, b, strict=True)) / len(language_id.ORDERS)

    sets = [grams(t) for t in texts]
    marks = [sets[i] for i in np.random.default_rng(7).permutation(len(texts))[:20]]
    features = np.array([[kernel(s, m) for m in marks] for s in sets])
    gram = np.array([[kernel(a, b) for b in marks] for a in marks])
    fresh = ["abc de", "gfe dc", "ßü éa", "", "zzz"]
    rows = np.array([[kernel(grams(t), m) for m in marks] for t in fresh])
    for c, lang in enumerate(("x", "y", "z")):
        own = np.array([x == lang for x in langs])
        target, weight = np.where(own, 1.0, -1.0), np.where(own, 0.5 / own.sum(), 0.5 / (~own).sum())
        center, mean = weight @ features, weight @ target
        x = features - center
        w = np.linalg.solve((x * weight[:, None]).T @ x + 1e-2 * gram / 20 + 1e-9 * np.eye(20), (x * weight[:, None]).T @ (target - mean))
        assert np.allclose(model.scores(fresh)[:, c], (rows - center) @ w + mean, atol=2e-3)


def test_a_missing_language_is_filled(documents):
    given = documents.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    rows = {r.doc_id: r.lang for r in language_id.identified_rows(given, train_rows=400, landmarks=100).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect() if r.doc_id in rows}
    assert all(rows[i] == truth[i] for i in rows if i % 5) and None not in rows.values()
    filled = [i for i in rows if i % 5 == 0]
    assert len(filled) > 20 and np.mean([rows[i] == truth[i] for i in filled]) > 0.9


@pytest.mark.parametrize("lang", [None, "und"])
def test_without_a_language_to_learn_texts_with_letters_stay(odd, lang):
    bare = odd.withColumn("lang", F.lit(lang).cast("string"))
    want = sorted(r.text for r in odd.collect() if re.search(r"[^\W\d_]", r.text or ""))
    kept = language_id.identified_rows(bare)
    assert kept.columns == odd.columns and sorted(r.text for r in kept.collect()) == want


def test_every_language_is_learned(spark):
    rng, rows = np.random.default_rng(3), []
    for lang in range(230):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 4)) for _ in range(12)]
        rows += [(len(rows) + k, " ".join(rng.choice(words, 25)), f"l{lang:03}") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for landmarks in (300, 150):  # 150: fewer landmarks than languages
        found = language_id.classify(docs, landmarks=landmarks).join(docs, "doc_id").collect()
        assert len({r.lang_pred for r in found}) == 230
        assert np.mean([r.lang_pred == r.lang for r in found if r.held_out]) > 0.95


def test_quality(spark, odd, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.9
    assert quality.score(odd, labels).count() == odd.count()
    assert {r.score for r in quality.score(odd, labels.where("false")).collect()} == {0.5}
    assert quality.score(nothing, labels).count() == 0
