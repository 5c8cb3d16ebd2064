"""The arranged texts against string slicing, and the exact way back."""

import hashlib
import re

import numpy as np
import pytest

from cuentaclara.llm import fill_in_middle as fim


def expected(doc_id, text, fim_percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    key = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df, **options):
    names = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")
    return fim.transform(df, outputs=names, **options).collect()


def check(rows, given, **options):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = [(i, *expected(i, t, **options), sha(expected(i, t, **options)[-1]), sha(t or "")) for i, t in given]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))


@pytest.mark.parametrize("percents", [(100, 50), (60, 0), (0, 50)])
def test_random_texts(spark, percents):
    rng = np.random.default_rng(6)
    parts = ["\n", "\n", "a", "é", "日本", "\U0001f600", "<", "P>", "S", "<M", ">", "<P>", "\r", "\x00", " "]
    given = [(i - 50, "".join(rng.choice(parts, int(rng.integers(0, 14)), p=[0.15] * 2 + [0.7 / 13] * 13))) for i in range(600)]
    options = dict(zip(("fim_percent", "spm_percent"), percents, strict=True))
    df = spark.createDataFrame(given, "doc_id long, text string")
    check(rows_of(df, **options), given, **options)


def test_odd_rows(spark, odd, nothing):
    check(rows_of(odd), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert rows_of(nothing) == []
    long = [(1, "line of a long text\n" * 200_000), (2, "z" * 3_000_000), (2, "\n" * 100_000)]
    check(rows_of(spark.createDataFrame(long, "doc_id long, text string")), long)


def test_originals_come_back_from_output_and_form(spark, documents):
    back = fim.originals(fim.transform(documents))
    given = sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
    assert sorted((r.doc_id, r.text) for r in back.collect()) == given


def test_pieces_share_the_text():
    text = "a\nbß\nc".encode()
    table = fim.PieceTable.of(text).cut(2, 2, 6)
    assert [bytes(p.view()) for p in table.pieces] == [b"a\n", b"", "bß\n".encode(), b"c"]
    assert all(p.buffer is text for p in table.pieces)
    parts = fim.PieceTable.of(text).cut(2, 6)
    for form in fim.ARRANGEMENTS:
        arranged = parts.arranged(form)
        assert sum(p.buffer is text for p in arranged.pieces) == 3
        assert arranged.restored(form).joined() == text == fim.restore(arranged.joined(), form).joined()
        assert arranged.sha256() == hashlib.sha256(arranged.joined()).hexdigest()
