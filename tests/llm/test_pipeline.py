"""The pipeline against brute force, and the registered queries against their SQL."""

import hashlib
import re

import pytest

import __spark_entry__
import corpus_pipeline
from cuentaclara.llm import sentence_pieces
from cuentaclara.llm.common import written
from cuentaclara.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm.test_pairs import exact_expected, jaccard_expected
from tests.llm.test_texts import mix_expected


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir) == ""


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_stages(spark, request, sf_dir, table):
    import sentencepiece

    docs = written(request.getfixturevalue(table), "pipeline-test")
    columns, counts = docs.columns, [docs.count()]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    # Brute force of the same decisions.
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    expected = [len(rows)]
    texts = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    rows = list(texts.values())
    expected.append(len(rows))
    assert len({c for _, c, _ in exact_expected([r[:2] for r in rows])}) <= len(rows)
    classes = jaccard_expected([r[:2] for r in rows])
    keep = {c for _, _, c in classes}
    rows = [r for r in rows if (r[0] is None, r[0] or 0) in keep]
    expected.append(len(rows))
    words = sum(round(t) for t in mix_expected(rows)[2].values())
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-test")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "mixing sources":
            mixed = docs.select("doc_id", "text").collect()
    assert counts[1:4] == expected
    assert abs(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed) - words) <= len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    want = sorted(hashlib.sha256(",".join(map(str, sp.encode(r.text))).encode()).hexdigest() for r in mixed)
    assert sorted(r.ids_sha256 for r in docs.collect()) == want


def test_near_copies_of_the_stage_are_those_of_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]
    # 100 of 120 shingles of five words are shared (0.83); those of four: 101 of 121 (0.835); the third text shares too few.
    texts = [base, base + [f"x{i}" for i in range(20)], base[:60] + [f"y{i}" for i in range(44)]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
