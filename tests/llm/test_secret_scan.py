"""Base spans against plain regular expressions, the network against numeric gradients and held-out findings."""

import hashlib
import re

import numpy as np
import pytest

from cuentaclara.llm import secret_scan
from cuentaclara.llm.char_cnn import Calibration, CharCNN, sigmoid

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


@pytest.fixture(scope="module")
def model():
    return secret_scan.train(*secret_scan.windows_of(secret_scan.made_findings(2400)), epochs=8)


def compare(df, model):
    given = df.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, [sum(s.startswith(k) for s in base(r.text)) for k in PATTERNS], hashlib.sha256(",".join(base(r.text)).encode()).hexdigest())) for r in given)
    rows = secret_scan.summary(df, model).collect()
    assert sorted(str((r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256)) for r in rows) == want
    by_text = {r.doc_id: base(r.text) for r in given}
    for r in rows:
        spans = r.spans.split(",") if r.spans else []
        if list(by_text).count(r.doc_id) == 1 and r.doc_id is not None and len([g for g in given if g.doc_id == r.doc_id]) == 1:
            assert [s for s in spans if not s.startswith("model")] == by_text[r.doc_id]
        keys = [(int(s.split(":")[1]), secret_scan.KINDS.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys) and 0 <= r.best_score <= 1


def test_base_spans_of_random_texts(spark, model):
    rng = np.random.default_rng(8)
    parts = ["password", "PassWD", "toKen", "secret", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc123", "/x.y-z", "AKIA", "ABCDEFGH01234567",
             "0123456789abcdef", "deadbeef", "é", "日", "\U0001f600", "\n", "\x00", "g", "AK"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(1500)] + [None, "", "token=" * 500, "AKIA" * 30, "a" * 100_000, "passwd" + " " * 50_000 + "=x"]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)


def test_odd_rows_and_documents(spark, model, odd, nothing, documents):
    compare(odd, model)
    compare(documents, model)
    assert secret_scan.summary(nothing, model).count() == 0


def test_long_texts_are_scanned_to_the_end(spark, model):
    key = "Zk3vQ9xL0pT7wB2mN8sR4yU6"
    text = "é wörd " * 300_000 + f"bearer {key} end"
    rows = secret_scan.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(s.kind, text[s.start:s.end]) for s in rows[0].spans] == [("model", key)]


def test_a_model_learns_from_the_corpus_and_keeps_its_recall(documents):
    own, own_labels = secret_scan.corpus_findings(documents, 20_000, 500)
    made, labels = secret_scan.windows_of(secret_scan.made_findings(2400))
    windows, y = np.concatenate([own, made]), np.concatenate([own_labels, labels])
    assert len(own) and set(own_labels.tolist()) <= {0.0, 1.0}
    found = secret_scan.train(windows, y, recall=0.97)
    rest = secret_scan.held_out(windows)
    hits = found.probabilities(windows[rest]) >= found.threshold
    assert hits[y[rest] > 0].mean() >= 0.97 and hits[y[rest] == 0].mean() < 0.05
    fresh, fresh_y = secret_scan.windows_of(secret_scan.made_findings(600, seed=77))
    p = found.probabilities(fresh)
    assert ((p >= found.threshold) == (fresh_y > 0)).mean() > 0.93 and ((p - fresh_y) ** 2).mean() < 0.05


def test_nothing_to_learn_from_in_the_corpus(nothing):
    model = secret_scan.fitted(nothing, findings=200)
    assert 0 < model.threshold < 1
    assert len(model.probabilities(secret_scan.windows_of([])[0])) == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    rows, labels = rng.integers(0, 256, (6, 20)).astype("uint8"), np.array([0, 1, 1, 0, 1, 0], "float32")
    net = CharCNN(20, seed=3)
    net.params = {k: v.astype("float64") for k, v in net.params.items()}

    def loss():
        x = net.logits(rows).astype("float64")
        return -(labels * np.log(sigmoid(x)) + (1 - labels) * np.log(1 - sigmoid(x))).mean()

    for name, grad in net.gradients(rows, labels).items():
        flat, given = net.params[name].reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(given))[:4]:
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - given[i]) < 1e-4


@pytest.mark.parametrize("recall", [0.5, 0.9, 1.0])
def test_the_threshold_is_the_highest_that_keeps_the_recall(recall):
    rng = np.random.default_rng(2)
    labels = (rng.random(400) < 0.4).astype("float32")
    logits = (labels * 2 + rng.standard_normal(400)).astype("float32")
    c = Calibration.fit(logits, labels, recall)
    p = c.probability(logits)
    assert (p[labels > 0] >= c.threshold).mean() >= recall
    assert (p[labels > 0] > c.threshold).mean() < recall or recall == 0
    assert abs(p.mean() - labels.mean()) < 0.02
