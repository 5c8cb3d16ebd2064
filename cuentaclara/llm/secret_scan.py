"""Secret scan: patterns propose candidates, a character convolutional network scores each one with its surroundings.

Candidates are the base kinds (assign, access, hex) and every run of ``RUN`` or more token characters that meets none of
them. Each becomes a window of fixed width: the characters before, the head and tail of the value, the characters after.
The network is trained on labelled findings: a bounded sample of the corpus, labelled by rule, and made ones in many
formats (``made_findings``); callers may give their own. A third of the findings is held out for the calibration of
probabilities and for the threshold, the highest one that finds ``recall`` of the held-out secrets.

Base spans stay whatever their score. A further candidate whose probability reaches the threshold becomes a span of kind
"model".

Candidates come from one linear pass over the bytes of a text; patterns run only where one of their words occurs.

Defined results: a null or empty text has no spans. Bytes beyond ASCII are no part of any candidate and stand as one
symbol in windows. Every row gives one row, also repeated ones. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.llm.char_cnn import Calibration, CharCNN
from cuentaclara.llm.common import own_columns, ship, slices

ship(__name__)

#: Kinds in the order of the result.
KINDS = ("assign", "access", "hex", "model")
#: The base patterns and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
RUN = 16

BEFORE, HEAD, TAIL, AFTER = 32, 28, 12, 16
WIDTH = BEFORE + HEAD + TAIL + AFTER
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_TOKEN = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"))
_SYMBOL = np.where(np.arange(256) < 128, np.maximum(np.arange(256), 2), 1).astype("uint8")


@dataclass(frozen=True)
class Candidate:
    """Byte places of the span and, inside it, of the value that is scored."""

    kind: str
    start: int
    end: int
    value: tuple[int, int]


def runs(members: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the maximal runs of true that are long enough."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], members, [False]]).view("int8")))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def candidates(text: bytes) -> list[Candidate]:
    """Base spans and further runs, by start, then kind as listed."""
    if not text:
        return []
    data = np.frombuffer(text, dtype="uint8")
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [Candidate("assign", *m.span(), m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [Candidate("access", *m.span(), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Candidate("hex", a, b, (a, b)) for a, b in runs(_HEX[data], HEX_LEAST)]
    long = runs(_TOKEN[data], RUN)
    if long:
        base = sorted((c.start, c.end) for c in found)
        for a, b in long:
            if not any(x < b and a < y for x, y in base):
                found.append(Candidate("model", a, b, (a, b)))
    return sorted(found, key=lambda c: (c.start, KINDS.index(c.kind)))


def window(text: bytes, value: tuple[int, int]) -> bytes:
    """WIDTH symbols: 0 where there is no character, 1 beyond ASCII; in the value 128 is added."""
    start, end = value
    out = np.zeros(WIDTH, dtype="uint8")

    def put(at: int, part: bytes, mark: int = 0) -> None:
        out[at: at + len(part)] = _SYMBOL[np.frombuffer(part, dtype="uint8")] + mark

    before = text[max(0, start - BEFORE): start]
    put(BEFORE - len(before), before)
    inner = text[start: end] if end - start <= HEAD + TAIL else text[start: start + HEAD] + text[end - TAIL: end]
    put(BEFORE, inner, 128)
    put(BEFORE + HEAD + TAIL, text[end: end + AFTER])
    return out.tobytes()


# --- labelled findings ------------------------------------------------------------------------


def rule_label(text: bytes, c: Candidate) -> int | None:
    """What is certain without a model: base values of letters and digits are secrets; addresses, plain words and plain
    numbers are none. None where it is open."""
    value = text[c.value[0]: c.value[1]]
    letters, digits = re.search(rb"[A-Za-z]", value), re.search(rb"[0-9]", value)
    if c.kind != "model":
        return 1 if letters and digits and len(value) >= 12 else None
    if not digits or not letters:
        return 0
    around = text[max(0, c.start - 1): c.start] + text[c.end: c.end + 1]
    return 0 if b"@" in around else None


_WORDS = "the of and report order data user value main index page total config service client number model update north river paper light green".split()
_KEYS = "password passwd secret token api_key apikey pwd credential client_secret access_token auth private_key db_pass signing_key SECRET_KEY".split()
_ONSETS = ["b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "th", "ch", "tr", "pl", ""]
_ENDS = ["", "", "", "n", "r", "s", "l", "t", "ng"]
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_findings(n: int, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """``n`` rows (text, start, end, label): secrets in usual formats, and strings that only look alike."""
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def chars(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(alphabet), int(rng.integers(low, high + 1))))

    def word() -> str:
        if rng.random() < 0.3:
            return pick(_WORDS)
        return "".join(pick(_ONSETS) + pick("aeiou") + pick(_ENDS) for _ in range(int(rng.integers(1, 4))))

    def filler(count: int) -> str:
        return " ".join(word() for _ in range(int(rng.integers(0, count))))

    def secret() -> str:
        return pick((
            lambda: chars(_ALNUM, 16, 40), lambda: chars(_ALNUM + "+/", 24, 64) + pick(("", "=", "==")), lambda: chars("0123456789abcdef", 16, 64),
            lambda: pick(("ghp_", "xoxb-", "sk_live_", "glpat-", "AIza")) + chars(_ALNUM, 20, 40), lambda: "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16),
            lambda: "eyJ" + chars(_ALNUM, 16, 30) + "." + chars(_ALNUM + "_-", 20, 40), lambda: chars(_ALNUM + "_.-", 16, 28)))()

    def harmless() -> str:
        return pick((
            lambda: "-".join(word() for _ in range(5)), lambda: "_".join(word() for _ in range(4)), lambda: "/".join(["", *(word() for _ in range(4))]) + ".html",
            lambda: ".".join(word() for _ in range(4)), lambda: "".join(word().capitalize() for _ in range(4)), lambda: chars("0123456789", 16, 19),
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}.{rng.integers(0, 60):02d}",
            lambda: word() + str(rng.integers(0, 99)) + ".example.com/" + word() + "/" + word(), lambda: pick("x-=_.0") * int(rng.integers(16, 40)),
            lambda: "your-" + pick(_KEYS).replace("_", "-").lower() + "-here", lambda: word() * 4, lambda: "v" + ".".join(str(rng.integers(0, 99)) for _ in range(3)) + "-" + word() + "-" + word()))()

    rows = []
    for i in range(n):
        label = i % 2
        value = secret() if label else harmless()
        if not label and rng.random() < 0.2:
            value = value.upper()
        while len(value) < RUN:
            value += word()
        key = pick(_KEYS)
        frame = pick((f"{key} = \"", f"{key}: ", f"\"{key}\": \"", f"export {key.upper()}=", "Authorization: Bearer ", f"{word()} ", f"{word()}: ", "(", "'", ""))
        left = (filler(8) + " " + frame) if rng.random() < 0.9 else frame
        right = pick(("\"", "'", "\n", " ", ".", ")", "")) + " " + filler(5)
        rows.append((left + value + right, len(left), len(left) + len(value), label))
    return rows


def windows_of(findings: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of findings given as (text, start, end, label) with places in code points."""
    made = []
    for text, start, end, _ in findings:
        a, value = len(text[:start].encode()), text[start:end].encode()
        made.append(window(text.encode(), (a, a + len(value))))
    return _rows(made), np.array([f[3] for f in findings], dtype="float32")


def _rows(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), dtype="uint8").reshape(-1, WIDTH)


def corpus_findings(docs: DataFrame, sample_docs: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels by ``rule_label`` from about ``sample_docs`` documents, at most ``limit`` of each label.

    Equal windows count once; the ones with the smallest digests are taken, so reruns agree.
    """
    rows = own_columns(docs, "doc_id", "text")
    share = min(1.0, sample_docs / max(1, docs.count()))
    pick = F.shiftrightunsigned(F.xxhash64(F.lit(31), "doc_id"), 11) / F.lit(float(1 << 53))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, stop in slices(batch):
                made: dict[tuple[bytes, int], None] = {}
                for text in batch.column("text").slice(start, stop - start).to_pylist():
                    raw = (text or "").encode()
                    for c in candidates(raw):
                        label = rule_label(raw, c)
                        if label is not None:
                            made[window(raw, c.value), label] = None
                yield pa.RecordBatch.from_pydict({
                    "shape": pa.array([w for w, _ in made], pa.binary()), "label": pa.array([n for _, n in made], pa.int32())})

    found = rows.where(pick <= share).select("text").mapInArrow(run, "shape binary, label int").distinct()
    parts = [found.where(F.col("label") == n).orderBy(F.xxhash64("shape"), "shape").limit(limit).toArrow() for n in (0, 1)]
    windows = [w for t in parts for w in t.column("shape").to_pylist()]
    labels = [n for t in parts for n in t.column("label").to_pylist()]
    return _rows(windows), np.array(labels, dtype="float32")


# --- model ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    network: CharCNN
    calibration: Calibration

    @property
    def threshold(self) -> float:
        return self.calibration.threshold

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return self.calibration.probability(self.network.logits(windows))


def held_out(windows: np.ndarray) -> np.ndarray:
    """A third of the findings, by the digest of the window."""
    return np.array([hashlib.sha256(w.tobytes()).digest()[0] % 3 == 0 for w in windows], dtype=bool)


def train(windows: np.ndarray, labels: np.ndarray, recall: float = 0.98, epochs: int = 10) -> Model:
    """The network on two thirds of the findings, calibration and threshold on the other third."""
    rest = held_out(windows)
    network = CharCNN(WIDTH).fit(windows[~rest], labels[~rest], epochs=epochs)
    return Model(network, Calibration.fit(network.logits(windows[rest]), labels[rest], recall))


def fitted(docs: DataFrame, sample_docs: int = 20_000, findings: int = 2_000, recall: float = 0.98) -> Model:
    """A model from at most ``findings`` corpus findings of each label and as many made ones."""
    own, own_labels = corpus_findings(docs, sample_docs, findings)
    made, made_labels = windows_of(made_findings(2 * findings))
    return train(np.concatenate([own, made]), np.concatenate([own_labels, made_labels]), recall)


# --- scan -------------------------------------------------------------------------------------

SPAN = "struct<kind: string, start: long, end: long, score: double>"


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and ``spans``: an array of (kind, start, end, score) by start, then kind; places in code points, end exclusive."""
    rows = own_columns(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))  # its size is fixed by the layers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b, 4 << 20)):
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            found = [candidates(t) for t in texts]
            scores = iter(own.probabilities(_rows([window(t, c.value) for t, cs in zip(texts, found, strict=True) for c in cs])).tolist())
            out = []
            for text, own_found in zip(texts, found, strict=True):
                spans = []
                if own_found:
                    starts = (np.frombuffer(text, dtype="uint8") & 0xC0) != 0x80
                    points = np.concatenate([[0], np.cumsum(starts)])
                    for c, score in zip(own_found, scores, strict=False):
                        if c.kind != "model" or score >= own.threshold:
                            spans.append({"kind": c.kind, "start": int(points[c.start]), "end": int(points[c.end]), "score": score})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, spans array<{SPAN}>")


def summary(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and the best probability, one row per document."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return find(docs, model).select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.round(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), 6).alias("best_score"))
