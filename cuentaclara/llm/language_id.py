"""Language identification with a string kernel: blended-spectrum presence of n-grams, Nyström landmarks, kernel ridge.

For texts x, z and n = 1..4 let P_n(x) be the set of byte n-grams of the lower-cased text, hashed to ``BUCKETS`` places.
The kernel is the mean over n of |P_n(x) & P_n(z)| / sqrt(|P_n(x)| |P_n(z)|). Landmarks are training texts; a text is
represented by its kernel values with them (Nyström), and one ridge regression per language, target +1 or -1, is solved
in that space. A batch of texts is scored by matrix products: presence (texts x buckets) times landmark presence gives
the kernel block, times coefficients the scores. As the kernel is linear in the presence of x, landmark presence and
coefficients are multiplied once, when the model is fitted.

Every value of lang is learned. The classifier is fitted on ``train_rows`` labelled rows shared equally by the languages, or
``LEAST_ROWS`` of each language where that is more: those with the smallest hash of (doc_id, text) within the language, so a
frequent one cannot push out the others. Model size depends on parameters and the number of languages only; that is what is
broadcast. With more languages than landmarks the product with the coefficients is taken per batch instead, so a
further language costs one number per landmark.

Defined results: ``und`` with score 0 where the text is null or holds no letter (Unicode category L), or where no
language could be learned. A null doc_id counts as held out (its remainder is null). Repeated rows are scored alike. Scores are the share
of the winning language in a softmax over the regression values, so they lie between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuentaclara.llm.common import own_columns, ship, slices, tidy

ship(__name__)

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BITS = 14
BUCKETS = 1 << BITS
SHARPNESS = 6.0
LETTER = r"\p{L}"
#: Rows of each language at least, however many languages share ``train_rows``.
LEAST_ROWS = 12


def held_out_remainder():
    """The fold of a document: crc32 of its identifier as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


_FOLD = np.arange(256, dtype="uint32")
_FOLD[65:91] += 32


def presence(texts: list[str | None]) -> np.ndarray:
    """texts x orders x BUCKETS, true where an n-gram of the text falls into the bucket."""
    out = np.zeros((len(texts), len(ORDERS), BUCKETS), dtype=bool)
    for i, text in enumerate(texts):
        # Pieces of one MB, so that a very long text needs no large arrays; they overlap by the longest n-gram.
        data = (text or "").lower().encode()
        for start in range(0, len(data), 1 << 20):
            codes = _FOLD[np.frombuffer(data[start:start + (1 << 20) + ORDERS[-1] - 1], dtype="uint8")]
            h = np.zeros(len(codes), dtype="uint32")
            for k, n in enumerate(ORDERS):
                if len(codes) < n:
                    break
                h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ codes[n - 1:]
                mixed = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                out[i, k, mixed] = True
    return out


def normalised(seen: np.ndarray) -> np.ndarray:
    """Presence over the square root of its size per order, blended: dot products of rows are kernel values."""
    size = np.maximum(seen.sum(axis=2, keepdims=True), 1)
    return (seen / np.sqrt(size * len(ORDERS))).reshape(len(seen), -1).astype("float32")


def sample_key():
    """A number in [0, 1) that depends on the row alone."""
    h = F.xxhash64(F.lit(11), "doc_id", F.xxhash64("text"))
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (orders * BUCKETS) x languages; with coefficients x landmarks
    bias: np.ndarray
    coefficients: np.ndarray | None = None  # landmarks x languages

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = normalised(presence(texts)) @ self.weights
        return (found if self.coefficients is None else found @ self.coefficients) + self.bias


def packed(texts: list[str | None]) -> np.ndarray:
    """The presence of each text as a row of bits: 8 KB, however long the text is."""
    return np.packbits(presence(texts).reshape(len(texts), -1), axis=1)


def fit(bits: np.ndarray, langs: list[str], landmarks: int, ridge: float, seed: int = 7) -> Model:
    """One-versus-rest kernel ridge regression on the Nyström features of the given rows of ``packed``."""
    languages = sorted(set(langs))
    order = np.random.default_rng(seed).permutation(len(bits))
    block = 32

    def rows(which) -> np.ndarray:
        return normalised(np.unpackbits(bits[which], axis=1).reshape(-1, len(ORDERS), BUCKETS).astype(bool))

    marks = np.concatenate([rows(order[at:min(at + block, landmarks)]) for at in range(0, min(landmarks, len(bits)), block)])
    gram = (marks @ marks.T).astype("float64")
    kernel = np.concatenate([rows(slice(i, i + block)) @ marks.T for i in range(0, len(bits), block)]).astype("float64")
    # Sums over all rows are taken once, from a common origin; each language adds those over its own rows.
    origin = kernel.mean(axis=0)
    kernel -= origin
    total, square = kernel.sum(axis=0), kernel.T @ kernel
    members: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        members.setdefault(lang, []).append(i)
    bias = np.zeros(len(languages))
    coefficients = np.zeros((len(marks), len(languages)))
    for c, lang in enumerate(languages):
        own = kernel[members[lang]]
        # A language's rows weigh as much as all others together.
        inside, outside = 0.5 / len(own), 0.5 / max(len(bits) - len(own), 1)
        weight = inside * len(own) + outside * (len(bits) - len(own))
        own_sum, own_square = own.sum(axis=0), own.T @ own
        center = inside * own_sum + outside * (total - own_sum)
        mean = inside * len(own) - outside * (len(bits) - len(own))
        # Weighted sums of (row - center)(row - center)' and (row - center)(target - mean).
        spread = inside * own_square + outside * (square - own_square) + (weight - 2) * np.outer(center, center)
        toward = inside * (1 - mean) * (own_sum - len(own) * center) - outside * (1 + mean) * (
            total - own_sum - (len(bits) - len(own)) * center)
        left = spread + ridge * gram / len(marks) + 1e-9 * np.eye(len(marks))
        coefficients[:, c] = np.linalg.solve(left, toward)
        bias[c] = mean - (center + origin) @ coefficients[:, c]
    small, bias = coefficients.astype("float32"), bias.astype("float32")
    if len(languages) > len(marks):
        return Model(languages, marks.T, bias, small)
    return Model(languages, marks.T @ small, bias)


def train(docs: DataFrame, train_rows: int, landmarks: int, ridge: float) -> Model | None:
    """Fit on a bounded sample of the labelled rows of every language outside the held-out fold."""
    labelled = own_columns(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (held_out_remainder() != 2))
    pick = sample_key()
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = max(1, train_rows // len(counts), min(LEAST_ROWS, train_rows))
    # The hash is uniform: rows below this limit are a few more than needed, whatever the size of the input.
    limits = [(lang, min(1.0, (share + 6 * share**0.5 + 20) / n)) for lang, n in counts.items()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below double"))
    sample = labelled.withColumn("pick", pick).join(wanted, "lang").where("pick < below").select("lang", "text", "pick")

    def reduce(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for start, stop in slices(batch, 1 << 18):
                part = batch.slice(start, stop - start)
                for at in range(0, part.num_rows, 64):
                    few = part.slice(at, 64)
                    bits = pa.array([row.tobytes() for row in packed(few.column("text").to_pylist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([few.column("lang"), few.column("pick"), bits], names=["lang", "pick", "bits"])

    # The driver gets bits of a fixed size per row, never texts.
    by_lang: dict[str, list] = {}
    for row in sample.mapInArrow(tidy(reduce), "lang string, pick double, bits binary").collect():
        by_lang.setdefault(row["lang"], []).append((row["pick"], bytes(row["bits"])))
    rows = [(lang, bits) for lang, found in sorted(by_lang.items()) for _, bits in sorted(found)[:share]]
    bits = np.frombuffer(b"".join(b for _, b in rows), dtype="uint8").reshape(len(rows), -1)
    return fit(bits, [lang for lang, _ in rows], landmarks, ridge)


def classify(docs: DataFrame, train_rows: int = 2400, landmarks: int = 300, ridge: float = 1e-3, whole_rows: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; with ``whole_rows`` also ``row``, a struct of all its columns."""
    return predicted(docs, train(docs, train_rows, landmarks, ridge), whole_rows)


def predicted(docs: DataFrame, model: Model | None, whole_rows: bool = False) -> DataFrame:
    """The columns of ``classify`` by a fitted model, or by none."""
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    base = own_columns(docs, *docs.columns).select(
        "doc_id", F.coalesce(held_out_remainder() == 2, F.lit(True)).alias("held_out"), "text",
        F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter"), *whole)
    carried = ["doc_id", "held_out", *["row"] * whole_rows]
    if model is None:
        return base.select(*carried, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias, model.coefficients))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Model(*shared.value)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            letters = batch.column("has_letter").to_pylist()
            for start, stop in slices(batch, limit=64 << 10):
                part = batch.column("text").slice(start, stop - start).to_pylist()
                for at in range(0, len(part), 64):
                    raw = own.scores(part[at: at + 64])
                    share = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
                    share = share.max(axis=1) / share.sum(axis=1)
                    for i, best in enumerate(raw.argmax(axis=1)):
                        known = letters[start + at + i]
                        langs.append(own.languages[best] if known else UNKNOWN)
                        scores.append(float(share[i]) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in carried] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*carried, "lang_pred", "score"])

    schema = T.StructType(base.select(*carried).schema.fields + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(tidy(run), schema)


def identified_rows(docs: DataFrame, train_rows: int = 2400, landmarks: int = 300, ridge: float = 1e-3) -> DataFrame:
    """``docs`` with all its columns, without the rows whose language is unknown (null text, or no letter in it); a null
    ``lang`` becomes the predicted language.

    With a model only ``und`` is rejected, and no text with a letter is: ``und`` as a label is not learned here. A given
    lang is kept, also where the prediction differs. Where no language can be learned, every text with a letter stays as it is.
    """
    model = train(docs.where(F.col("`lang`") != UNKNOWN), train_rows, landmarks, ridge)
    if model is None:
        return docs.where(F.col("`text`").rlike(LETTER))
    kept = predicted(docs, model, whole_rows=True).where(F.col("lang_pred") != UNKNOWN)
    kind = docs.schema["lang"].dataType

    def column(name: str) -> Column:
        own = F.col("row")[name]
        return (F.coalesce(own, F.col("lang_pred").cast(kind)) if name == "lang" else own).alias(name)

    return kept.select(*[column(c) for c in docs.columns])
