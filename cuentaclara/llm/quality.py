"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are the shapes of its words (runs of lower case, upper case, digits and of each sign count as one
character), pairs of consecutive shapes, and marks for its length and for its share of signs. Counts are hashed to ``TERMS``
places, weighted by log(1 + tf) * idf with document frequencies over all documents, and projected on the leading singular
vectors of the labelled rows. The labelled vectors are broadcast; their number is bounded by ``train_rows``. Each batch
of documents is multiplied with all of them, block by block, and the ``neighbours`` most similar ones vote with
their label, weighted by a power of the similarity.

The labelled rows are those with the smallest hash of doc_id outside the held-out fold, half of each label. Language, source
and identifier are no input.

Defined results: null and empty texts are scored by their length mark alone. A document without any labelled row to
compare with gets 0.5. A null doc_id counts as held out. Rows repeated in full get equal scores. Labels repeated for a
document count once each; a null label is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuentaclara.llm.common import own_columns, ship, slices
from cuentaclara.llm.shingles import Shingler, mix

ship(__name__)

BITS = 10
TERMS = 1 << BITS
RANK = 48
POWER = 16
_CLASS = np.arange(256, dtype="uint8")
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[48:58] = 48
_CLASS[128:] = 97
_CLASS[0x09:0x0E] = 32
_WORDY = np.isin(_CLASS, [65, 97, 48, 32])


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def term_counts(texts: list[str | None], shapes: Shingler) -> np.ndarray:
    """texts x TERMS counts."""
    out = np.zeros((len(texts), TERMS), dtype="float32")
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), dtype="uint8")
        words = [np.zeros(0, dtype="uint64")]
        signs = 0
        for start in range(0, len(data), 1 << 20):  # pieces, so that a very long text needs no large arrays
            kinds = _CLASS[data[start: start + (1 << 20)]]
            signs += int((~_WORDY[kinds]).sum())
            change = np.ones(len(kinds), dtype=bool)
            change[1:] = kinds[1:] != kinds[:-1]
            short = kinds[change]
            words.append(shapes._words(short, np.zeros(len(short), dtype=bool))[1])
        shape = np.concatenate(words)
        pair = mix(shape[:-1] * np.uint64(3) + shape[1:])
        marks = np.array([
            1_000 + min(int(np.log2(len(shape) + 1)), 20),
            2_000 + int(10 * signs / max(len(data), 1)) if len(data) else 2_999], dtype="uint64")
        for found in (shape, pair, mix(marks)):
            out[i] += np.bincount((found >> np.uint64(64 - BITS)).astype("int64"), minlength=TERMS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_space(rows: np.ndarray, rank: int = RANK) -> np.ndarray:
    """TERMS x rank: the leading right singular vectors."""
    values, vectors = np.linalg.eigh(rows.T.astype("float64") @ rows.astype("float64"))
    return vectors[:, np.argsort(-values)[:rank]].astype("float32")


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Share of label 1 among the most similar known vectors, weighted by similarity."""
    if not len(known):
        return np.full(len(vectors), 0.5)
    similar = vectors @ known.T
    if similar.shape[1] > neighbours:
        near = np.argpartition(-similar, neighbours - 1, axis=1)[:, :neighbours]
    else:
        near = np.broadcast_to(np.arange(similar.shape[1]), similar.shape)
    weight = np.maximum(np.take_along_axis(similar, near, axis=1), 0.0).astype("float64") ** POWER + 1e-9
    return (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term place occurs, over all documents."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shapes, rows, total = Shingler(1), 0, np.zeros(TERMS, dtype="int64")
        for batch in batches:
            for start, stop in slices(batch, 256 << 10):
                counts = term_counts(batch.column("text").slice(start, stop - start).to_pylist(), shapes)
                total += (counts > 0).sum(axis=0)
                rows += stop - start
        place = np.append(np.arange(TERMS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(total, rows))], names=["place", "n"])

    parts = own_columns(docs, "text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r["place"]: r["n"] for r in parts.collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(TERMS)], dtype="float64")


def labelled_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of the training rows: at most ``train_rows``, half of each label, by hash of doc_id."""
    known = own_columns(labels, "doc_id", "quality").where(
        F.col("quality").isin(0, 1) & (remainder(F.col("doc_id")) != 2)).distinct()
    amounts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    pick = F.shiftrightunsigned(F.xxhash64(F.lit(23), "doc_id"), 11) / F.lit(float(1 << 53))
    share = train_rows // 2
    wanted = F.lit(False)
    for quality, amount in amounts.items():
        wanted = wanted | ((F.col("quality") == quality) & (pick < min(1.0, (share + 4 * share**0.5) / amount)))
    # About train_rows rows, whatever the size of the input.
    sample = F.broadcast(known.where(wanted).select("doc_id", "quality", pick.alias("pick")))
    chosen = own_columns(docs, "doc_id", "text").join(sample, "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shapes = Shingler(1)
        for batch in batches:
            for start, stop in slices(batch, 256 << 10):
                part = batch.slice(start, stop - start)
                counts = term_counts(part.column("text").to_pylist(), shapes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("pick"), part.column("quality"), pa.array([c.tobytes() for c in counts], pa.binary())],
                    names=["pick", "quality", "counts"])

    kind = dict(sample.dtypes)["quality"]
    rows = chosen.select("pick", "quality", "text").mapInArrow(run, f"pick double, quality {kind}, counts binary")
    table = rows.orderBy("pick", "quality", "counts").limit(2 * train_rows).toArrow()
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="float32").reshape(-1, TERMS)
    y = np.array(table.column("quality").to_pylist(), dtype="float64")
    order = np.concatenate([np.flatnonzero(y == q)[:share] for q in (0, 1)]).astype("int64")
    return counts[order], y[order]


def score(docs: DataFrame, labels: DataFrame, train_rows: int = 2000, neighbours: int = 25, threshold: float = 0.7,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, held_out, score and predicted for every document."""
    total, frequency = document_frequencies(docs)
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype("float32")
    counts, y = labelled_rows(docs, labels, train_rows)
    x = weighted(counts, idf)
    space = latent_space(x) if len(x) else np.zeros((TERMS, RANK), dtype="float32")
    shared = docs.sparkSession.sparkContext.broadcast((idf, space, unit(x @ space), y))
    names = list(dict.fromkeys([*keep, "text"]))
    base = own_columns(docs, *names).withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(True)))
    carried = [*keep, "held_out"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shapes = Shingler(1)
        own_idf, own_space, known, own_labels = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for start, stop in slices(batch, 256 << 10):
                found = term_counts(batch.column("text").slice(start, stop - start).to_pylist(), shapes)
                for at in range(0, len(found), 256):
                    vectors = unit(weighted(found[at: at + 256], own_idf) @ own_space)
                    parts.append(vote(vectors, known, own_labels, neighbours))
            scores = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in carried] + [pa.array(scores), pa.array((scores >= threshold).astype("int32"))],
                names=[*carried, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*carried).schema.fields)
    return base.mapInArrow(run, f"{schema}, score double, predicted int")
