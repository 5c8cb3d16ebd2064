"""Fill-in-middle transformation through piece tables.

A document becomes a table of descriptors (buffer, start, length) over buffers that never change: the text in UTF-8 and
one buffer per sentinel. Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels between
them, the inverse permutation restores the text, and digests stream the descriptors; a text is joined only where the
arranged text itself is asked for.

Where a text is cut and how it is arranged comes from the digest of the seed and doc_id, so reruns and lost tasks give
the same rows. Units are lines with their line break.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel already, stays plain. A null
doc_id is hashed as no digits. Every row gives one row, also repeated ones. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from cuentaclara.llm.common import own_columns, ship, slices

ship(__name__)

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Form: the sentinels in the order in which they stand, and before each the part of the text (0, 1, 2) that follows it.
ARRANGEMENTS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
KINDS = {
    "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string",
    "output_sha256": "string", "restored_sha256": "string"}


@dataclass(frozen=True)
class Piece:
    """``length`` bytes of ``buffer`` from ``start``."""

    buffer: bytes | memoryview
    start: int
    length: int

    def view(self) -> memoryview:
        return memoryview(self.buffer)[self.start: self.start + self.length]


class PieceTable:
    """Descriptors in reading order. Every operation gives a new table over the same buffers."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.pieces = pieces

    @classmethod
    def of(cls, buffer: bytes) -> PieceTable:
        return cls([Piece(buffer, 0, len(buffer))])

    def cut(self, *places: int) -> PieceTable:
        """Split so that a descriptor ends at each place (bytes from the start, in order); parts may be empty."""
        out, waiting, at = [], list(places), 0
        for piece in self.pieces:
            start, end = piece.start, piece.start + piece.length
            while waiting and at <= waiting[0] <= at + (end - start):
                stop = start + waiting.pop(0) - at
                out.append(Piece(piece.buffer, start, stop - start))
                at += stop - start
                start = stop
            out.append(Piece(piece.buffer, start, end - start))
            at += end - start
        return PieceTable(out)

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix permuted, each behind its sentinel."""
        out = []
        for sentinel, part in ARRANGEMENTS[form]:
            out += [Piece(sentinel, 0, len(sentinel)), self.pieces[part]]
        return PieceTable(out)

    def restored(self, form: str) -> PieceTable:
        """The inverse permutation of ``arranged``, without the sentinels."""
        back = {part: self.pieces[2 * i + 1] for i, (_, part) in enumerate(ARRANGEMENTS[form])}
        return PieceTable([back[part] for part in sorted(back)])

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.pieces:
            digest.update(piece.view())
        return digest.hexdigest()

    def joined(self) -> bytes:
        return b"".join(piece.view() for piece in self.pieces)


def parsed(output: bytes, form: str) -> PieceTable:
    """The table of an arranged text, cut at its sentinels. No part holds one, and none can arise where two parts meet."""
    places, at = [], 0
    for sentinel, _ in ARRANGEMENTS[form]:
        at = output.index(sentinel, at)
        places += [at, at + len(sentinel)]
        at += len(sentinel)
    return PieceTable(PieceTable.of(output).cut(*places).pieces[1:])


def restore(output: bytes, form: str) -> PieceTable:
    """The original text, from the arranged text and its form alone."""
    return PieceTable.of(output) if form == "plain" else parsed(output, form).restored(form)


def code_points(piece: Piece) -> int:
    data = np.frombuffer(piece.view(), dtype="uint8")
    return int(((data & 0xC0) != 0x80).sum())


def line_ends(text: bytes) -> np.ndarray:
    """Byte places where the first 0, 1, ... n lines end."""
    ends = np.flatnonzero(np.frombuffer(text, dtype="uint8") == 10) + 1
    last = [len(text)] if text and not text.endswith(b"\n") else []
    return np.concatenate([[0], ends, last]).astype("int64")


def transformed(doc_id: str, text: bytes, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, PieceTable, Piece | None, Piece | None]:
    """Number of lines, form, arranged table, prefix and middle (None if plain)."""
    ends = line_ends(text)
    n = len(ends) - 1
    key = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i: i + 8], 16) for i in range(0, 32, 8))
    whole = PieceTable.of(text)
    if not text or h3 % 100 >= fim_percent or any(s in text for s in SENTINELS):
        return n, "plain", whole, None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = whole.cut(int(ends[first]), int(ends[second]))
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, parts.arranged(form), parts.pieces[0], parts.pieces[1]


def transform(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50,
              outputs: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """doc_id and the ``outputs``: n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    ``restored_sha256`` is the digest of the text rebuilt from the arranged text and the form, without the original.
    """
    rows = own_columns(docs, "doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string()}
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b, 4 << 20)):
            columns: dict[str, list] = {name: [] for name in outputs}
            ids = batch.column("doc_id").cast(pa.string())
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(ids, texts, strict=True):
                n, form, table, prefix, middle = transformed(
                    doc_id.as_py() or "", text.as_py() or b"", seed, fim_percent, spm_percent)
                made = {"n": n, "form": form, "prefix_chars": prefix and code_points(prefix), "middle_chars": middle and code_points(middle)}
                if "output_sha256" in columns:
                    made["output_sha256"] = table.sha256()
                if "output" in columns or "restored_sha256" in columns:
                    output = table.joined()
                    if "output" in columns:
                        made["output"] = output.decode()
                    if "restored_sha256" in columns:
                        made["restored_sha256"] = restore(output, form).sha256()
                for name in outputs:
                    columns[name].append(made[name])
            arrays = [pa.array(values, types[KINDS[name]]) for name, values in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *outputs])

    schema = ", ".join(f"{name} {KINDS[name]}" for name in outputs)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}")


def originals(arranged: DataFrame) -> DataFrame:
    """doc_id and the text, rebuilt from the columns ``output`` and ``form`` of ``transform``."""
    rows = own_columns(arranged, "doc_id", "output", "form")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b, 4 << 20, "output")):
            texts = [restore(o.as_py().encode(), f.as_py()).joined().decode() for o, f in zip(batch.column("output"), batch.column("form"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
