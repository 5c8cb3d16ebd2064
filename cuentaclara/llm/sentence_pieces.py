"""SentencePiece encoding and decoding through a table of distinct chunks.

In the model no piece has a white-space marker after another character, so merges never cross from a word into the next
marker: a marked text is the concatenation of independent chunks, each a run of markers and the characters up to the
next one. Each task keeps a table of the distinct chunks it has met, segments a chunk once with the library, and joins
ids back by position. ``check_model`` verifies the premise on the model itself before a job starts.

The table belongs to a task. Between slices of about ``SLICE_BYTES`` of text, each of which leaves the task as a batch of its own,
it is emptied if it holds more than ``TABLE_CHUNKS`` chunks or about ``TABLE_BYTES`` bytes, and chunks of more than
``LONG_CHUNK`` characters leave it; that costs time and never changes a result.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text. Every row gives one
row, also repeated ones. Decoding gives a space for each marker, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from cuentaclara.llm.common import own_columns, ship, slices, tidy

ship(__name__)

MARK = "▁"
TABLE_CHUNKS = 400_000
TABLE_BYTES = 16 << 20
#: What Python needs for a chunk besides its characters and ids.
ENTRY_BYTES = 250
DECODE_ROWS = 256
SLICE_BYTES = 256 << 10
LONG_CHUNK = 1_000
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_model(path: str) -> None:
    """Raise where a piece could cross from a word into a marker, or the model changes the characters of a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [i for i in range(sp.get_piece_size()) if MARK in sp.id_to_piece(i).lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross white-space markers: {crossing[:5]}")
    probe = " A éé ①Ａ  b\n"
    if sp.decode(sp.encode(probe)) != probe:
        raise ValueError("the model normalises texts; chunks would have to be cut after that")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Output columns from number of ids, ids as decimal text, and decoded text; ``ids`` itself comes from the numbers.
MAKE = {
    "n_tokens": lambda n, ids, decoded: n,
    "decoded": lambda n, ids, decoded: decoded,
    "ids_sha256": lambda n, ids, decoded: _digest(ids),
    "decoded_sha256": lambda n, ids, decoded: _digest(decoded),
}


class Chunks:
    """Distinct chunks with their ids as decimal text and, if wanted, as 32-bit numbers; apart, the few whose ids decode to
    other characters."""

    def __init__(self, path: str, numbers: bool = False) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.decimal = [str(i) for i in range(self.sp.get_piece_size())]
        self.known: dict[str, str] = {}
        self.numbers: dict[str, bytes] | None = {} if numbers else None
        self.size = 0
        self.unlike: dict[str, str] = {}

    def learn(self, chunks: set[str]) -> None:
        """Segment those of the chunks that the table lacks, and decode their ids."""
        new = [c for c in chunks if c not in self.known]
        # The library puts one marker before each text, so a chunk goes in without its first one ...
        segmented = self.sp.encode([c[1:] for c in new], num_threads=1)
        # ... but not before an empty text.
        ids = [i or [self.sp.piece_to_id(MARK)] for i in segmented]
        plain = self.sp.decode(segmented)
        decimal = self.decimal
        for chunk, own, decoded in zip(new, ids, plain, strict=True):
            self.known[chunk] = text = ",".join([decimal[i] for i in own])
            if self.numbers is not None:
                self.numbers[chunk] = array("i", own).tobytes()
            self.size += len(chunk) + len(text) + 4 * len(own) + ENTRY_BYTES
            if decoded != chunk[1:].replace(MARK, " "):
                self.unlike[chunk] = " " + decoded

    def decoded(self, chunks: list[str]) -> str:
        if self.unlike:
            chunks = [self.unlike.get(c, c) for c in chunks]
        return "".join(chunks)[1:].replace(MARK, " ")

    def trim(self) -> None:
        """Between batches: keep the table within its bound."""
        if len(self.known) > TABLE_CHUNKS or self.size > TABLE_BYTES:
            self.known.clear()
            self.unlike.clear()
            if self.numbers is not None:
                self.numbers.clear()
            self.size = 0
        for chunk in [c for c in self.known if len(c) > LONG_CHUNK]:
            del self.known[chunk]
            if self.numbers is not None:
                del self.numbers[chunk]


def marked_chunks(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_texts(table: Chunks, texts: list[str]) -> Iterator[tuple[int, str, str, bytes]]:
    """Per text the number of ids, the ids as decimal text joined by commas, the decoded text, and the ids as numbers if kept."""
    chunked = [marked_chunks(t) for t in texts]
    table.learn({c for chunks in chunked for c in chunks})
    for chunks in chunked:
        ids = ",".join(map(table.known.__getitem__, chunks))
        numbers = b"" if table.numbers is None else b"".join(map(table.numbers.__getitem__, chunks))
        yield ids.count(",") + 1 if ids else 0, ids, table.decoded(chunks), numbers
    table.trim()


def _batches(path: str, outputs: tuple[str, ...]):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = Chunks(path, numbers="ids" in outputs)
        kinds = {"n_tokens": pa.int64()}
        for batch in batches:
            for start, stop in slices(batch, SLICE_BYTES):
                columns: dict[str, list] = {name: [] for name in outputs}
                lengths = [0]
                part = [t or "" for t in batch.column("text").slice(start, stop - start).to_pylist()]
                for n, ids, decoded, numbers in encode_texts(table, part):
                    lengths.append(n)
                    for name in outputs:
                        columns[name].append(numbers if name == "ids" else MAKE[name](n, ids, decoded))
                arrays = [batch.column("doc_id").slice(start, stop - start)]
                for name, values in columns.items():
                    if name == "ids":
                        flat = pa.Array.from_buffers(pa.int32(), sum(lengths), [None, pa.py_buffer(b"".join(values))])
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), flat))
                    else:
                        arrays.append(pa.array(values, kinds.get(name, pa.string())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *outputs])

    return run


def encode(docs: DataFrame, model_path: str | None = None,
           outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the ``outputs``: n_tokens, ids, decoded, ids_sha256, decoded_sha256."""
    path = model_path or default_model()
    check_model(path)
    kinds = {"n_tokens": "long", "ids": "array<int>"}
    schema = ", ".join(f"{name} {kinds.get(name, 'string')}" for name in outputs)
    rows = own_columns(docs, "doc_id", "text")
    return rows.mapInArrow(tidy(_batches(path, outputs)), f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and the text that the library's decode gives for the column ``ids``."""
    path = model_path or default_model()
    rows = own_columns(encoded, "doc_id", "ids")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                plain = [sp.decode(ids.as_py() or []) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(plain, pa.string())], names=["doc_id", "decoded"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, decoded string")
