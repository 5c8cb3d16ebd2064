"""Word shingles of Arrow text batches as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from cuentaclara.llm.common import ship

ship(__name__)

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLACK = ~_SPACE
_VALUE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype="uint64")
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_VALUE[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype="uint64")
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Keeps the power tables of a task."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.up, self.down = _powers(_BASE, PIECE + 1), _powers(_INVERSE, PIECE + 1)

    def _words(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word; ``first`` marks bytes at which a text begins."""
        if len(data) >= len(self.up):  # one word of more than a piece
            self.up, self.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        black = _BLACK.take(data)
        left, right = black.copy(), black.copy()
        left[1:] &= ~black[:-1] | first[1:]
        right[:-1] &= ~black[1:] | first[1:]
        begin, end = np.flatnonzero(left), np.flatnonzero(right) + 1
        if not len(begin):
            return begin, np.zeros(0, dtype="uint64")
        total = np.add.reduceat(_VALUE.take(data) * self.up[: len(data)], begin)  # white space adds nothing
        return begin, mix(total * self.down[begin] + (end - begin).astype("uint64"))

    def flat(self, texts, key: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingle hashes of all texts of an Arrow string array, sorted within each text, and the n + 1 bounds of the texts.

        Null counts as empty. ``key`` maps all hashes at once, one to one; what it gives is sorted and returned in their place.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype="int64")[texts.offset: texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, dtype="uint8")[offsets[0]: offsets[-1]] if body else np.zeros(0, dtype="uint8")
        offsets = offsets - offsets[0]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        starts, hashes, at = [np.zeros(0, dtype="int64")], [np.zeros(0, dtype="uint64")], 0
        while at < len(data):
            stop = min(at + PIECE, len(data))
            if stop < len(data):  # cut where a word may end: at white space or between texts
                cuts = np.flatnonzero(_SPACE[data[at + 1: stop + 1]] | first[at + 1: stop + 1])
                while not len(cuts) and stop < len(data):
                    stop = min(stop * 2 - at, len(data))
                    cuts = np.flatnonzero(_SPACE[data[at + 1: stop]] | first[at + 1: stop])
                stop = at + 1 + int(cuts[-1]) if len(cuts) else len(data)
            begin, h = self._words(data[at:stop], first[at:stop])
            starts.append(begin + at)
            hashes.append(h)
            at = stop
        start, word = np.concatenate(starts), np.concatenate(hashes)
        bounds = np.searchsorted(start, offsets)
        k = self.words
        run = word[: max(len(word) - k + 1, 0)].copy()
        for i in range(1, k):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + word[i: len(word) - k + 1 + i])
        n = np.diff(bounds)
        short = np.flatnonzero((n > 0) & (n < k))
        many = np.maximum(n - k + 1, 0)
        many[short] = 1
        ends = np.cumsum(many)
        whole = np.repeat(n >= k, many)
        # Shingles of a text of k words or more stand at its words but the last k - 1.
        values = np.empty(len(whole), dtype="uint64")
        values[whole] = run[(np.arange(len(whole)) + np.repeat(bounds[:-1] - ends + many, many))[whole]]
        for i in short:  # fewer words: the whole sequence as one shingle
            lo, hi = bounds[i], bounds[i + 1]
            h = word[lo: lo + 1]
            for j in range(lo + 1, hi):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word[j])
            values[ends[i] - 1] = mix(h + np.uint64(int(hi - lo)))[0]
        if key is not None:
            values = key(values)
        for lo, hi in zip((ends - many).tolist(), ends.tolist(), strict=True):
            if hi - lo > 1:
                values[lo:hi].sort()
        fresh = np.ones(len(values), dtype=bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[(ends - many)[many > 0]] = True
        before = np.concatenate([[0], np.cumsum(fresh)])
        return values[fresh], before[np.concatenate([[0], ends])]

    def sets(self, texts) -> Iterator[np.ndarray]:
        """Per text of an Arrow string array its distinct shingle hashes, sorted. Null counts as empty."""
        values, bounds = self.flat(texts)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield values[lo:hi]


def signatures(values: np.ndarray, bounds: np.ndarray):
    """128 bits for each text of ``Shingler.flat`` as an Arrow array, which two sets share if, for all practical purposes, they are equal."""
    import pyarrow as pa

    halves = np.empty((len(bounds) - 1, 2), dtype=">u8")
    for i, mixed in enumerate((values ^ np.uint64(0x5851F42D4C957F2D), values + np.uint64(0x14057B7EF767814F))):
        total = np.concatenate([np.zeros(1, dtype="uint64"), np.cumsum(mix(mixed), dtype="uint64")])
        halves[:, i] = total[bounds[1:]] - total[bounds[:-1]]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(halves), [None, pa.py_buffer(halves.tobytes())]).cast(pa.binary())
