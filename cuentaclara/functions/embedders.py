"""A deterministic stand-in for an embedding model, used where none is supplied."""

from __future__ import annotations

import math
import re
import sys
import zlib

from pyspark import cloudpickle

# Executors need not have this package installed: what runs there travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(r"[^\W_]+")


class HashingEmbedder:
    """Signed feature hashing of words into ``width`` slots, scaled to unit length."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        slots = [0.0] * self.width
        for word in _WORD.findall((text or "").lower()):
            h = zlib.crc32(word.encode())
            slots[h % self.width] += 1.0 if (h >> 16) & 1 else -1.0
        length = math.sqrt(sum(x * x for x in slots))
        return [x / length for x in slots] if length else slots


class CountingEmbedder:
    """How often each of a few characters occurs: values that any engine can repeat."""

    def __init__(self, characters: str = "aeiorst 0.") -> None:
        self.characters = characters

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[float((t or "").count(c)) for c in self.characters] for t in texts]
