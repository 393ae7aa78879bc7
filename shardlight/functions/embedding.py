"""Deterministic hashed text embeddings and the provider plug-in point.

A text's vector counts its words, weighted 1 / (1 + 0.1 i) by their position i, and its character bigrams (0.3) and
trigrams (0.2), all in lower case, each in the dimension its stable hash falls in, and is scaled to length 1.
The work is vectorised per Arrow batch: every distinct feature of a batch is hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the embedding: n-gram lengths with their weights, and the decay of word weights.
NGRAM_WEIGHTS = {2: 0.3, 3: 0.2}
WORD_DECAY = 0.1

Provider = Callable[[list[str]], np.ndarray]


class HashedProvider:
    """The local provider; picklable, keeps a bounded table of feature slots.

    The n-grams of a batch are numbers (21 bits a character), of which only the distinct ones are looked up and, once, hashed.
    """

    def __init__(self, dimension: int, remembered: int = 200_000):
        self.dimension, self.remembered = dimension, remembered
        self._slots: dict[str | tuple[int, int], int] = {}

    def slot(self, feature: str, number: tuple[int, int] | None = None) -> int:
        at = self._slots.get(number or feature)
        if at is None:
            if len(self._slots) >= self.remembered:
                self._slots.clear()
            digest = hashlib.sha256(feature.encode("utf-8", "surrogatepass")).digest()
            at = self._slots[number or feature] = int.from_bytes(digest[:8], "big") % self.dimension
        return at

    def _gram_slot(self, size: int, number: int) -> int:
        known = self._slots.get((size, number))
        if known is not None:
            return known
        return self.slot("".join(chr((number >> 21 * (size - 1 - d)) & 0x1FFFFF) for d in range(size)), (size, number))

    def __call__(self, texts: list[str]) -> np.ndarray:
        lows = [(t or "").lower() for t in texts]
        n, d = len(lows), self.dimension
        cells: list[int] = []
        weights: list[float] = []
        for row, low in enumerate(lows):
            for i, word in enumerate(low.split()):
                cells.append(row * d + self.slot(word))
                weights.append(1 / (1 + WORD_DECAY * i))
        out = np.bincount(np.array(cells, np.int64), np.array(weights), minlength=n * d).astype(np.float64)
        points = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(n), [len(t) for t in lows])
        for size, weight in NGRAM_WEIGHTS.items():
            m = len(points) - size + 1
            if m <= 0:
                continue
            number = points[:m].copy()
            for ahead in range(1, size):
                number <<= 21
                number |= points[ahead : ahead + m]
            inside = owner[:m] == owner[size - 1 :]  # within one text
            distinct, which = np.unique(number[inside], return_inverse=True)
            slots = np.array([self._gram_slot(size, g) for g in distinct.tolist()], np.int64)
            if len(slots):
                out += weight * np.bincount(owner[:m][inside] * d + slots[which], minlength=n * d)
        out = out.reshape(n, d)
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norms == 0, 1, norms)


#: Fixed values. Provider names that stand for remote services; this engine makes no external calls, so they are the local one.
_LOCAL_NAMES = ("local", "external", "stub", "openai", "gemini", "sentence-transformers")


def provider(name: str, dimension: int) -> Provider:
    if name not in _LOCAL_NAMES:
        raise ValueError(f"unknown embedding provider: {name}")
    return HashedProvider(dimension)


def embed(df: DataFrame, text: str, provider_: Provider, output: str = "vector", double: bool = False) -> DataFrame:
    """``df`` with the vector of its text column; null texts get a zero vector. No shuffle."""
    kind = "double" if double else "float"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = provider_(batch.column(at).to_pylist())
            flat = pa.array(vectors.astype(np.float64 if double else np.float32).ravel())
            size = vectors.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, output])

    return df.mapInArrow(run, f"{fields}, `{output}` array<{kind}>")
