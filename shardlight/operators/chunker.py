"""Sliding-window chunks that prefer to end at a space.

A window of ``size`` characters ends at the last plain space up to ``slack`` characters beyond it, if there is one after its
start. The next window begins ``overlap`` before the end (or at the end where that would not advance). The stripped
text is emitted with unstripped offsets; windows without text are not. Blank and null texts have no chunks. A window that
emits nothing and doesn't advance is skipped, so any text ends. At most ``most`` + 1 chunks come from a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_FIELDS = "chunk_no int, start_idx int, end_idx int, text string"
#: How far beyond the window a space may lie, and the bound on chunks of a text: fixed values.
SLACK, MOST = 50, 10_000


def windows(text: str | None, size: int = 512, overlap: int = 50) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of the chunks of one text."""
    found: list[tuple[int, int, str]] = []
    length = len(text) if text and not text.isspace() else 0
    at = 0
    while at < length and len(found) <= MOST:
        end = at + size
        if end >= length:
            end = length
        else:
            space = text.rfind(" ", at + 1, end + SLACK)
            if space >= 0:
                end = space
        body = text[at:end].strip()
        if body:
            found.append((at, end, body))
        back = end - overlap
        floor = found[-1][0] if found else 0
        following = back if back > floor else end
        at = following if following > at else max(end, at + 1)
    return found


def chunk(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(key, chunk_no, start_idx, end_idx, text): the chunks of every text, a map over the rows."""
    size, overlap = size or 512, overlap or 50
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, starts, ends, bodies = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, (a, b, body) in enumerate(windows(t, size, overlap)):
                    keys.append(i)
                    numbers.append(n)
                    starts.append(a)
                    ends.append(b)
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, pa.int32()) for c in (numbers, starts, ends)), pa.array(bodies, pa.string())],
                names=[key, "chunk_no", "start_idx", "end_idx", "text"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {CHUNK_FIELDS}")
