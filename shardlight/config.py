"""Engine options. Only knobs that change a result or a plan exist."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineOptions:
    dimension: int = 384
    half_precision: bool = True
    index_type: str = "centroid"  # or "bucket"
    num_buckets: int = 100
    probe_count: int = 3
    kmeans_rounds: int = 8
    chunk_size: int = 512
    overlap: int = 50
    shard_count: int = 4
    max_batch_size: int = 100
    max_text_size: int = 100_000
    lock_timeout_seconds: float = 30.0
    provider: str = "local"
    record_events: bool = False

    def __post_init__(self):
        if self.shard_count < 1:
            object.__setattr__(self, "shard_count", 1)


class EngineError(Exception):
    """Base of the engine's errors."""


class TooLarge(EngineError):
    """A text or batch is above its limit."""


class Conflict(EngineError):
    """A document id is taken, repeated in a batch, or gives no chunks."""


class NotFound(EngineError):
    """No active document has this id."""


def check_top_k(top_k: int) -> int:
    """``top_k`` if it is within 1..100."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be between 1 and 100")
    return top_k
