"""Token counts by a public tokenizer (byte-level BPE for many languages by default)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Public vocabulary file of the default tokenizer and its folder; both are parameters everywhere.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_PLAIN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def split_pattern() -> str:
    """How the tokenizer cuts a text into words: the pattern published with the vocabulary files, if it can be imported here."""
    try:
        import public_tokenizers
    except ImportError:
        return _PLAIN_PATTERN
    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str | None = None):
    """The byte-level BPE of a rank file, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern or split_pattern(), mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = DEFAULT_VOCABULARY, pattern: str | None = None) -> int:
    """Tokens of a text; 0 for null. Strings that name special tokens are ordinary text."""
    return len(encoding(path, pattern).encode_ordinary(text)) if text else 0


def token_counts(df: DataFrame, keys: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``tokens`` of every row; a map over the rows without a shuffle.

    The driver gives the vocabulary file and the pattern to the workers, which need no copy of their own.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", tokens long"
    df.sparkSession.sparkContext.addFile(vocabulary)
    name, pattern = os.path.basename(vocabulary), split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        for batch in batches:
            counts = pa.array([count_tokens(t, path, pattern) for t in batch.column(len(keys)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], counts], names=[*keys, "tokens"])

    return df.select(*keys, text).mapInArrow(run, schema)
