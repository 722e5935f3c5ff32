"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a rank file named by its path; it is read on the executors
and never copied. A null text has no tokens. Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# fixed value: the pattern that splits text before the merges of byte-level rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, built once per worker."""
    import base64

    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _count(batches: Iterator, path: str) -> Iterator:
    import pyarrow as pa

    tokenizer = encoding(path)
    for batch in batches:
        counts = [0 if t is None else len(tokenizer.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``keep`` and ``n_tokens``."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(lambda it: _count(it, vocabulary), f"{fields}, n_tokens long")
