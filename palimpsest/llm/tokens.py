"""Sizes of texts in tokens of a public byte-level tokenizer, counted without building the tokens.

A byte-level BPE first cuts a text by a pattern and then encodes each part on its own, so the size of a
text is the sum over its parts; parts repeat, and each worker encodes a part once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern the vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter(dict):
    """Tokens of a part of text; unknown parts are encoded, and forgotten beyond a million."""

    def __init__(self, table: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        super().__init__()
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.parts = regex.compile(pattern).findall

    def __missing__(self, part: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[part] = len(self.encoding.encode_ordinary(part))
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.parts(text))) if text else 0


def token_counts(df: DataFrame, text_col: str, *keep: str, path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``n_tokens``; null and empty texts have none. The vocabulary is read by the driver."""
    table = df.sparkSession.sparkContext.broadcast(ranks(path))  # the file of a public tokenizer: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table.value)
        for batch in batches:
            n = [counter.count(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    rows = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_tokens bigint")
