"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .tokens import VOCABULARY, codec


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of every text, without special tokens.

    The null and the empty text give an empty list. Text that looks like a special token is ordinary text. Every row gives a
    row, repeated and null keys included; other columns are ignored. A map over Arrow batches: nothing is exchanged.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode = codec(vocabulary).encode_packed
        for batch in batches:
            packed = [encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text``: the texts of lists of ids; the inverse of ``encode_corpus`` but for the null text, which becomes empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decode = codec(vocabulary).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")
