"""Encoding of texts with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.bpe import TOKENIZERS, opened, shipped

#: Texts that are encoded at a time.
CHUNK = 512


def encode(texts: DataFrame, key: str = "doc_id", text: str | Column = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row, without special tokens.

    Null and empty texts have an empty list, never null.  Blanks are encoded as they are and text that looks like a
    special token as plain text.  No shuffle: the vocabulary, whose size is fixed, is broadcast.
    """
    shared = shipped(texts.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = opened(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = code.encode(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.fromiter((x for row in ids for x in row), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    column = F.col(text) if isinstance(text, str) else text
    kind = texts.select(key).schema[0].dataType.simpleString()
    return texts.select(key, column.alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
