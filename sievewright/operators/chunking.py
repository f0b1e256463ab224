"""Texts into overlapping windows, keywords and domains of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.functions import text as T


def window_ends(text: str, size: int) -> Callable[[int], int]:
    """Where the window that begins at a place ends: behind the last blank within ``size`` characters, or after all of them if there is none."""
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)

    def end(begin: int) -> int:
        if begin + size >= len(text):
            return len(text)
        before = int(np.searchsorted(blanks, begin + size))
        return int(blanks[before - 1]) + 1 if before and blanks[before - 1] >= begin else begin + size

    return end


def windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Windows of squashed text that are not blank; a window begins ``overlap`` characters before the end of the one before, or there if that is no step on."""
    end, begin, last = window_ends(text, size), 0, 0
    while last < len(text):
        last = end(begin)
        if part := text[begin:last].strip():
            yield part
        begin = last - overlap if last - overlap > begin else last


def chunk(documents: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, content) of documents (doc_id, text).

    Where a window ends depends on the one before, so texts go through a vectorised pass; one row never meets another.
    Null, empty and blank texts have no chunks.  ``size`` must exceed ``overlap``.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, parts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, part in enumerate(windows(text, size, overlap)):
                    ids.append(doc)
                    numbers.append(n)
                    parts.append(part)
                if len(parts) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "chunk_index", "content"])
                    ids, numbers, parts = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "chunk_index", "content"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    plain = documents.select("doc_id", T.squashed(F.col("text")).alias("text"))
    cut = plain.mapInArrow(run, f"doc_id {kind}, chunk_index int, content string")
    return cut.withColumn("chunk_id", F.format_string("%s:chunk-%04d", F.col("doc_id").cast("string"), "chunk_index"))


def tagged(chunks: DataFrame, limit: int = 12) -> DataFrame:
    """Chunks with keywords and domains."""
    return chunks.withColumn("keywords", T.top_keywords(F.col("content"), limit)).withColumn("domains", T.domains_of(T.terms(F.col("content"))))


def memory_records(chunks: DataFrame) -> DataFrame:
    """Tagged chunks as memory (record_id, content, domains, keywords, source)."""
    return chunks.select(F.col("chunk_id").alias("record_id"), "content", "domains", "keywords", F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("source"))


def keywords(documents: DataFrame, limit: int = 12, stop_words: Sequence[str] = L.STOP_WORDS) -> DataFrame:
    """Most frequent content terms (doc_id, rank, term, n) by count, then name; for texts of any length."""
    each = documents.select("doc_id", F.explode(T.content_terms(F.col("text"), stop_words)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    return each.withColumn("rank", rank).where(F.col("rank") <= limit).select("doc_id", "rank", "term", "n")


def line_blocks(documents: DataFrame, size: int = 3500) -> DataFrame:
    """(doc_id, block_index, content): whole lines, a block ends with the line that brings it to ``size`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, parts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, length, n = [], -1, 0
                for line in (text or "").splitlines():
                    held.append(line)
                    length += len(line) + 1
                    if length >= size:
                        ids.append(doc)
                        numbers.append(n)
                        parts.append("\n".join(held))
                        held, length, n = [], -1, n + 1
                if held:
                    ids.append(doc)
                    numbers.append(n)
                    parts.append("\n".join(held))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "block_index", "content"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, block_index int, content string")
