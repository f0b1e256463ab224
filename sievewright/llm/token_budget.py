"""Exact token totals per slice: each distinct piece is tokenized once.

Texts are cut into the tokenizer's pieces and counted per slice within the task;
counts are gathered by piece; there each distinct piece is tokenized once, its
length multiplied with its count in every slice, and the products summed up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.bpe import TOKENIZERS, opened, shipped

#: Distinct (slice, piece) counts that a task holds before it passes them on.
HELD = 200_000
NONE = "(none)"


def language(column: Column) -> Column:
    """One spelling per language: lower case, without blanks and without what follows the first two or three letters and a hyphen; null, blank and ``unknown`` are ``unknown``."""
    bare = F.regexp_extract(F.lower(F.trim(column)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    plain = F.lower(F.trim(column))
    return F.when(column.isNull() | (plain == ""), "unknown").when(bare != "", bare).otherwise(plain)


def label(column: Column) -> Column:
    """Lower case without outer blanks; null and blank are ``(none)``."""
    plain = F.lower(F.trim(column))
    return F.when(column.isNull() | (plain == ""), NONE).otherwise(plain)


def token_totals(rows: DataFrame, by: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Rows and tokens per combination of the columns ``by``, which hold no null; and the rows that have a token.

    ``slices``, if the frame has an array column of that name, gives the values of the last of ``by``: a row counts in
    each of them.  Null and empty texts are rows without tokens.  Of an empty table the result is empty.
    """
    shared = shipped(rows.sparkSession, name, folder)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = opened(shared)
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for s, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["slice", "piece", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for slice_, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(slice_, Counter()).update(code.pieces(value))
            size = sum(map(len, held.values()))
            if size > HELD:
                yield from out()
        yield from out()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, total = opened(shared), Counter()
        for batch in batches:
            pieces = batch.column(1).to_pylist()
            code.learn(set(pieces))
            for s, p, n in zip(batch.column(0).to_pylist(), pieces, batch.column(2).to_pylist(), strict=True):
                total[s] += len(code.known[p]) * n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["slice", "tokens"])

    group = F.to_json(F.struct(*by))
    listed = rows.select(*by, group.alias("slice"), F.col(text).alias("text"))
    keys = listed.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length("text") > 0).alias("rows_with_text"), *[F.first(c).alias(c) for c in by])
    counted = listed.select("slice", "text").mapInArrow(count, "slice string, piece string, n bigint")
    counted = counted.groupBy("piece", "slice").agg(F.sum("n").alias("n")).select("slice", "piece", "n")
    tokens = counted.repartition("piece").sortWithinPartitions("piece").mapInArrow(lengths, "slice string, tokens bigint").groupBy("slice").agg(F.sum("tokens").alias("tokens"))
    return keys.join(tokens, "slice", "left").select(*by, "rows", "rows_with_text", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
