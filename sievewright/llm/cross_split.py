"""Records of evaluation splits that are also in the training split, exactly or almost.

Every text has a similarity-hash fingerprint: ``FUNCTIONS`` min-wise values of its
words, of each the low bits as a segment and one bit more.  A permutation cuts the
segments into ``BLOCKS`` blocks of ``SEGMENTS``; an evaluation row and a training
row that agree in a block meet in an equi-join, keep to the Hamming radius in the
first 64 of the single bits there and in all of them afterwards, and are then
checked on their words.

Texts with overlap J agree in a segment with probability J (and 1/2^bits of the
rest), so in one block at least with 1 - (1 - J^SEGMENTS)^BLOCKS: 0.988 at 0.7,
0.9999 at 0.8, whatever the number of rows.  Texts that have nothing to do with one
another, but for the words of their kind, overlap by about 0.16 and meet in one
block of ten thousand.  The radius loses a pair at 0.7 with a probability below 1e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import pairs as P
from sievewright.llm.near_duplicates import NEAR_64, NEAR_ALL
from sievewright.llm.words import FUNCTIONS, fingerprints, set_hashes, signatures, word_sets
from sievewright.operators.lineage import checkpointed

#: Blocks, segments of each, bits of a segment; fixed, so that a pair's chance does not depend on the table.
BLOCKS, SEGMENTS, SEGMENT_BITS = 24, 5, 8
#: Training rows with one code that one task joins; more are dealt out by salt.
HOT = 20_000
#: Rows of the sample that hot codes are looked for in.
SAMPLED = 10_000

_ORDER = np.random.default_rng(4_001).permutation(FUNCTIONS)[: BLOCKS * SEGMENTS].reshape(BLOCKS, SEGMENTS)
FEATURES = "id bigint, train boolean, h0 bigint, h1 bigint, codes array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def block_codes(values: np.ndarray) -> np.ndarray:
    """Codes of min-wise values, one column per block; the block's number is in the code."""
    segment = ((values >> np.uint32(8)) & np.uint32(2**SEGMENT_BITS - 1)).astype(np.int64)
    codes = np.broadcast_to(np.arange(BLOCKS, dtype=np.int64), (len(values), BLOCKS)).copy()
    for at in range(SEGMENTS):
        codes = (codes << SEGMENT_BITS) | segment[:, _ORDER[:, at]]
    return codes


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, train = batch.column(0), batch.column(1), batch.column(2)
        sets = word_sets(texts)
        h0, h1 = set_hashes(*sets, texts)
        values = signatures(*sets)
        bits = fingerprints(values)
        empty = np.diff(sets[1]) == 0
        offsets = np.concatenate(([0], np.cumsum(np.where(empty, 0, BLOCKS)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block_codes(values)[~empty].ravel()))
        yield pa.RecordBatch.from_arrays(
            [ids, train, pa.array(h0), pa.array(h1), lists, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))],
            names=["id", "train", "h0", "h1", "codes", "s0", "s1", "s2", "s3"],
        )


def hot_codes(training: DataFrame, rows: int) -> DataFrame | None:
    """(code, parts) of codes that more than HOT of the training rows (id, codes) have, judged on a sample; None without any.

    Only where rows are joined depends on it, not which.  A sample has at most about SAMPLED rows and a code in it 50, so the
    codes are few.
    """
    share = max(1, rows // SAMPLED)
    sample = training.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(F.explode("codes").alias("code"))
    counted = sample.groupBy("code").count().where(F.col("count") * share > max(HOT, 50 * share)).collect()
    if not counted:
        return None
    return training.sparkSession.createDataFrame([(r[0], -(-r[1] * share // HOT)) for r in counted], "code bigint, parts bigint")


def met(reps: DataFrame, rows: int) -> DataFrame:
    """Pairs (a, b) of evaluation and training rows that agree in a code and keep to the radius in 64 bits."""
    left = reps.where("not train").select(F.explode("codes").alias("code"), F.col("id").alias("a"), F.col("s0").alias("t0"))
    right = reps.where("train").select(F.explode("codes").alias("code"), F.col("id").alias("b"), "s0")
    by = ["code"]
    hot = hot_codes(reps.where("train"), rows)
    if hot is not None:
        parts = F.coalesce("parts", F.lit(1))
        left = left.join(F.broadcast(hot), "code", "left").select("code", "a", "t0", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        right = right.join(F.broadcast(hot), "code", "left").select("code", "b", "s0", F.pmod(F.xxhash64("b"), parts).alias("salt"))
        by.append("salt")
    return left.join(right, by).where(F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) <= NEAR_64).select("a", "b").distinct()


def cross_split_pairs(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs (a, b, overlap) of rows (id, train, text), a outside the training split and b in it, that overlap by the threshold.

    ``train`` is a boolean; null counts as outside.  Null text counts as empty; rows without words pair with equal
    texts only, with overlap 1.  Repeated rows of either side are compared once and expanded afterwards.
    Extra columns are ignored, rows without id left out.  Of an empty table, or one without either side, the result is
    empty.  The constants are for thresholds of 0.7 and more.
    """
    rows = rows.select("id", "text", F.coalesce("train", F.lit(False)).alias("train")).where("id is not null")
    found = rows.select("id", "text", "train").mapInArrow(_features, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    copy = checkpointed(P.copies(found, "train"))
    reps = found.join(P.within_bound(copy.select("id")), "id", "left_anti")
    some = met(reps, found.count())
    near = P.verified(P.sketch_filter(some, found.select("id", *P.SKETCH), NEAR_ALL), rows, threshold)
    silent = reps.where(F.size("codes") == 0).select("id", "train", "h0", "h1")
    equal = silent.where("not train").select(F.col("id").alias("a"), "h0", "h1").join(silent.where("train").select(F.col("id").alias("b"), "h0", "h1"), ["h0", "h1"])
    near = checkpointed(near.unionByName(equal.select("a", "b", F.lit(1.0).alias("overlap"))))
    sides = checkpointed(copy.join(found.select("id", "train"), "id"))
    return P.expanded(near, sides.where("not train"), sides.where("train"))


def leakage_report(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per split and source of the evaluation rows (id, split, source): rows, rows with an equal and with a near training row.

    ``pairs`` is what ``cross_split_pairs`` gives.  A row with both counts as equal.  Null sources are ``(none)``.
    """
    best = pairs.groupBy(F.col("a").alias("id")).agg(F.max("overlap").alias("best"))
    each = rows.join(best, "id", "left").groupBy("split", F.coalesce("source", F.lit("(none)")).alias("source"))
    share = F.col("leaked") / F.col("rows")
    return each.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("best") == 1).alias("same"),
        F.count_if(F.col("best") < 1).alias("almost"),
        F.count("best").alias("leaked"),
    ).withColumn("share", F.round(share, 4))
