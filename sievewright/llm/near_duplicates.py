"""Near-duplicate records: LSH forest over several sorted signature orders.

Every text has one key per tree: ``LEVELS`` codes of ``CODE_BITS`` bits, cut
from independent min-wise values and packed into one integer below the tree's
number.  Sorting those integers sorts all trees.  Each row is compared with all
rows that share a prefix of ``FIRST`` codes with it, however many they are: within
a task up to ``BLOCK`` rows, by pairs of blocks beyond.

Two sets with overlap J share the first d codes of a tree with probability J^d,
so of ``TREES`` trees at least one with 1 - (1 - J^d)^TREES; with the codes that
a pair shares beyond the prefix that is 0.9999 at J = 0.8 and 0.985 at 0.7, in
thin and dense regions alike.  Candidates pass a Hamming filter on fingerprints
(missing a pair at 0.7 with a probability below 1e-4) and are then checked on
their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import pairs as P
from sievewright.llm.components import components
from sievewright.llm.words import fingerprints, set_hashes, signatures, word_sets
from sievewright.operators.lineage import checkpointed

TREES, LEVELS, CODE_BITS = 24, 9, 6
DEPTH_BITS = LEVELS * CODE_BITS
#: Levels that candidates have in common at least.
FIRST = 5
#: Further levels that they have in common, in any place: at overlap 0.7 a pair with a common prefix has them with 0.92, one at 0.16 with 0.12.
MORE = 2
PREFIX_SHIFT = (LEVELS - FIRST) * CODE_BITS
LEVEL_MASK = sum(1 << (CODE_BITS * level) for level in range(LEVELS))
#: Rows with one prefix are compared with one another within the task up to this number, by blocks of it beyond.
BLOCK = 2048
#: Comparisons after which a task passes candidates on.
COMPARED = 4_000_000
#: Rows that a task holds.
HELD = 200_000
#: Bits in which the first 64, and all, bits of the fingerprints may differ (four standard deviations at overlap 0.7).
NEAR_64, NEAR_ALL = 21, 62

FEATURES = "id bigint, h0 bigint, h1 bigint, keys array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def tree_keys(values: np.ndarray) -> np.ndarray:
    """The key of each text in each tree."""
    code = (values[:, : TREES * LEVELS] & np.uint32(2**CODE_BITS - 1)).astype(np.int64).reshape(len(values), TREES, LEVELS)
    key = np.broadcast_to(np.arange(TREES, dtype=np.int64), (len(values), TREES)).copy()
    for level in range(LEVELS):
        key = (key << CODE_BITS) | code[:, :, level]
    return key


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sets = word_sets(texts)
        h0, h1 = set_hashes(*sets, texts)
        values = signatures(*sets)
        keys = tree_keys(values)
        empty = np.diff(sets[1]) == 0
        offsets = np.concatenate(([0], np.cumsum(np.where(empty, 0, TREES)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[~empty].ravel()))
        bits = fingerprints(values)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(h0), pa.array(h1), lists, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))],
            names=["id", "h0", "h1", "keys", "s0", "s1", "s2", "s3"],
        )


def features(texts: DataFrame) -> DataFrame:
    """Set hashes, tree keys and fingerprint of each (id, text); a text without words is in no tree."""
    return texts.select("id", "text").mapInArrow(_features, FEATURES)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows with one prefix pass the filters: differences of their keys, and of the first 64 bits of their fingerprints."""
    fold = x | (x >> 3)
    fold = (fold | (fold >> 1) | (fold >> 2)) & LEVEL_MASK
    # of a signed number bitwise_count would count the bits of the absolute value
    return (np.bitwise_count(fold) <= LEVELS - FIRST - MORE) & (np.bitwise_count(y.view(np.uint64)) <= NEAR_64)


def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of the run of one prefix that each row, sorted by key, is in."""
    prefix = k >> PREFIX_SHIFT
    begin = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(k)))
    return np.repeat(begin, size), np.repeat(size, size)


def neighbour_pairs(k: np.ndarray, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among rows sorted by key, and the positions of rows in runs of one prefix longer than BLOCK."""
    begin, length = _runs(k)
    end = begin + length
    found = []
    at, step = np.flatnonzero(length <= BLOCK), 1
    while len(at := at[at + step < end[at]]):
        near = at[_alike(k[at] ^ k[at + step], s[at] ^ s[at + step])]
        found.append((i[near], i[near + step]))
        step += 1
    pick = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pick([a for a, _ in found]), pick([b for _, b in found]), np.flatnonzero(length > BLOCK)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one partition sorted by key.  Rows of runs longer than BLOCK come out too, as (id, run, block, key, bits)."""
    names = ["a", "b", "run", "block", "key", "bits"]
    held = [np.zeros(0, np.int64)] * 3
    run, seen = None, 0  # prefix of the last long run, and rows of it that are out

    def out(k, i, s):  # noqa: ANN001, ANN202
        nonlocal run, seen
        begin, length = _runs(k)
        cost = np.cumsum(np.where(length <= BLOCK, length, 0))
        part = cost[begin] // COMPARED  # whole runs
        for piece in np.split(np.arange(len(k)), np.flatnonzero(part[1:] != part[:-1]) + 1):
            a, b, _ = neighbour_pairs(k[piece], i[piece], s[piece])
            null = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), null, null, null, null], names=names)
        prefix = k >> PREFIX_SHIFT
        long = length > BLOCK
        if run is not None:  # the rest of a long run
            long |= prefix == run
        long = np.flatnonzero(long)
        cuts = np.flatnonzero(np.diff(prefix[long])) + 1
        for mine in np.split(long, cuts) if len(long) else ():
            which = int(prefix[mine[0]])
            seen = seen if which == run else 0
            number = (seen + np.arange(len(mine))) // BLOCK
            run, seen = which, seen + len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(i[mine]), pa.nulls(len(mine), pa.int64()), pa.array(prefix[mine]), pa.array(number), pa.array(k[mine]), pa.array(s[mine])], names=names)

    for batch in batches:
        held = [np.concatenate((x, np.asarray(batch.column(c)))) for c, x in enumerate(held)]
        k = held[0]
        if len(k) < 2 * HELD:
            continue
        cut = int(np.searchsorted(k, k[-1] >> PREFIX_SHIFT << PREFIX_SHIFT))  # the last run may go on
        if len(k) - cut > HELD:
            cut = len(k)
        yield from out(*(x[:cut] for x in held))
        held = [x[cut:] for x in held]
    if len(held[0]):
        yield from out(*held)


def _blocks(table: pa.Table) -> pa.Table:
    """Candidates of one pair of blocks (id, key, bits, upper); of a block with itself all rows are on both sides."""
    i, k, s, upper = (np.asarray(table.column(c)) for c in ("id", "key", "bits", "upper"))
    low, up = np.flatnonzero(~upper), np.flatnonzero(upper)
    a, b = [], []
    for at in range(0, len(low), 256):
        mine = low[at : at + 256]
        x, y = np.nonzero(_alike(k[mine, None] ^ k[None, up], s[mine, None] ^ s[None, up]) & (i[mine, None] != i[None, up]))
        a.append(i[mine[x]])
        b.append(i[up[y]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _hot(entries: DataFrame, share: int, limit: int) -> list[tuple[int, int]]:
    """Prefixes with more than ``limit`` rows, judged on one of ``share`` rows, and their blocks; at most rows / limit of them."""
    prefix = F.shiftright("key", PREFIX_SHIFT)
    return [(r[0], -(-r[1] * share // BLOCK)) for r in entries.groupBy(prefix.alias("p")).count().where(F.col("count") * share > limit).collect()]


def candidates(reps: DataFrame, rows: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, of representatives (id, keys, s0)."""
    prefix = F.shiftright("key", PREFIX_SHIFT)
    entries = reps.select(F.explode("keys").alias("key"), "id", "s0")
    # A prefix that one task should not have alone goes to its blocks at once.
    share = max(1, rows // 10_000)
    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(F.explode("keys").alias("key"))
    hot = _hot(sample, share, max(4 * BLOCK, rows * TREES // 2_000))
    cold = entries
    if hot:
        wanted = F.broadcast(reps.sparkSession.createDataFrame(hot, "run bigint, blocks bigint"))
        cold = entries.join(wanted, prefix == F.col("run"), "left_anti")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cold.repartition(parts, prefix).sortWithinPartitions("key").mapInArrow(_forest, "a bigint, b bigint, run bigint, block bigint, key bigint, bits bigint")
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    near = found.where("run is null").select("a", "b")
    large = found.where("run is not null").select(F.col("a").alias("id"), "run", "block", "key", "bits")
    if hot:
        each = entries.join(wanted, prefix == F.col("run"))
        large = large.unionByName(each.select("id", "run", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "key", F.col("s0").alias("bits")))
    elif large.isEmpty():
        return near.distinct()
    # All pairs of a large region, by pairs of blocks: each meets in a task of its own.
    last = large.groupBy("run").agg(F.max("block").alias("last"))
    placed = large.join(last, "run").select("run", "id", "key", "bits", "block", "last")
    lower = placed.select("run", "id", "key", "bits", F.col("block").alias("x"), F.explode(F.expr("sequence(block, last)")).alias("y"), F.lit(False).alias("upper"))
    upper = placed.select("run", "id", "key", "bits", F.explode(F.expr("sequence(0L, block)")).alias("x"), F.col("block").alias("y"), F.lit(True).alias("upper"))
    met = lower.unionByName(upper).groupBy("run", "x", "y").applyInArrow(_blocks, "a bigint, b bigint")
    return near.unionByName(met).distinct()


def links(texts: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, overlap) between the first rows of equal word sets, and copies (id, rep)."""
    texts = texts.where("id is not null")
    found = features(texts).persist(StorageLevel.MEMORY_AND_DISK)
    copy = checkpointed(P.copies(found))
    reps = found.join(P.within_bound(copy.select("id")), "id", "left_anti")
    rows = found.count()
    sketches = found.select("id", *P.SKETCH)
    some = P.sketch_filter(candidates(reps, rows).where("a < b"), sketches, NEAR_ALL).distinct()
    return checkpointed(P.verified(some, texts, threshold)), copy


def near_duplicate_pairs(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs (a, b), a < b, of rows (id, text) whose distinct words overlap by ``threshold`` or more.

    Null text counts as empty.  Rows without words pair only with equal texts.  Equal word sets are pairs.
    Extra columns are ignored.  Rows without id are left out; an id that comes again with the same text counts once.
    Of an empty table the result is empty.
    """
    near, copy = links(texts, threshold)
    between = P.expanded(near.select("a", "b"), copy, copy)
    within = P.within_classes(copy)
    both = between.unionByName(within)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicate_groups(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per text: id, group_id (the smallest id that links reach), links (to representatives of other word sets), copies.

    A row without a link is its own group.  Copies of a word set share its group and its links.  Otherwise as
    ``near_duplicate_pairs``.
    """
    near, copy = links(texts, threshold)
    near = near.select("a", "b")
    group = components(near)
    degree = near.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    size = copy.groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("copies"))
    rows = texts.select("id").where("id is not null").distinct().join(copy, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    joined = rows.join(degree, "rep", "left").join(size, "rep", "left").join(group.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return joined.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
