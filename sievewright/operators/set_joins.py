"""Joins of sets by overlap, on inverted indexes with rarest-first prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.lineage import checkpointed

#: Sets with one item that one task indexes; more are dealt out by salt.
HOT = 20_000
#: Items whose frequency is known when sets are ordered; it costs time only if there are more frequent ones.
FREQUENT = 20_000
#: A frame with at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Share of the sets that may be small: for these alone deep places of larger sets are indexed, where an item in question is.
SMALL = 0.05
#: Marks of items that small sets probe with; a power of two.
MARKS = 1 << 20


def within_bound(frame: DataFrame) -> DataFrame:
    """Cut a small frame's lineage, as plans of frames kept within kept ones outgrow the driver, and mark it for broadcast if, counted, it keeps to the bound; else leave the join to shuffle it."""
    frame = checkpointed(frame)
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def overlap_pairs(sets: DataFrame, threshold: float, groups: str | None = None, side: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, shared) of sets (id, items) that share at least ``threshold`` of the smaller one; a is the smaller.

    Of two sets of equal size a is the one with the smaller id.  ``items`` holds distinct strings; empty and null sets
    pair with none.  A smaller set of n items must share need = ceil(threshold n) of them, so one of its n - need + 1
    rarest, and the rarest that it shares is among the n - need + 1 rarest of the larger set of n items too: only the
    former probe, and of the larger set an item is indexed only if a set probes with it that it can still do for.
    threshold must be above 0.  With ``groups``, an array
    column, only sets with a common group pair, and the index is kept by group; with ``side`` only sets of different
    sides.  ``carried``: columns of both ends that come along, as a_name and b_name.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    own = sets.select("id", F.transform("items", lambda i: F.xxhash64(i)).alias("items"), *([F.col(groups).alias("groups")] if groups else []), (F.col(side) if side else F.lit(0)).alias("side")).where(F.size("items") > 0)
    # Any one order of items will do; the most frequent ones come last, others in order of their hashes.
    frequent = own.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "item").limit(FREQUENT).collect()
    listed = np.array(sorted((r.item, r.df) for r in frequent), np.int64).reshape(-1, 2)
    hot, id_type = HOT, sets.schema["id"].dataType.simpleString()

    # Nearly all sets need at least ``most`` shared items.  For the others each mark has the least that a set needs which probes with an item of it.
    sizes = sorted(own.groupBy(F.size("items").alias("n")).count().collect())
    total, below, most = sum(r[1] for r in sizes), 0, 0
    for size, count in sizes:
        most = int(np.ceil(threshold * size - 1e-9))
        below += count
        if below > SMALL * total:
            break
    least, none = np.full(MARKS, 255, np.uint8), 255

    def ordered(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of each item of each set, rarest first: row, item, frequency, place, size of the set and what it needs; and first places."""
        lists = batch.column(1)
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        row, item = np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten())
        at = np.minimum(np.searchsorted(listed[:, 0], item), len(listed) - 1)
        df = np.where(listed[at, 0] == item, listed[at, 1], 0)
        order = np.lexsort((item, df, row))
        firsts = np.cumsum(n) - n
        return row, item[order], df[order], np.arange(len(item)) - firsts[row], n[row], np.ceil(threshold * n - 1e-9).astype(np.int64)[row], firsts

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.full(MARKS, none, np.uint8)
        for batch in batches:
            if batch.num_rows:
                _, item, _, pos, n, need, _ = ordered(batch)
                small = (need < most) & (pos <= n - need)
                np.minimum.at(own, item[small] & (MARKS - 1), np.minimum(need[small], none - 1).astype(np.uint8))
        mark = np.flatnonzero(own < none)
        yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(own[mark].astype(np.int32))], names=["mark", "need"])

    if sizes and np.ceil(threshold * sizes[0][0] - 1e-9) < most:
        marks = own.where(F.size("items") < F.lit(int(most / threshold) + 2)).select("id", "items").mapInArrow(marked, "mark bigint, need int").groupBy("mark").agg(F.min("need").alias("need")).toArrow()
        least[np.asarray(marks.column(0))] = np.asarray(marks.column(1))

    def spread(least: np.ndarray | None):  # noqa: ANN202
        """Items that probe, or with the marks' least needs those that are indexed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, item, df, pos, n, need, firsts = ordered(batch)
                # One bit of 128 for each item: what a set has of them and another lacks, it lacks as items.
                bit = np.left_shift(np.int64(1), item & 63)
                marks = [np.bitwise_or.reduceat(np.where((item >> 6) & 1 == half, bit, 0), firsts) for half in (0, 1)]
                left = n - pos  # items from here on
                kept = left >= need if least is None else (left >= most) | ((own := least[item & (MARKS - 1)]) < none) & (left >= own)
                kept = np.flatnonzero(kept)
                row = row[kept]
                rows = [pa.array(c) for c in (item[kept], n[kept], need[kept], np.maximum(-(-df[kept] // hot), 1), marks[0][row], marks[1][row])]
                again = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), *rows, *(c.take(again) for c in batch.columns[2:])], names=["id", "item", "n", "need", "parts", "m", "w", *batch.schema.names[2:]])

        return run

    kinds = f"id {id_type}, item bigint, n bigint, need bigint, parts bigint, m bigint, w bigint, side {own.schema['side'].dataType.simpleString()}" + (f", groups {own.schema['groups'].dataType.simpleString()}" if groups else "")
    each = lambda least: own.select("id", "items", "side", *(["groups"] if groups else [])).mapInArrow(spread(least), kinds)
    # An item that very many sets hold is dealt out by salt: those that probe it look into each part.
    probe = each(None).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    index = each(least).withColumn("salt", F.pmod(F.xxhash64("id"), "parts"))
    keyed = lambda f: (f.withColumn("g", F.explode("groups")) if groups else f.withColumn("g", F.lit(""))).withColumn("key", F.xxhash64("item", "salt", "g"))
    probe = keyed(probe).select("key", F.col("id").alias("a"), F.col("n").alias("na"), "need", F.col("m").alias("ma"), F.col("w").alias("wa"), *([F.col("side").alias("sa")] if side else []))
    index = keyed(index).select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("w").alias("wb"), *([F.col("side").alias("sb")] if side else []))
    # Candidates that lack too much are dropped where they meet, before anything is shuffled.
    lacks = F.bit_count(F.expr("ma & ~mb")) + F.bit_count(F.expr("wa & ~wb"))
    met = probe.join(index, "key").where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (lacks <= F.col("na") - F.col("need")))
    if side:
        met = met.where("sa <> sb")
    met = met.select("a", "b").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    chosen = sets.join(within_bound(met.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    # They meet by hashes; what is counted are the items themselves, in a shared group if there are groups.
    of = lambda c: chosen.select(F.col("id").alias(c), F.col("items").alias(f"i{c}"), *([F.col(groups).alias(f"g{c}")] if groups else []), *(F.col(x).alias(f"{c}_{x}") for x in carried))
    counted = met.join(of("a"), "a").join(of("b"), "b")
    if groups:
        counted = counted.where(F.arrays_overlap("ga", "gb"))
    return counted.select("a", "b", (F.size(F.array_intersect("ia", "ib")) / F.size("ia")).alias("shared"), *(f"{c}_{x}" for c in "ab" for x in carried)).where(F.col("shared") >= threshold)


def canonical(edges: DataFrame, nodes: DataFrame, rounds: int = 200) -> DataFrame:
    """Greedy scan in order: (id, duplicate_of), null for rows that stay.

    ``edges``: (i, j), i before j.  A row stays if no earlier neighbour stays, and else repeats the earliest that does:
    rows are decided in rounds, each once its earlier neighbours are.  ``nodes``: id.
    """
    links = checkpointed(edges.select("i", "j").where("i < j").distinct())
    state = checkpointed(nodes.select("id").join(links.select(F.col("j").alias("id")).distinct(), "id", "left_semi").withColumn("stays", F.lit(None).cast("boolean")).withColumn("of", F.lit(None).cast(nodes.schema["id"].dataType)))
    for _ in range(rounds):
        before = links.join(state.select(F.col("id").alias("j"), F.col("stays").alias("own")), "j").where("own is null")
        known = before.join(state.select(F.col("id").alias("i"), F.col("stays").alias("s"), F.lit(True).alias("listed")), "i", "left")
        # A row that is nobody's later neighbour stays.
        stays = F.when(F.col("listed").isNull(), F.lit(True)).otherwise(F.col("s"))
        each = known.groupBy("j").agg(F.min(F.when(stays, F.col("i"))).alias("of"), F.count_if(stays.isNull()).alias("open"), F.min(F.when(stays.isNull(), F.col("i"))).alias("first_open"))
        decided = each.where((F.col("open") == 0) | (F.col("of") < F.col("first_open"))).select(F.col("j").alias("id"), F.col("of").alias("new_of"), F.lit(True).alias("now"))
        state = checkpointed(
            state.join(decided, "id", "left").select("id", F.when(F.coalesce("now", F.lit(False)), F.col("new_of").isNull()).otherwise(F.col("stays")).alias("stays"), F.coalesce("of", "new_of").alias("of"))
        )
        if state.where("stays is null").isEmpty():
            break
    else:
        raise RuntimeError("the scan did not end")
    return nodes.select("id").join(state.select("id", F.col("of").alias("duplicate_of")), "id", "left")
