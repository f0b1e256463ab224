"""Overlaps of all pairs of two sides that share a group, tile by tile, counted as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side in a tile, on average; larger groups are dealt out by the hash of the id.
SIDE = 4_096
#: Pairs that are weighed at once, and pairs of rows for each task to weigh.
STRIP, TASK = 1_000_000, 4_000_000
#: A value goes into the matrix product if that share of all pairs holds it on both sides; others are counted one by one.
DENSE = 0.03


def least_shared(threshold: float, most: int) -> np.ndarray:
    """For each size of the smaller set, up to most, the smallest number of shared values whose share reaches the threshold."""
    size = np.arange(most + 1)
    need = np.maximum(np.ceil(threshold * size).astype(np.int64), 1)
    for step in (-1, 1):  # the share is a rounded quotient, as it is where it is compared
        other = np.maximum(need + step, 1)
        fits = other / np.maximum(size, 1) >= threshold
        need = np.where(fits if step < 0 else need / np.maximum(size, 1) < threshold, other, need)
    need[0] = most + 1
    return need.astype(np.float32)


class Counts:
    """Numbers of values that rows of the left share with rows of the right; values are lists of strings, none repeated in one."""

    def __init__(self, values: pa.ListArray, left: np.ndarray, right: np.ndarray) -> None:
        flat = values.flatten()
        lengths = np.asarray(pc.fill_null(values.value_lengths(), 0))
        row = np.repeat(np.arange(len(lengths)), lengths)
        held = np.asarray(pc.fill_null(pc.not_equal(flat, ""), False))
        codes = np.asarray(flat.dictionary_encode().indices.fill_null(0))[held]
        row = row[held]
        sizes = np.bincount(row, minlength=len(lengths))
        self.left_sizes, self.right_sizes = sizes[left], sizes[right]
        self.most = int(sizes.max(initial=0))
        most = int(codes.max(initial=-1)) + 1
        place = np.full(len(lengths), -1)
        place[left], sided = np.arange(len(left)), np.zeros(len(lengths), bool)
        sided[left] = True
        place[right] = np.arange(len(right))
        on_left = sided[row]
        lrow, lcode, rrow, rcode = place[row[on_left]], codes[on_left], place[row[~on_left]], codes[~on_left]
        ldf, rdf = np.bincount(lcode, minlength=most), np.bincount(rcode, minlength=most)
        dense = ldf * rdf > DENSE * len(left) * len(right)
        column = np.cumsum(dense) - 1
        width = int(dense.sum())
        self.a, self.b = np.zeros((len(left), width), np.float32), np.zeros((width, len(right)), np.float32)
        at = dense[lcode]
        self.a[lrow[at], column[lcode[at]]] = 1
        at = dense[rcode]
        self.b[column[rcode[at]], rrow[at]] = 1
        # Rows of the right by value, and the other values of each row of the left.
        at = ~dense[rcode] & (ldf[rcode] > 0)
        order = np.argsort(rcode[at], kind="stable")
        self.listed, found = rrow[at][order], np.bincount(rcode[at], minlength=most)
        self.starts = np.concatenate([[0], np.cumsum(found)])
        at = ~dense[lcode] & (found[lcode] > 0)
        order = np.argsort(lrow[at], kind="stable")
        self.own, self.ends = lcode[at][order], np.concatenate([[0], np.cumsum(np.bincount(lrow[at], minlength=len(left)))])

    def strip(self, first: int, last: int) -> np.ndarray:
        got = self.a[first:last] @ self.b
        width = got.shape[1]
        for k in range(first, last):
            codes = self.own[self.ends[k] : self.ends[k + 1]]
            if len(codes):
                rows = np.concatenate([self.listed[self.starts[c] : self.starts[c + 1]] for c in codes])
                got[k - first] += np.bincount(rows, minlength=width)
        return got

    def needed(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        need = least_shared(threshold, self.most)
        return need[self.left_sizes][:, None], need[self.right_sizes][None, :]

    def smaller(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.minimum(self.left_sizes[left], self.right_sizes[right])


def reaches(counts: np.ndarray, need: tuple[np.ndarray, np.ndarray], first: int, last: int) -> np.ndarray:
    return counts >= np.minimum(need[0][first:last], need[1])


def thousandths(shared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Shares rounded half up to three digits, from whole numbers."""
    size = np.maximum(size, 1).astype(np.int64)
    return (2000 * shared.astype(np.int64) + size) // (2 * size) / 1000


def weighed(rows: DataFrame, keyword_threshold: float, text_threshold: float, high_keywords: float, high_text: float, counted: bool) -> DataFrame:
    """Pairs of rows (id, kw, tokens, dom, left, weak) of either side that share a domain and reach one threshold, each once.

    (x, y, rank, keyword_overlap, text_overlap), x of the left; or, if ``counted``, (id, n, rank) in parts: how many pairs
    a row is in and the highest rank.  Rank: 1 if one of both is weak, 3 if one of the high thresholds is reached, else 2.
    Each pair of a group's rows is weighed in one tile; pairs are streamed or counted there and candidates never written.
    """
    kept = rows.select("id", "kw", F.array_join("tokens", " ").alias("text"), "dom", "left", "weak").persist(StorageLevel.MEMORY_AND_DISK)
    each = kept.select("id", "kw", "text", "left", "weak", F.explode("dom").alias("g"), "dom").withColumn("lower", F.expr("filter(dom, d -> d < g)")).drop("dom")
    sizes = kept.select(F.explode("dom").alias("g"), "left").groupBy("g").agg(F.count_if("left").alias("p"), F.count_if(~F.col("left")).alias("n"))
    work = sizes.agg(F.sum(F.col("p").cast("double") * F.col("n")).alias("pairs")).first().pairs or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(round(work / TASK), 20_000))
    # Groups of more than one tile are at most as many as rows / SIDE.
    large = sizes.where(f"p > {SIDE} or n > {SIDE}").select("g", F.ceil(F.col("p") / SIDE).alias("cp"), F.ceil(F.col("n") / SIDE).alias("cn"))
    dealt = each.join(F.broadcast(large), "g", "left")
    whole = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("left"), whole("cp")).otherwise(whole("cn"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("left"), whole("cn")).otherwise(whole("cp")) - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    tile = F.concat_ws(":", F.when(F.col("left"), F.col("own")).otherwise(F.col("other")), F.when(F.col("left"), F.col("other")).otherwise(F.col("own")), "g")
    placed = dealt.select(tile.alias("tile"), "id", "kw", "text", "left", "weak", "lower").repartition(parts, "tile").sortWithinPartitions("tile")
    kind = rows.schema["id"].dataType.simpleString()

    def weigh(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        column = lambda name: t[name].chunk(0) if t.num_rows else t[name].combine_chunks()
        left = np.asarray(t["left"])
        p, n = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(p) or not len(n):
            return
        ids, weak = column("id"), np.asarray(t["weak"])
        weak_p, weak_n = weak[p][:, None], weak[n][None, :]
        any_weak = weak.any()
        k, x = Counts(column("kw"), p, n), Counts(pc.split_pattern(column("text"), " "), p, n)
        k_need, x_need, k_high, x_high = k.needed(keyword_threshold), x.needed(text_threshold), k.needed(high_keywords), x.needed(high_text)
        # A pair with several common domains counts in the tile of the smallest.
        lower = Counts(column("lower"), p, n)
        again_n = np.flatnonzero(lower.right_sizes)
        again_p = lower.left_sizes > 0 if len(again_n) else np.zeros(len(p), bool)
        n_p, n_n, top_p, top_n = np.zeros(len(p), np.int64), np.zeros(len(n), np.int64), np.zeros(len(p), np.int32), np.zeros(len(n), np.int32)
        step = max(1, STRIP // len(n))
        for first in range(0, len(p), step):
            last = min(first + step, len(p))
            ks, xs = k.strip(first, last), x.strip(first, last)
            hit = reaches(ks, k_need, first, last) | reaches(xs, x_need, first, last)
            if again_p[first:last].any():
                hit &= lower.strip(first, last) == 0
            high = hit & (reaches(ks, k_high, first, last) | reaches(xs, x_high, first, last))
            low = hit & (weak_p[first:last] | weak_n) if any_weak else None
            if counted:
                if low is not None:
                    high &= ~low
                plain = hit & ~high if low is None else hit & ~high & ~low
                for axis, number, top, at in ((1, n_p, top_p, slice(first, last)), (0, n_n, top_n, slice(None))):
                    number[at] += np.count_nonzero(hit, axis=axis)
                    rank = np.where(high.any(axis=axis), 3, np.where(plain.any(axis=axis), 2, 1))
                    top[at] = np.maximum(top[at], rank)
                continue
            at = np.flatnonzero(hit)
            a, b = np.divmod(at, len(n))
            rank = np.where(high.ravel()[at], 3, 2).astype(np.int32)
            if low is not None:
                rank[low.ravel()[at]] = 1
            a += first
            scores = [pa.array(thousandths(s.ravel()[at], c.smaller(a, b))) for s, c in ((ks, k), (xs, x))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(p[a])), ids.take(pa.array(n[b])), pa.array(rank), *scores], names=["x", "y", "rank", "keyword_overlap", "text_overlap"])
        if counted:
            for rows_, number, top in ((p, n_p, top_p), (n, n_n, top_n)):
                at = np.flatnonzero(number)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows_[at])), pa.array(number[at]), pa.array(top[at])], names=["id", "n", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            tiles = batch.column(0)
            if not len(tiles):
                continue
            ends = [*(np.flatnonzero(np.asarray(pc.not_equal(tiles[1:], tiles[:-1]))) + 1), len(tiles)]
            start = 0
            for end in ends:
                if held and tiles[start].as_py() != name:
                    yield from weigh(pa.Table.from_batches(held))
                    held = []
                name = tiles[start].as_py()
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from weigh(pa.Table.from_batches(held))

    return placed.mapInArrow(run, f"id {kind}, n bigint, rank int" if counted else f"x {kind}, y {kind}, rank int, keyword_overlap double, text_overlap double")
