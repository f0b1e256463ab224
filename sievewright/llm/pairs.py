"""Steps that the near-duplicate operators share: classes of equal word sets,
sketch filter, exact check of candidates, expansion to members."""

from __future__ import annotations

from fractions import Fraction

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.words import FUNCTIONS, words_column
from sievewright.operators.lineage import checkpointed

#: Members of a class that one task pairs; a larger class is paired by blocks of it.
MEMBERS = 2_048
#: A side of a join with at most so many rows of two integers is broadcast (32 MB); a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
SKETCH = [f"s{i}" for i in range(FUNCTIONS // 64)]


def within_bound(frame: DataFrame, bound: int = BROADCAST_ROWS, cut: bool = False) -> DataFrame:
    """Persist a frame and mark it for broadcast if, counted, it keeps to the bound; else leave the join to shuffle it.

    ``cut``: checkpoint it instead.  The plan of a kept frame is written out wherever it is used, with all that it is made
    of, and twice while it adapts: frames kept within kept frames fill the driver's memory with their plans.
    """
    frame = checkpointed(frame) if cut else frame.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(frame) if frame.count() <= bound else frame


def enough(common: Column, left: Column, right: Column, threshold: float) -> Column:
    """common / (left + right - common) >= threshold, in integers."""
    t = Fraction(str(threshold))
    return (common * F.lit(t.denominator) >= (left + right - common) * F.lit(t.numerator)) & (common > 0)


def copies(features: DataFrame, *by: str) -> DataFrame:
    """(id, rep) of every row whose word set an earlier id has too; the first id of a set is its representative.

    Grouping is pre-aggregated, so a set that a third of all rows share is one row per map task.
    """
    key = ["h0", "h1", *by]
    many = features.groupBy(*key).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return features.select("id", *key).join(within_bound(many, cut=True), key).where("id <> rep").select("id", "rep")


def sketch_filter(pairs: DataFrame, features: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) whose whole fingerprints differ in at most ``radius`` bits."""
    side = lambda c: features.select(F.col("id").alias(c), *[F.col(s).alias(f"{c}_{s}") for s in SKETCH])
    apart = sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SKETCH), F.lit(0))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= radius).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs (a, b), those whose texts overlap by the threshold; with the overlap.  ``texts``: id, text."""
    pairs = checkpointed(pairs)
    wanted = within_bound(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), cut=True)
    words = texts.join(wanted, "id").select("id", words_column(F.col("text")).alias("w"))
    side = lambda c: words.select(F.col("id").alias(c), F.col("w").alias(f"w_{c}"))
    common = F.size(F.array_intersect("w_a", "w_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    n = joined.select("a", "b", common.alias("c"), F.size("w_a").alias("l"), F.size("w_b").alias("r"))
    return n.where(enough(F.col("c"), F.col("l"), F.col("r"), threshold)).select("a", "b", (F.col("c") / (F.col("l") + F.col("r") - F.col("c"))).alias("overlap"))


def expanded(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Links between representatives (a, b) as links between all their members.

    ``left`` and ``right``: copies (id, rep) of either side.
    """
    def members(frame: DataFrame, c: str, copy: DataFrame) -> DataFrame:
        more = copy.select(F.col("rep").alias(c), F.col("id").alias("m"))
        return frame.unionByName(frame.join(more, c).drop(c).withColumnRenamed("m", c))

    return members(members(links, "a", left), "b", right)


def within_classes(copy: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, among the members of each class, given as copies (id, rep).

    The pairs are m * m / 2 for m members, as asked for; members are dealt out to blocks, and each pair of blocks is a
    key of its own, so that no key has more than two blocks' rows.
    """
    member = copy.select("rep", "id").unionByName(copy.select("rep", F.col("rep").alias("id")).distinct()).persist(StorageLevel.MEMORY_AND_DISK)
    size = member.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks"))
    placed = member.join(size, "rep").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    lower = placed.select("rep", F.col("id").alias("x"), F.col("block").alias("p"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("q"))
    upper = placed.select("rep", F.col("id").alias("y"), F.explode(F.expr("sequence(0L, block)")).alias("p"), F.col("block").alias("q"))
    both = lower.join(upper, ["rep", "p", "q"]).where((F.col("p") < F.col("q")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
