"""Consensus of annotators who disagree: confidence-aware truth discovery.

An annotator's claims are taken apart by the label claimed, as an annotator may
be reliable with one label and not with another; such a pair is a contributor.
In turns, each item gets the label with the least weighted distance to its
claims, and each contributor the weight that follows from its distance to those
labels.  The weight is not taken from the error itself but from its upper bound,
sum of distances / chi-squared quantile at alpha / 2 with as many degrees of
freedom as it has claims: few claims make a wide bound, so that a contributor in
the long tail is not trusted for a lucky start.  With the bound u and K labels
the weight is log((1 - u)(K - 1) / u), and 0 where a contributor may be no
better than chance.  One whose error is surely worse than chance (by the lower
bound) speaks against the label that it claims, with a negative weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.pairs import within_bound
from sievewright.operators.lineage import checkpointed

#: Labels that an item may deserve, in the order in which ties are broken.
LABELS = ("accepted", "needs_correction", "rejected", "corrected", "unsafe")


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """(item, annotator, label, rating): of each annotator the latest claim on an item.

    Names and labels without outer blanks and case; labels outside ``LABELS`` (``not_reviewed``, null) do not count, nor
    do claims without item or annotator.  Later means created_at, then ingested_at, then review_id; unreadable times
    come first.  Repeated rows are one claim.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    when = F.col("created_at").cast("string")
    rows = reviews.select(
        plain("trace_id").alias("item"), plain("reviewer").alias("annotator"), plain("status").alias("label"), "rating",
        F.struct(F.coalesce(F.trim(when).try_cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("t"), "ingested_at", "review_id").alias("at"),
    ).where(F.col("label").isin(*LABELS) & (F.col("item") != "") & (F.col("annotator") != ""))
    last = rows.groupBy("item", "annotator").agg(F.max(F.struct("at", "label", "rating")).alias("x"))
    return last.select("item", "annotator", "x.label", "x.rating")


#: Annotators up to which an item's claims are gathered in one row.
GATHERED = 10_000
#: Turns after which it is an error that labels still change.
ROUNDS = 200
#: Normal quantiles of the upper and lower bound of an error (alpha 0.05), and degrees of freedom up to which chi-squared quantiles are exact.
UPPER, LOWER, EXACT = -1.959963984540054, 1.959963984540054, 200


def _gamma_share(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized lower incomplete gamma function, by its series."""
    from math import lgamma

    term = np.ones_like(x) / a
    total = term.copy()
    for k in range(1, 700):
        term = term * x / (a + k)
        total += term
    with np.errstate(divide="ignore"):
        return np.exp(a * np.log(x) - x - np.array([lgamma(v) for v in a])) * total


def _quantiles(z: float) -> np.ndarray:
    """Chi-squared quantiles at the normal quantile z for 1 to EXACT degrees of freedom, by bisection; that of 0 is 0."""
    from math import erf, sqrt

    share, a = (1 + erf(z / sqrt(2))) / 2, np.arange(1, EXACT + 1) / 2
    low, high = np.zeros(EXACT), np.full(EXACT, 1.5 * EXACT)
    for _ in range(80):
        middle = (low + high) / 2
        less = _gamma_share(a, middle / 2) < share
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return np.concatenate(([0.0], (low + high) / 2))


_TABLES: dict[float, np.ndarray] = {}


def quantile_table(z: float) -> np.ndarray:
    if z not in _TABLES:
        _TABLES[z] = _quantiles(z)
    return _TABLES[z]


def chi_squared(n: Column, z: float = UPPER) -> Column:
    """Quantile of the chi-squared distribution with n degrees of freedom: exact up to EXACT, by Wilson and Hilferty beyond."""
    a = F.lit(2.0) / (F.lit(9.0) * n)
    exact = F.array(*[F.lit(float(q)) for q in quantile_table(z)])
    return F.when(n <= EXACT, F.get(exact, n.cast("int"))).otherwise(n * F.pow(F.lit(1.0) - a + F.lit(z) * F.sqrt(a), F.lit(3.0)))


def quantiles(n: np.ndarray, z: float) -> np.ndarray:
    """``chi_squared`` of an array."""
    a = 2.0 / (9.0 * np.maximum(n, 1))
    return np.where(n <= EXACT, quantile_table(z)[np.minimum(n, EXACT)], n * (1 - a + z * np.sqrt(a)) ** 3)


def _weighed(claims: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bound of the error and weight of contributors."""
    odds = lambda e: np.log((1 - e) * (len(LABELS) - 1) / e)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.minimum((wrong + 0.5) / quantiles(claims, UPPER), 0.999)
        lower = np.minimum((wrong + 0.5) / quantiles(claims, LOWER), 0.98)
    return bound, np.where(odds(bound) > 0, odds(bound), np.where(odds(lower) < 0, odds(lower), 0.0))


def _labels(codes: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contributors and rows of the claims of a batch, their weights, and each row's label: the one of the largest weight, of equal ones the first."""
    code, sizes = np.asarray(codes.flatten()), np.diff(np.asarray(codes.offsets))
    row, k = np.repeat(np.arange(len(sizes)), sizes), len(LABELS)
    w = weights[code]
    total = np.bincount(row * k + code % k, w, len(sizes) * k).reshape(-1, k)
    return code, row, w, np.argmax(total >= total.max(axis=1, keepdims=True) - 1e-10, axis=1) if len(sizes) else np.zeros(0, np.int64)


def _errors(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims, wrong = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
        for batch in batches:
            code, row, _, truth = _labels(batch.column(0), weights)
            claims += np.bincount(code, minlength=len(weights))
            wrong += np.bincount(code[code % len(LABELS) != truth[row]], minlength=len(weights))
        some = np.flatnonzero(claims)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(claims[some]), pa.array(wrong[some])], names=["code", "claims", "wrong"])

    return run


def _results(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code, row, w, truth = _labels(batch.column(1), weights)
            right, trust = code % len(LABELS) == truth[row], np.maximum(w, 1e-6)
            rating = np.asarray(batch.column(2).flatten()).astype(np.float64)
            given = rating > -(2**31)
            many, trusted = np.bincount(row, minlength=n), np.bincount(row, trust, n)
            rated = np.bincount(row, trust * given, n)
            mean = np.divide(np.bincount(row, np.where(given, trust * rating, 0.0), n), rated, out=np.zeros(n), where=rated > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(LABELS, object)[truth], pa.string()), pa.array(many), pa.array(np.bincount(row, right, n) / np.maximum(many, 1)), pa.array(np.bincount(row, trust * right, n) / trusted), pa.array(mean, mask=rated <= 0)],
                names=["item", "label", "annotators", "agreement", "support", "rating"],
            )

    return run


def settled(errors: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], contributors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Claims, errors, bound and weight of contributors when labels no longer change; ``errors`` gives claims and errors under weights.

    If errors come back that were there before, labels go around in a circle; from then on a turn goes half of the way.
    """
    weights, seen, circle, before = np.ones(contributors), set(), False, None
    for _ in range(ROUNDS):
        claims, wrong = errors(weights)
        bound, new = _weighed(claims, wrong)
        state = wrong.tobytes()
        if state == before:
            return claims, wrong, bound, new
        circle |= state in seen
        seen.add(state)
        before = state
        new = new + 1e-6
        weights = (weights + new) / 2 if circle else new
    raise RuntimeError(f"labels still change after {ROUNDS} turns")


def truth_discovery(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consensus (item, label, agreement, support, annotators, rating) and contributors (annotator, label, claims, wrong, bound, weight).

    ``claims``: item, annotator, label, rating; an annotator claims once of an item.  ``agreement`` is the share of the item's
    annotators who gave the consensus label, ``support`` their share of the weight, ``rating`` the weighted mean of ratings.  Equal
    weights are decided by the order of ``LABELS``.  Null ratings are left out; an item of which no rating is known has none.  Of an
    empty table both results are empty.
    """
    claims = claims.select("item", "annotator", "label", "rating").persist(StorageLevel.MEMORY_AND_DISK)
    known = claims.select("annotator").distinct().limit(GATHERED + 1).collect()
    if len(known) > GATHERED:
        return _by_joins(claims)
    spark, names = claims.sparkSession, sorted(r[0] for r in known)
    numbers = spark.createDataFrame([(a, i * len(LABELS)) for i, a in enumerate(names)], "annotator string, first int")
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")).cast("int") - 1
    coded = claims.join(F.broadcast(numbers), "annotator").select("item", F.struct((F.col("first") + place).alias("c"), F.coalesce(F.col("rating").cast("int"), F.lit(-(2**31))).alias("r")).alias("x"))
    gathered = coded.groupBy("item").agg(F.sort_array(F.collect_list("x")).alias("x")).select("item", F.col("x.c").alias("codes"), F.col("x.r").alias("ratings")).persist(StorageLevel.MEMORY_AND_DISK)
    size = len(names) * len(LABELS)

    def errors(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = gathered.select("codes").mapInArrow(_errors(weights), "code bigint, claims bigint, wrong bigint").groupBy("code").agg(F.sum("claims"), F.sum("wrong")).collect()
        out = np.zeros((2, size), np.int64)
        for code, n, m in rows:
            out[:, code] = n, m
        return out[0], out[1]

    many, wrong, bound, weight = settled(errors, size)
    listed = [(names[c // len(LABELS)], LABELS[c % len(LABELS)], int(many[c]), int(wrong[c]), float(bound[c]), float(weight[c])) for c in np.flatnonzero(many)]
    contributors = spark.createDataFrame(listed, "annotator string, label string, claims bigint, wrong bigint, bound double, weight double")
    return gathered.mapInArrow(_results(weight + 1e-6), "item string, label string, annotators bigint, agreement double, support double, rating double"), contributors


def _by_joins(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``truth_discovery`` for very many annotators: every turn joins claims with weights; sums per item are pre-aggregated."""
    others = F.lit(float(len(LABELS) - 1))

    def decided(weights: DataFrame | None) -> DataFrame:
        """Claims with their weight and their item's label."""
        rows = claims.withColumn("w", F.lit(1.0)) if weights is None else claims.join(within_bound(weights.select("annotator", "label", "used")), ["annotator", "label"], "left").withColumn("w", F.coalesce("used", F.lit(0.0)))
        rows = rows.select("item", "annotator", "label", "rating", "w")
        totals = rows.groupBy("item").agg(*[F.sum(F.when(F.col("label") == k, F.col("w")).otherwise(0.0)).alias(f"w_{i}") for i, k in enumerate(LABELS)])
        best = F.greatest(*[F.col(f"w_{i}") for i in range(len(LABELS))])
        chosen = F.lit(LABELS[-1])
        for i in range(len(LABELS) - 2, -1, -1):
            chosen = F.when(F.col(f"w_{i}") >= best - 1e-10, LABELS[i]).otherwise(chosen)
        return rows.join(totals.select("item", chosen.alias("truth")), "item")

    def weighed(rows: DataFrame) -> DataFrame:
        each = rows.groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("label") != F.col("truth")).alias("wrong"))
        bound = F.least((F.col("wrong") + 0.5) / chi_squared(F.col("claims")), F.lit(0.999))
        lower = F.least((F.col("wrong") + 0.5) / chi_squared(F.col("claims"), LOWER), F.lit(0.98))
        odds = lambda e: F.log((1 - e) * others / e)
        weight = F.when(odds(bound) > 0, odds(bound)).when(odds(lower) < 0, odds(lower)).otherwise(0.0)
        return each.withColumn("bound", bound).withColumn("weight", weight).withColumn("used", weight + 1e-6)

    weights, seen, circle, before = None, set(), False, None
    for _ in range(ROUNDS):
        new = weighed(decided(weights))
        if circle:
            old = weights.select("annotator", "label", F.col("used").alias("old"))
            new = new.join(old, ["annotator", "label"]).withColumn("used", (F.col("used") + F.col("old")) / 2).drop("old")
        weights = checkpointed(new)
        now = tuple(weights.agg(F.sum("wrong"), F.sum(F.xxhash64("annotator", "label", "wrong").cast("decimal(38,0)"))).first())
        if now == before:
            break
        circle |= now in seen
        seen.add(now)
        before = now
    else:
        raise RuntimeError(f"labels still change after {ROUNDS} turns")
    rows = decided(weights.withColumn("used", F.col("weight") + 1e-6))
    right, trust = F.col("label") == F.col("truth"), F.greatest("w", F.lit(1e-6))
    consensus = rows.groupBy("item", F.col("truth").alias("label")).agg(
        F.count(F.lit(1)).alias("annotators"),
        F.avg(right.cast("double")).alias("agreement"),
        F.try_divide(F.sum(F.when(right, trust).otherwise(0.0)), F.sum(trust)).alias("support"),
        F.try_divide(F.sum(F.when(F.col("rating").isNotNull(), trust * F.col("rating"))), F.sum(F.when(F.col("rating").isNotNull(), trust))).alias("rating"),
    )
    return consensus, weights.drop("used")


def annotator_reliability(contributors: DataFrame) -> DataFrame:
    """Per annotator: claims, claims against the consensus, share of agreement, upper bound of the error, mean weight of a claim."""
    each = contributors.groupBy("annotator").agg(F.sum("claims").alias("claims"), F.sum("wrong").alias("wrong"), (F.sum(F.col("weight") * F.col("claims")) / F.sum("claims")).alias("weight"))
    bound = F.least((F.col("wrong") + 0.5) / chi_squared(F.col("claims")), F.lit(1.0))
    return each.select("annotator", "claims", "wrong", (1 - F.col("wrong") / F.col("claims")).alias("reliability"), bound.alias("error_bound"), "weight")
