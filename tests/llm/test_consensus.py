import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import consensus as C

SCHEMA = "review_id string, trace_id string, created_at string, reviewer string, status string, rating int, ingested_at timestamp, label string"


def test_latest_claim_counts(spark):
    rows = [
        ("r1", " T1 ", "2026-01-01T00:00:00Z", "Ann", "accepted", 5, None, "z"), ("r2", "t1", "2026-01-02 00:00:00", "ann ", "REJECTED", None, None, "z"), ("r2", "t1", "2026-01-02 00:00:00", "ann ", "REJECTED", None, None, "z"),
        ("r3", "t1", None, "bob", "unsafe", 1, None, "z"), ("r4", "t1", "2026-01-01T00:00:00+00:00", "bob", "not_reviewed", None, None, "z"), ("r5", None, "x", None, None, None, None, None), ("r6", "", "x", "cy", "accepted", 1, None, None),
    ]
    got = sorted((r.item, r.annotator, r.label, r.rating) for r in C.clean_reviews(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("t1", "ann", "rejected", None), ("t1", "bob", "unsafe", 1)]


def test_careful_reviewers_outweigh(spark):
    r = random.Random(4)
    truth = {f"t{i}": r.choice(C.LABELS) for i in range(400)}
    skill = {f"good{i}": 0.93 for i in range(5)} | {f"poor{i}": 0.25 for i in range(7)}
    claims = [(t, a, k if r.random() < skill[a] else r.choice(C.LABELS), r.choice([1, 3, None])) for t, k in truth.items() for a in r.sample(sorted(skill), 6)]
    items, contributors = C.truth_discovery(spark.createDataFrame(claims, "item string, annotator string, label string, rating int"))
    found = {x.item: x for x in items.collect()}
    votes = {}
    for t, _, k, _ in claims:
        votes.setdefault(t, []).append(k)
    majority = sum(max(C.LABELS, key=votes[t].count) == k for t, k in truth.items())
    right = sum(found[t].label == k for t, k in truth.items())
    assert right > majority
    assert right > 0.9 * len(truth)
    assert all(0 <= x.agreement <= 1 and x.annotators == 6 for x in found.values())
    trust = {x.annotator: x.reliability for x in C.annotator_reliability(contributors).collect()}
    assert min(trust[a] for a in trust if a.startswith("good")) > max(trust[a] for a in trust if a.startswith("poor"))


def test_ties_nulls_and_empty_table(spark):
    claims = spark.createDataFrame([("a", "x", "unsafe", None), ("a", "y", "rejected", None), ("b", "x", "accepted", None)], "item string, annotator string, label string, rating int")
    items, _ = C.truth_discovery(claims)
    got = {r.item: (r.label, r.rating) for r in items.collect()}
    assert got == {"a": ("rejected", None), "b": ("accepted", None)}
    items, contributors = C.truth_discovery(claims.limit(0))
    assert items.count() == 0 and C.annotator_reliability(contributors).count() == 0


def test_exact_quantiles():
    # from tables of the distribution at 0.025 and 0.975
    for n, low, high in ((1, 0.000982069, 5.02389), (2, 0.0506356, 7.37776), (10, 3.24697, 20.4832), (100, 74.2219, 129.561), (400, 346.482, 457.306)):
        assert abs(C.quantiles(np.array([n]), C.UPPER)[0] / low - 1) < 2e-4
        assert abs(C.quantiles(np.array([n]), C.LOWER)[0] / high - 1) < 2e-4


def test_quantiles_as_column(spark):
    got = spark.createDataFrame([(1,), (150,), (1_000,)], "n bigint").select(C.chi_squared(F.col("n")).alias("q")).collect()
    assert [r.q for r in got] == pytest.approx(C.quantiles(np.array([1, 150, 1_000]), C.UPPER).tolist())


def test_joins_give_the_same(spark, monkeypatch):
    r = random.Random(9)
    claims = [(f"t{i}", a, r.choice(C.LABELS) if r.random() < 0.4 else C.LABELS[i % 3], r.choice([1, 5, None])) for i in range(120) for a in r.sample("abcdefgh", 5)]
    frame = spark.createDataFrame(claims, "item string, annotator string, label string, rating int")
    plain = lambda found: sorted((x.item, x.label, x.annotators, round(x.agreement, 9), round(x.support, 9), x.rating and round(x.rating, 9)) for x in found[0].collect())
    whole = lambda found: sorted((x.annotator, x.label, x.claims, x.wrong, round(x.weight, 9)) for x in found[1].collect())
    one = C.truth_discovery(frame)
    monkeypatch.setattr(C, "GATHERED", 3)
    other = C.truth_discovery(frame)
    assert plain(one) == plain(other) and whole(one) == whole(other)


def test_a_circle_is_left():
    # errors depend on the weights so that full steps only swap them
    def errors(weights):
        first = weights[0] >= weights[1]
        return np.array([50, 50]), np.array([40, 2] if first else [2, 40])

    assert sorted(C.settled(errors, 2)[1].tolist()) == [2, 40]
    turns = iter(range(10**6))
    with pytest.raises(RuntimeError):
        C.settled(lambda w: (np.array([500]), np.array([next(turns) % 7])), 1)
    assert C.settled(lambda w: (np.array([5, 0]), np.array([1, 0])), 2)[1].tolist() == [1, 0]
