import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import near_duplicates as N
from sievewright.llm.components import components
from sievewright.llm import cross_split as C
from sievewright.llm import pairs as P
from sievewright.llm.cross_split import block_codes, cross_split_pairs, leakage_report

WORDS = re.compile(r"[^\W_]+")


def corpus(n=150, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.5:
            words = r.choice(texts).split()
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                r.shuffle(words)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(20, 60))))
    return texts


def overlaps(texts, left, right, threshold=0.7):
    sets = {i: frozenset(WORDS.findall((t or "").lower())) for i, t in texts.items()}
    out = set()
    for i in left:
        for j in right:
            if i != j:
                a, b = sets[i], sets[j]
                if (a or b) and len(a & b) * 10 >= threshold * 10 * len(a | b):
                    out.add((min(i, j), max(i, j)))
    return out


def test_pairs_equal_brute_force(spark):
    texts = dict(enumerate(corpus()))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "id bigint, text string, a string, rep int")
    got = {(r.a, r.b) for r in N.near_duplicate_pairs(frame).collect()}
    assert got == overlaps(texts, texts, texts)
    assert len(got) > 30


def test_pairs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "!!"), (5, "Ünï cödé"), (6, "ÜNÏ CÖDÉ"), (7, "one"), (8, "a b " * 20_000), (9, "b a"), (9, "b a"), (None, "one"), (10, "one")]
    frame = spark.createDataFrame(rows, "id bigint, text string")
    got = sorted((r.a, r.b) for r in N.near_duplicate_pairs(frame).distinct().collect())
    # Empty texts are equal texts; the null one counts as empty.
    assert got == [(1, 2), (3, 4), (5, 6), (7, 10), (8, 9)]
    assert N.near_duplicate_pairs(frame.limit(0)).count() == 0


def test_many_copies_and_near_copies(spark):
    base = " ".join(f"k{i}" for i in range(50))
    texts = {i: base for i in range(60)} | {100 + i: base + f" extra{i}" for i in range(60)}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {(r.a, r.b) for r in N.near_duplicate_pairs(frame).collect()}
    assert got == overlaps(texts, texts, texts)
    groups = N.near_duplicate_groups(frame).collect()
    assert {r.group_id for r in groups} == {0}
    assert {r.copies for r in groups if r.id < 100} == {60}
    assert {r.links for r in groups if r.id < 100} == {60}


def test_long_runs_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "HELD", 40)
    base = " ".join(f"k{i}" for i in range(80))
    texts = {i: base + f" extra{i}" for i in range(70)}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string").coalesce(1)
    assert {(r.a, r.b) for r in N.near_duplicate_pairs(frame).collect()} == overlaps(texts, texts, texts)


@pytest.mark.parametrize("block", [2048, 32])
def test_dense_group_of_distinct_variants(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(11)
    texts = {}
    for i in range(400):
        words = [f"k{j}" for j in range(50)]
        for j in r.sample(range(50), 4):
            words[j] = f"v{i}x{j}"
        texts[i] = " ".join(words)
    true = overlaps(texts, texts, texts)
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {(x.a, x.b) for x in N.near_duplicate_pairs(frame).collect()}
    assert len(true) > 50_000
    assert got <= true
    assert len(got) >= 0.97 * len(true)


def test_neighbours_share_a_prefix():
    keys = np.array([0, 1, 1 << N.PREFIX_SHIFT, (1 << N.PREFIX_SHIFT) + 1], np.int64)
    a, b, long = N.neighbour_pairs(keys, np.arange(4), np.zeros(4, np.int64))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (2, 3)]
    assert len(long) == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(1, 40)], [(1, i) for i in range(2, 50)], []])
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.id: r.component for r in components(frame).collect()} == {x: root(x) for x in list(parent)}


def test_cross_split_equals_brute_force(spark):
    texts = dict(enumerate(corpus(200, 5)))
    train = {i for i in texts if i % 5}
    rows = [(i, t, i in train, "codes") for i, t in texts.items()]
    frame = spark.createDataFrame(rows, "id bigint, text string, train boolean, h0 string")
    pairs = cross_split_pairs(frame)
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()}
    assert got == overlaps(texts, set(texts) - train, train)
    assert len(got) > 20


@pytest.mark.parametrize("hot", [20_000, 20])
def test_cross_split_recall_in_a_dense_family(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT", hot)
    r = random.Random(12)
    texts = {}
    for i in range(400):
        words = [f"k{j}" for j in range(50)]
        for j in r.sample(range(50), 4):
            words[j] = f"v{i}x{j}"
        texts[i] = " ".join(words)
    train = {i for i in texts if i % 5}
    true = overlaps(texts, set(texts) - train, train)
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in cross_split_pairs(spark.createDataFrame([(i, t, i in train) for i, t in texts.items()], "id bigint, text string, train boolean")).collect()}
    assert len(true) > 10_000
    assert got <= true
    assert len(got) >= 0.97 * len(true)


def test_cross_split_recall_of_thin_pairs_at_the_threshold(spark):
    texts = {}
    for i in range(400):
        words = [f"t{i}x{j}" for j in range(47)]
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join([f"o{i}x{j}" for j in range(8)] + words[8:])  # overlap 39 / 55 = 0.709
    frame = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in texts.items()], "id bigint, text string, train boolean")
    got = {(r.a, r.b) for r in cross_split_pairs(frame).collect()}
    assert got <= {(2 * i + 1, 2 * i) for i in range(400)}
    assert len(got) >= 0.96 * 400


def test_hot_codes_are_those_of_many_training_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 10)
    rows = [(i, [7, 100 + i]) for i in range(100)]
    found = C.hot_codes(spark.createDataFrame(rows, "id bigint, codes array<bigint>"), 100)
    assert [tuple(r) for r in found.collect()] == [(7, 10)]
    assert C.hot_codes(spark.createDataFrame(rows[:9], "id bigint, codes array<bigint>"), 9) is None


def test_pairs_within_large_classes(spark, monkeypatch):
    monkeypatch.setattr(P, "MEMBERS", 4)
    rows = [(i, 0) for i in range(1, 20)] + [(31, 30)]
    got = sorted((r.a, r.b) for r in P.within_classes(spark.createDataFrame(rows, "id bigint, rep bigint")).collect())
    assert got == sorted([(i, j) for i in range(20) for j in range(i + 1, 20)] + [(30, 31)])


def test_cross_split_odd_rows(spark):
    rows = [(1, None, True), (2, "", False), (3, "x y z", True), (4, "X, y z!", None), (5, "x y z", False), (6, "x y z", True), (None, "x y z", True)]
    frame = spark.createDataFrame(rows, "id bigint, text string, train boolean")
    pairs = cross_split_pairs(frame)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(2, 1), (4, 3), (4, 6), (5, 3), (5, 6)]
    assert cross_split_pairs(frame.limit(0)).count() == 0
    assert cross_split_pairs(frame.where("train")).count() == 0
    held = frame.where("not coalesce(train, false)").select("id", F.lit("test").alias("split"), F.lit(None).cast("string").alias("source"))
    report = leakage_report(held, pairs).collect()
    assert [(r.source, r.rows, r.same, r.almost, r.leaked) for r in report] == [("(none)", 3, 3, 0, 3)]


def test_codes_agree_with_the_power_of_the_overlap():
    r = np.random.default_rng(1)
    values = r.integers(0, 2**32, (4_000, 256), dtype=np.uint32)
    other = np.where(r.random(values.shape) < 0.7, values, r.integers(0, 2**32, values.shape, dtype=np.uint32))
    same = block_codes(values) == block_codes(other)
    assert abs(same.mean() - 0.701**5) < 0.01
    assert 0.98 < same.any(axis=1).mean() < 0.995
