import random

import pytest

from sievewright.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int, note string"


def rows(n=900, seed=1):
    r = random.Random(seed)
    return [(i, r.choices(["a", "b", "c", "z"], [60, 30, 3, 7])[0], r.choice(["en", "de", None]), r.choice(["x", "y", None]), r.choice([0, 5, 20, 80, 900, None]), "n") for i in range(n)]


SCHEMA = "doc_id bigint, source string, lang string, topic string, tokens bigint, factor string"


def test_shares_are_reached_within_the_caps(spark):
    targets = spark.createDataFrame([("a", 0.5, 1, "n"), ("b", 0.3, 2, "n"), ("c", 0.1, 4, "n"), ("missing", 0.1, 3, "n")], TARGETS)
    uses = M.mix(spark.createDataFrame(rows(), SCHEMA), targets)
    report = {r.source: r for r in M.mix_report(uses, targets).collect()}
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert report[s].share == pytest.approx(share, abs=0.01)
        assert report[s].most_uses <= report[s].max_repeats
    assert report["missing"].tokens_used == 0 and report["missing"].share == 0
    assert {r.source for r in uses.select("source").distinct().collect()} == {"a", "b", "c"}
    assert uses.where("tokens = 0 and uses > 0").count() == 0


def test_plan_beyond_the_caps():
    plan = M.planned_sources({"a": 100, "b": 100, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 9}, 300)
    assert plan == {"a": 100.0, "b": 200.0}
    assert M.planned_sources({}, {"a": 1.0}, {"a": 1}, None) == {}


def test_raking_meets_all_marginals():
    cells = {("a", "en", "x"): 60, ("a", "de", "x"): 40, ("b", "en", "x"): 50, ("b", "de", "y"): 50}
    factors = M.rake(cells, {"a": 60.0, "b": 60.0}, {"a": 9, "b": 9}, languages={"en": 0.5, "de": 0.5})
    used = {c: cells[c] * f for c, f in factors.items()}
    assert sum(v for c, v in used.items() if c[0] == "a") == pytest.approx(60)
    assert sum(v for c, v in used.items() if c[1] == "en") == pytest.approx(60, rel=1e-3)


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, None, "n"), ("b", None, 2, "n")], TARGETS)
    assert M.mix(spark.createDataFrame([], SCHEMA), targets).count() == 0
    uses = M.mix(spark.createDataFrame(rows(30), SCHEMA), targets)
    assert uses.agg({"uses": "sum"}).first()[0] == 0
    assert M.mix_report(uses, targets).count() == 2


def test_tempered_shares_and_their_report(spark):
    targets = spark.createDataFrame([("a", 0.6, 3, "n"), ("b", 0.4, 6, "n")], TARGETS)
    alike = [(*r[:4], 50 + i % 50, r[5]) for i, r in enumerate(rows(3000))]
    uses, wanted = M.mixed(spark.createDataFrame(alike, SCHEMA), targets, 300_000, languages=0.5, topics={"x": 0.5, "y": 0.3, "(none)": 0.2})
    got = {(r.marginal, r.value): r for r in M.marginals(uses, wanted).collect()}
    assert {k for k in got if k[0] != "source"} == {("language", v) for v in ("en", "de", "(none)")} | {("topic", v) for v in ("x", "y", "(none)")}
    for key, r in got.items():
        if r.target_share is not None:
            assert r.share == pytest.approx(r.target_share, abs=0.01), key
    assert sum(r.target_share for k, r in got.items() if k[0] == "language") == pytest.approx(1)
    assert got["source", "a"].share == pytest.approx(0.6, abs=1e-4)


def test_tempering_lifts_the_small():
    cells = {("a", "en", "x"): 81, ("a", "de", "x"): 9}
    assert M.tempered(cells, {"a": 90.0}, 1, 0.5) == pytest.approx({"en": 0.75, "de": 0.25})
    assert M.tempered(cells, {"a": 90.0}, 1, 1.0) == pytest.approx({"en": 0.9, "de": 0.1})
    assert M.tempered({}, {}, 1, 0.5) == {}
