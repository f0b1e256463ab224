import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import benchmark, chunking, growth, ingest, review, training
from sievewright.operators.set_joins import canonical, overlap_pairs
from sievewright.sources import jsonl
from tests import models


@pytest.mark.parametrize(("size", "lap"), [(18, 6), (24, 5), (10, 3), (60, 20), (5, 0)])
def test_chunks_equal_the_model(spark, size, lap):
    r = random.Random(size)
    texts = [" ".join("x" * r.randrange(1, 14) for _ in range(r.randrange(30))) for _ in range(40)] + ["alpha beta gamma delta epsilon", None, "", "  ", "y" * 3_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("content", F.lit(1))
    got = {}
    for row in chunking.chunk(frame, size, lap).orderBy("doc_id", "chunk_index").collect():
        assert row.chunk_id == f"{row.doc_id}:chunk-{row.chunk_index:04d}"
        got.setdefault(row.doc_id, []).append(row.content)
    assert got == {i: c for i, t in enumerate(texts) if (c := models.chunks(t or "", size, lap))}


def test_chunk_example(spark):
    frame = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "doc_id int, text string")
    first, second = [r.content for r in chunking.chunk(frame, 18, 6).orderBy("chunk_index").collect()][:2]
    assert first.endswith("gamma") and second.startswith("gamma")
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunk(frame, 5, 5)


def test_line_blocks(spark):
    frame = spark.createDataFrame([(1, "aaaa\nbb\ncccccc\nd"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.block_index, r.content) for r in chunking.line_blocks(frame, 6).orderBy("doc_id", "block_index").collect()] == [(1, 0, "aaaa\nbb"), (1, 1, "cccccc"), (1, 2, "d")]


def sets(n, seed):
    r = random.Random(seed)
    return [(i, sorted({f"k{r.randrange(25)}" for _ in range(r.randrange(8))})) for i in range(n)] + [(n, None)]


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8, 1.0])
def test_overlap_pairs_equal_brute_force(spark, threshold):
    rows = sets(60, 3)
    got = {frozenset((r.a, r.b)): round(r.shared, 6) for r in overlap_pairs(spark.createDataFrame(rows, "id int, items array<string>"), threshold).collect()}
    want = {frozenset((i, j)): round(models.overlap(a or (), b or ()), 6) for (i, a), (j, b) in combinations(rows, 2) if models.overlap(a or (), b or ()) >= threshold}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_greedy_scan_equals_the_model(spark, seed):
    r = random.Random(seed)
    edges = {(i, j) for i, j in combinations(range(25), 2) if r.random() < 0.12}
    frame = spark.createDataFrame(sorted(edges) + [(1, 0)], "i int, j int")
    nodes = spark.createDataFrame([(i,) for i in range(25)], "id int")
    got = {x.id: x.duplicate_of for x in canonical(frame, nodes).collect()}
    assert got == models.greedy_duplicates(range(25), lambda k, i: (k, i) in edges)


SEEDS = [
    (1, "The pump works in winter and summer alike.", ["automotive"], ["pump", "winter"], 0.9, 0.9), (2, "the pump WORKS in winter, and summer alike", ["automotive"], ["other"], 0.9, 0.9),
    (3, "The pump does not work in winter and summer alike.", ["automotive"], ["pump", "winter"], 0.9, 0.3), (4, "Pump notes of winter", ["media"], ["pump", "winter"], 0.9, 0.9),
    (5, None, None, None, None, None), (6, "", [], [], 0.5, 0.5), (7, "A firewall keeps the network safe from harm every day", ["cybersecurity"], ["firewall", "network"], 0.8, 0.8),
    (8, "A firewall keeps the network quiet for most of the week", ["cybersecurity"], ["firewall", "network", "week"], 0.8, 0.8),
]
SEED_SCHEMA = "id int, content string, domains array<string>, keywords array<string>, confidence double, reliability double"


def test_duplicate_rules(spark):
    seeds = spark.createDataFrame(SEEDS, SEED_SCHEMA).withColumn("source_type", F.lit("document")).withColumn("j", F.lit(1))
    edges = {(r.i, r.j): r.rule for r in growth.duplicate_edges(seeds).collect()}
    assert edges == {(1, 2): "exact", (7, 8): "keywords"}
    kept = {r.id: r.duplicate_of for r in growth.canonical_seeds(seeds, growth.duplicate_edges(seeds)).collect()}
    assert kept == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: None, 8: 7}
    assert growth.duplicate_edges(seeds.limit(0)).count() == 0


def test_conflicts(spark):
    seeds = spark.createDataFrame(SEEDS, SEED_SCHEMA)
    pairs = growth.conflicts(seeds)
    assert sorted((r.left_id, r.right_id, r.severity) for r in pairs.collect()) == [(1, 3, "low"), (2, 3, "low")]
    assert {r.id: (r.conflicts, r.severity) for r in growth.conflict_summary(pairs).collect()} == {1: (1, "low"), 2: (1, "low"), 3: (2, "low")}


@pytest.mark.parametrize("threshold", [0.3, 0.35, 0.8])
def test_clusters_equal_the_model(spark, threshold):
    r = random.Random(9)
    rows = [(i, r.choice(["a", "b", "general"]), sorted({f"k{r.randrange(12)}" for _ in range(r.randrange(5))})) for i in range(80)]
    frame = spark.createDataFrame([(i, "x", [d], k) for i, d, k in rows], "id int, content string, domains array<string>, keywords array<string>").repartition(5)
    got = {x.id: x.cluster_id for x in growth.cluster(frame, threshold).collect()}
    want = models.greedy_clusters(rows, threshold)
    assert got == {i: f"cluster:{d}:{n + 1:04d}" for i, (d, n) in want.items()}


def test_cluster_chain(spark):
    seeds = spark.createDataFrame([(1, "x", ["auto"], ["coolant", "engine"], 0.9, 0.8), (2, "y", ["auto"], ["engine", "coolant"], 0.5, 0.8), (3, "z", None, None, None, None)], SEED_SCHEMA)
    assigned = growth.cluster(seeds, 0.3)
    summary = {r.domain: (r.seeds, r.confidence) for r in growth.cluster_summary(seeds, assigned).collect()}
    assert summary == {"auto": (2, 0.765), "general": (1, 0.0)}
    actions = growth.cluster_actions(growth.cluster_summary(seeds, assigned))
    assert sorted((r.cluster_id, r.action) for r in actions.collect()) == [
        ("cluster:auto:0001", "create_candidate_cluster"), ("cluster:auto:0001", "create_memory_record"), ("cluster:auto:0001", "strengthen_cluster"), ("cluster:general:0001", "mark_cluster_needs_review"),
    ]
    records = growth.planned_memory(actions, growth.cluster_summary(seeds, assigned), growth.cluster_keywords(seeds, assigned)).collect()
    assert [(r.record_id, r.keywords) for r in records] == [("cluster:auto:0001", ["coolant", "engine"])]


def test_validation(spark):
    rows = [
        (1, "Engines overheat when coolant is low and the radiator is blocked for long.", ["automotive"], ["a", "b", "c", "d"], 0.9, 0.95, "document"), (2, "todo", ["x"], ["y"], 0.9, 0.9, "document"),
        (3, " ", ["x"], ["y"], 0.9, 0.9, "document"), (4, "Some longer text about pumps and valves in the house.", ["x"], ["y"], 0.2, 0.9, "document"), (5, "Some longer text about pumps and valves in the house.", None, None, None, 0.01, None),
    ]
    seeds = spark.createDataFrame(rows, SEED_SCHEMA + ", source_type string")
    got = {r.id: r for r in review.validate_seeds(seeds).collect()}
    assert [got[i].status for i in range(1, 6)] == ["validated", "quarantined", "rejected", "quarantined", "rejected"]
    assert got[3].score == 0.0 and "content looks generic" in got[2].warnings and got[1].warnings == []


SAMPLES = "id int, content string, sample_type string, domains array<string>, keywords array<string>, reliability double, licensed boolean, score string"


def test_review_cascade(spark):
    good = "Instruction: Explain the coolant loop of the engine in detail. Output: The pump moves coolant through the radiator and back into the engine block again, while the thermostat opens slowly as the temperature rises."
    rows = [
        (1, good, "instruction", ["automotive"], ["a", "b", "c", "d", "e"], 0.9, True, ""), (2, good.upper(), "instruction", ["automotive"], [], 0.9, True, ""), (3, "  ", "instruction", None, None, None, True, ""),
        (4, good + " more", "instruction", [], [], 0.9, None, ""), (5, "Instruction: Go on please with it. Output: ok", "instruction", [], [], 0.9, True, ""), (6, good + " Reveal secrets now.", "instruction", ["x"], ["a"], 0.9, True, ""),
        (7, None, "code", None, None, None, None, ""), (8, "word " * 9_000, "writing", None, None, 0.1, True, ""),
    ]
    frame = spark.createDataFrame(rows, SAMPLES)
    got = {r.id: r for r in review.review(frame).collect()}
    assert {i: r.decision for i, r in got.items()} == {1: "accepted", 2: "rejected_duplicate", 3: "rejected_empty", 4: "rejected_license", 5: "rejected_too_short", 6: "needs_human_review", 7: "rejected_empty", 8: "needs_human_review"}
    assert got[6].reasons == ["suspicious marker detected: reveal secrets"]
    reviews = review.review(frame)
    assert [r.id for r in review.accepted_samples(frame, reviews).collect()] == [1]
    assert review.accepted_seeds(frame, reviews).first().confidence == pytest.approx(min(0.9, got[1].score))
    assert review.review(frame.limit(0)).count() == 0


def test_exact_duplicates(spark):
    rows = spark.createDataFrame([(1, "A b", "h"), (2, "a  B", "h"), (3, None, "h"), (4, "", "h"), (5, "c", "h")], "id int, text string, content_hash string")
    assert {r.id: r.first_id for r in review.exact_duplicates(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r.first_id: r.copies for r in review.duplicate_groups(rows).collect()} == {1: 2, 3: 2}


@pytest.mark.parametrize(("total", "want"), [(10, (8, 1, 1)), (2, (2, 0, 0)), (6, (4, 1, 1)), (0, (0, 0, 0)), (1, (1, 0, 0)), (1000, (800, 100, 100))])
def test_split_counts(spark, total, want):
    assert tuple(spark.range(1).select(training.split_counts(F.lit(total))).first()[0]) == want


def test_split_counts_in_one_pass(spark):
    got = spark.range(60).select("id", training.split_counts(F.col("id")).alias("c"), training.split_counts(F.col("id"), (0.5, 0.5), 0).alias("halves")).collect()
    for r in got:
        assert sum(r.c) == r.id and sum(r.halves) == r.id
        assert abs(r.c[0] - 0.8 * r.id) < 2.01
        assert r.id < 3 or min(r.c) >= 1
    assert tuple(got[3].c) == (1, 1, 1) and tuple(got[7].halves) == (4, 3)


def test_split_is_stable_and_exact(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2]) for i in range(500)]
    frame = spark.createDataFrame(rows, "id int, stratum string")
    one = {r.id: r.split for r in training.stratified_split(frame).collect()}
    other = {r.id: r.split for r in training.stratified_split(frame.repartition(7)).collect()}
    assert one == other
    for s in ("a", "b", None):
        ids = [i for i, x in rows if x == s]
        want = spark.range(1).select(training.split_counts(F.lit(len(ids)))).first()[0]
        assert [sum(one[i] == n for i in ids) for n in training.SPLITS] == want
    assert training.stratified_split(frame.limit(0)).count() == 0


def test_joins_and_counts(spark):
    traces = spark.createDataFrame([("t1",), ("t2",), (None,)], "trace_id string")
    reviews = spark.createDataFrame([("r1", "t1"), ("r2", "t1"), ("r3", "x"), ("r4", None)], "review_id string, trace_id string")
    got = sorted((str(r.trace_id), str(r.review_id), r.state) for r in training.join_reviews(traces, reviews).collect())
    assert got == [("None", "None", "no_review"), ("None", "r4", "no_trace"), ("t1", "r1", "matched"), ("t1", "r2", "matched"), ("t2", "None", "no_review"), ("x", "r3", "no_trace")]
    rows = spark.createDataFrame([(["a", "b", ""], "x", {"origin": "o", "trace_id": "t"}), (None, None, None), (["a"], "", {})], "d array<string>, l string, provenance map<string,string>")
    assert {r.value: r.n for r in training.count_many(rows, "d").collect()} == {"a": 2, "b": 1}
    assert {r.value: r.n for r in training.count_one(rows, "l").collect()} == {"x": 1, "unknown": 2}
    assert {r.origin: (r.n, r.with_trace) for r in training.provenance_summary(rows).collect()} == {"o": (1, 1), "unknown": (2, 0)}


def test_mixing_and_rendering(spark):
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    got = sorted((r.x, r.copy) for r in training.mixed_by_repeats({"a": (one, 3), "b": (two, 1), "c": (two, 0)}).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]
    rows = spark.createDataFrame([("hi", None)], "task string, route string")
    assert rows.select(training.rendered(rows, "T {task} R {route}.", ["task", "route"]).alias("p")).first().p == "T hi R ."
    with pytest.raises(ValueError, match="unknown"):
        training.rendered(rows, "{nope}", ["task"])
    assert training.trace_ids(rows, ["task", "route"]).first().stable_id.startswith("trace:")
    assert sorted(training.seeded_permutation(9, 7)) == list(range(9))


def test_usable_rows(spark):
    rows = spark.createDataFrame([("q", None, "a"), ("q", "", "I cannot assist here"), ("q", "x" * 50, "a"), (None, "", "a"), ("q", "", " ")], "instruction string, input string, output string")
    assert training.usable_rows(rows, 40).count() == 1


def test_jsonl(spark, tmp_path):
    text = '﻿{"instruction": "Do x", "output": "Done"}\n\nnot json\n[1]\n{"conversations": [{"from": "human", "value": "Hi"}, {"from": "gpt", "value": "Hello"}]}\r\n{"text": "plain words here"}\n{"instruction": "only", "output": ""}'
    frame = spark.createDataFrame([(text,), (None,)], "value string")
    assert sorted(r.line_number for r in jsonl.read_texts(frame).collect()) == [1, 5, 6, 7]
    with pytest.raises(Exception, match="line 3"):
        jsonl.read_texts(frame, strict=True).collect()
    path = tmp_path / "x.jsonl"
    path.write_text(text, encoding="utf-8")
    records = jsonl.read_file(spark, str(path))
    got = sorted((r.id, r.sample_type) for r in ingest.samples(records, "src").collect())
    assert got == [("src:conversation-0005", "conversation"), ("src:instruction-0001", "instruction"), ("src:text-0006", "unknown")]
    assert "src:conversation-0001" in {r.id for r in ingest.samples(records, "src", compatible_ids=True).collect()}
    assert {r["shape"]: (r.records, r.accepted) for r in ingest.ingest_report(records).collect()} == {"alpaca": (2, 1), "sharegpt": (1, 1), "text": (1, 1)}
    assert [(r.line_number, r.field) for r in jsonl.invalid_rows(records.where("line_number in (1, 7)")).collect()] == [(7, "output")]
    jsonl.write(frame.select(F.lit("ä").alias("b"), F.lit(None).cast("string").alias("a")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":null,"b":"ä"}'
    payload = spark.createDataFrame([('{"choices":[{"message":{"content":" ok "}}]}',), ("{}",)], "p string")
    assert [r.x for r in payload.select(jsonl.completion_text(F.col("p")).alias("x")).collect()] == ["ok", None]


def test_first_exchange(spark):
    data = '{"messages": [{"role": "assistant", "content": "early"}, {"role": "user", "content": "q"}, {"role": "user", "content": "q2"}, {"role": "assistant", "content": "a"}, {"role": "assistant", "content": "b"}]}'
    frame = spark.createDataFrame([(data,), ("{}",), (None,)], "data string")
    got = [r.p and (r.p.instruction, r.p.output) for r in frame.select(ingest.first_exchange(ingest.parsed_messages(F.col("data"))).alias("p")).collect()]
    assert got == [("q", "a"), None, None]


def test_normalized_pairs(spark):
    rows = spark.createDataFrame([("q", "a", "7", "0.9", "pass"), ("q", "a", None, "0.5", None), ("q", "a", "", "x", "FAILED"), ("", "a", None, None, None)], "q string, a string, f string, s string, t string")
    assert [r.output for r in ingest.normalized_pairs(rows, "q", "a", "f", "s", "t").collect()] == ["a\n\nFinal answer: 7"]


def scores(spark, rows):
    return spark.createDataFrame(rows, "run_id string, case_id string, overall double, routing double, context double, growth double")


def test_comparison_and_gate(spark):
    base = scores(spark, [("b", "x", 0.5, 0.5, 0.5, 0.0), ("b", "y", 0.9, 0.9, 0.9, 0.0), ("b", "z", 0.5, 0.5, 0.5, 0.0)])
    new = scores(spark, [("c", "x", 0.8, 0.8, 0.5, 0.0), ("c", "y", 0.6, 0.9, 0.2, 0.0), ("c", "n", 0.1, 0.1, 0.1, 0.0)])
    deltas = benchmark.compare_runs(base, new)
    assert {r.case_id: (r.overall_delta, r.status) for r in deltas.collect()} == {"x": (0.3, "improved"), "y": (-0.3, "regressed"), "z": (-0.5, "regressed"), "n": (0.1, "improved")}
    assert "case:y" in {r.label for r in benchmark.gate(deltas).collect()}
    both = base.unionByName(new)
    assert {r.case_id: r.run_id for r in benchmark.best_per_case(both).collect()} == {"x": "c", "y": "b", "z": "b", "n": "c"}
    assert {r.case_id: r.c for r in benchmark.score_pivot(both, ["b", "c"]).collect()}["z"] is None


def test_coverage(spark):
    row = spark.createDataFrame([(["A", "b"], ["a"], [])], "e array<string>, o array<string>, n array<string>")
    got = row.select(benchmark.coverage(F.col("e"), F.col("o")).alias("x"), benchmark.coverage(F.col("n"), F.col("o")).alias("y"), benchmark.overall_score(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("z")).first()
    assert tuple(got) == (0.5, 1.0, 0.675)


def test_normalized_domains_meet(spark):
    rows = [(1, "The small pump is enabled and warm.", ["Code "], ["pump", "warm"], 0.9), (2, "The small pump is disabled and warm.", ["code"], ["pump", "warm"], 0.9)]
    seeds = spark.createDataFrame(rows, "id int, content string, domains array<string>, keywords array<string>, reliability double")
    assert [(r.left_id, r.right_id) for r in growth.conflicts(seeds).collect()] == [(1, 2)]


def test_times_maps_and_json(spark):
    rows = [("2026-02-04 22:04:36",), (" 2026-02-04T22:04:36Z",), ("2026-02-05T00:04:36+02:00",), ("soon",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.utc_time(F.col("t")).cast("string")).collect()]
    assert got == ["2026-02-04 22:04:36"] * 3 + [None, None]
    both = spark.sql("SELECT map('a', '1', 'b', '2') AS l, map('b', '3') AS r, CAST(NULL AS MAP<STRING, STRING>) AS n")
    assert both.select(T.merged(F.col("l"), F.col("r")), T.merged(F.col("n"), F.col("r")), T.merged(F.col("l"), F.col("n"))).first()[:] == ({"a": "1", "b": "3"}, {"b": "3"}, {"a": "1", "b": "2"})
    plain = spark.createDataFrame([('{"b": {"z": 1, "a": [ {"y":2, "x": null} ]}, "a": "t"}',), ("{",), (None,)], "j string").select(T.canonical_json(F.col("j")))
    assert [r[0] for r in plain.collect()] == ['{"a":"t","b":{"a":[{"x":null,"y":2}],"z":1}}', None, None]


def test_frequent_items_are_dealt_out(spark, monkeypatch):
    from sievewright.operators import set_joins

    rows = [(i, ["all", "the", f"w{i % 5}"], ["g"]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, items array<string>, gs array<string>")
    whole = {(r.a, r.b, round(r.shared, 6)) for r in overlap_pairs(frame, 0.6, groups="gs").collect()}
    monkeypatch.setattr(set_joins, "HOT", 7)
    assert {(r.a, r.b, round(r.shared, 6)) for r in overlap_pairs(frame, 0.6, groups="gs").collect()} == whole
    assert len(whole) == 60 * 59 // 2


def opposed_seeds(n):
    r = random.Random(5)
    said = lambda i: " ".join(r.sample(["pump", "warm", "door", "lamp", "wire", "code", "test", "rain"], r.randrange(2, 7)) + ["enabled" if i % 3 else "disabled"])
    return [(i, said(i), r.sample(["a", "b", "c"], r.randrange(4)), r.sample(["k1", "k2", "k3", "k4 k5", "k6"], r.randrange(5)), r.choice([0.2, 0.4, 0.9, None])) for i in range(n)]


def test_conflicts_equal_brute_force_in_many_tiles(spark, monkeypatch):
    from sievewright.operators import tiles

    monkeypatch.setattr(tiles, "SIDE", 7)
    monkeypatch.setattr(tiles, "STRIP", 20)
    rows = opposed_seeds(90)
    seeds = spark.createDataFrame(rows, "id int, content string, domains array<string>, keywords array<string>, reliability double")
    want = {}
    for a, b in combinations(rows, 2):
        k, x = models.overlap(a[3], b[3]), models.overlap(a[1].split(), b[1].split())
        if ("enabled" in a[1]) != ("enabled" in b[1]) and set(a[2]) & set(b[2]) and (k >= 0.25 or x >= 0.25):
            severity = "low" if min(a[4] or 0.0, b[4] or 0.0) < 0.4 else "high" if k >= 0.75 or x >= 0.65 else "medium"
            want[a[0], b[0]] = (severity, k, x)
    pairs = growth.conflicts(seeds)
    got = pairs.collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): r.severity for r in got} == {p: v[0] for p, v in want.items()}
    assert all(abs(r.keyword_overlap - want[r.left_id, r.right_id][1]) <= 5.0001e-4 and abs(r.text_overlap - want[r.left_id, r.right_id][2]) <= 5.0001e-4 for r in got)
    ends = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert ends(growth.conflict_counts(seeds)) == ends(growth.conflict_summary(pairs))
    assert growth.conflicts(seeds.limit(0)).count() == growth.conflict_counts(seeds.limit(0)).count() == 0


def test_candidates_of_conflicts_are_never_shuffled(spark):
    seeds = spark.createDataFrame(opposed_seeds(20), "id int, content string, domains array<string>, keywords array<string>, reliability double")
    for frame in (growth.conflicts(seeds), growth.conflict_counts(seeds)):
        assert "SortMergeJoin" not in frame._jdf.queryExecution().simpleString()


def test_candidates_that_lack_too_much_are_dropped_where_they_meet(spark):
    # One item in common, all the others apart: every pair is a candidate and none is a pair.
    rows = [(i, ["all", *(f"w{i}-{k}" for k in range(11))]) for i in range(300)] + [(i, ["all", *(f"v{k}" for k in range(10)), f"w{i}"]) for i in range(300, 303)]
    pairs = overlap_pairs(spark.createDataFrame(rows, "id int, items array<string>"), 0.15)
    assert {(r.a, r.b) for r in pairs.collect()} == {(300, 301), (300, 302), (301, 302)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan


def test_equal_texts_and_null_texts_have_edges_by_digest(spark):
    rows = [(1, None, ["d"], ["a", "b"]), (2, "", ["d"], ["a", "b"]), (3, "Some words.", ["d"], ["x"]), (4, "some WORDS", None, None), (5, "some words", ["d"], ["a", "b"])]
    seeds = spark.createDataFrame(rows, "id int, content string, domains array<string>, keywords array<string>")
    assert {(r.i, r.j): r.rule for r in growth.duplicate_edges(seeds).collect()} == {(3, 4): "exact", (3, 5): "exact", (1, 5): "keywords", (2, 5): "keywords"}


def repeated_seeds():
    chance, rows = random.Random(7), []
    words = [f"w{i}" for i in range(14)]
    for i in range(150):
        if rows and chance.random() < 0.5:
            content, kw, domains = chance.choice(rows)[1:4]
            kw, domains = (kw, domains) if chance.random() < 0.7 else (kw[1:], ["code"])
            rows.append((i, content.upper() if chance.random() < 0.3 else content, kw, domains, 0.9))
        else:
            text = " ".join(chance.choices(words, k=chance.randint(0, 9)) + chance.choice([[], ["must"], ["never"]]))
            rows.append((i, text, chance.sample(words, chance.randint(0, 7)), chance.choice([["code"], ["media", "code"], ["media"], []]), 0.9))
    return rows


def test_copies_are_compared_once(spark, monkeypatch):
    rows = repeated_seeds()
    seeds = spark.createDataFrame(rows, "id long, content string, keywords array<string>, domains array<string>, reliability double")
    seen = {r.id: r for r in growth.normalized_seeds(seeds).collect()}
    firsts = {}
    for i in sorted(seen):
        if seen[i].norm:
            firsts.setdefault(seen[i].norm, i)
    text = {i: set(seen[i].tokens) for i in seen}
    edges = {}
    for j in sorted(seen):
        for i in range(j):
            x, y = seen[i], seen[j]
            if x.norm == y.norm:
                if y.norm and firsts[y.norm] == i:
                    edges[i, j] = ("exact", 1.0)
            elif x.pol * y.pol >= 0:
                if models.overlap(x.kw, y.kw) >= 0.8 and set(x.dom) & set(y.dom):
                    edges[i, j] = ("keywords", round(models.overlap(x.kw, y.kw), 3))
                elif models.overlap(text[i], text[j]) >= 0.85:
                    edges[i, j] = ("text", round(models.overlap(text[i], text[j]), 3))
    assert {r for r, _ in edges.values()} == {"exact", "keywords", "text"}
    listed = [((r.i, r.j), (r.rule, r.score)) for r in growth.duplicate_edges(seeds).collect()]
    assert len(listed) == len(edges) and dict(listed) == edges
    want = models.greedy_duplicates(range(len(rows)), lambda i, j: (i, j) in edges)
    assert {r.id: r.duplicate_of for r in growth.deduplicated(seeds).collect()} == want
    sets = []
    monkeypatch.setattr(growth, "overlap_pairs", lambda s, *a, **k: sets.append(s.select("id").collect()) or overlap_pairs(s, *a, **k))
    growth.duplicate_edges(seeds)
    classes = {(r.norm or r.id, frozenset(r.kw), frozenset(r.dom)) for r in seen.values()}
    assert len(sets[0]) == len(classes) < len(rows)
    spark.catalog.clearCache()


def test_small_sets_meet_deep_items_of_large_ones(spark):
    # Forty sets of ten items and two small ones, which probe with items deep in the larger sets.
    sets = [(i, [f"s{i}_{n}" for n in range(9)] + ["all"]) for i in range(40)] + [(90, ["s3_4", "s3_5"]), (91, ["s3_4", "all"])]
    frame = spark.createDataFrame(sets, "id long, items array<string>")
    found = overlap_pairs(frame, 0.8)
    assert {(r.a, r.b) for r in found.collect()} == {(90, 3), (91, 3)}
    assert {(r.a, r.b) for r in overlap_pairs(frame, 0.5).collect()} == {(90, 3), (90, 91), *((91, i) for i in range(40))}
    spark.catalog.clearCache()
