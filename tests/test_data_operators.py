import pytest
from pyspark.sql import functions as F

from sievewright.operators import benchmark, examples, growth, ingest, retrieval, routing, seeds
from sievewright.sources import jsonl

SEED = "id int, content string, domains array<string>, keywords array<string>, confidence double, reliability double, source string, source_type string, status string, metadata string, extra int"
MANIFEST = "name string, source string, format string, license string, allowed_uses array<string>, domains array<string>, requires_review boolean, metadata string"


@pytest.fixture(scope="module")
def manifests(spark):
    rows = [
        ("Open Set", "a", "alpaca", "mit", ["knowledge_seed_candidate"], ["code"], False, '{"language": "de", "reliability": 0.9}'), ("No Use", "b", "weird", None, None, None, True, None),
        ("Exports", "c", "text", "proprietary", ["training_export_candidate"], [], None, "{}"),
    ]
    return spark.createDataFrame(rows, MANIFEST)


def test_sources_and_provenance(spark, manifests):
    got = {r.name: r for r in ingest.sources(manifests).collect()}
    assert (got["Open Set"].source_id, got["Open Set"].source_type, got["Open Set"].reliability) == ("dataset:open-set", "instruction_dataset", 0.9)
    assert (got["No Use"].format, got["No Use"].language, got["No Use"].reliability, got["No Use"].source_type) == ("unknown", "unknown", 0.5, "unknown")
    records = spark.createDataFrame([("a", 1, '{"instruction":"q","metadata":{"language":"fr"}}'), ("z", 2, "{}"), (None, 3, None)], "source string, line_number bigint, data string")
    told = {r.line_number: r.metadata for r in ingest.with_provenance(records, manifests).collect()}
    assert told[1]["language"] == "fr" and told[1]["manifest_name"] == "Open Set" and told[1]["reliability"] == "0.9"
    assert told[2] == told[2] | {"origin": "jsonl_dataset_record", "line_number": "2"} and "manifest_name" not in told[2]
    assert set(told) == {1, 2, 3}


def test_ingestion_gate(spark, manifests):
    full, half = '{"instruction":"How?","output":"So."}', '{"instruction":"How?","output":" "}'
    records = spark.createDataFrame([("a", 1, full), ("a", 2, half), ("b", 3, full), ("c", 4, full), (None, 5, full)], "source string, line_number bigint, data string")
    got = {r.line_number: (r.accepted, r.reason) for r in ingest.ingested(records, manifests).collect()}
    assert got[1] == (True, None) and got[2] == (False, "line 2: unsupported or incomplete record")
    assert [got[i][1] for i in (3, 4, 5)] == [f"line {i}: manifest policy rejected record" for i in (3, 4, 5)]
    found = ingest.seed_candidates(records, manifests)
    assert [(r.id, r.reliability) for r in found.collect()] == [("dataset:open-set:instruction-0001", 0.9)]
    assert ingest.ingested(records.limit(0), manifests).count() == 0
    late = spark.createDataFrame([("a", 12_345, full)], "source string, line_number bigint, data string")
    assert ingest.seed_candidates(late, manifests).first().id.endswith("-12345")


def test_seeds_of_tools_and_proposals(spark):
    tools = spark.createDataFrame([("grep", None, None, None), ("lint", "python bug", ["in code"], ""), ("x", "y", [], "media")], "tool_name string, output string, details array<string>, domain string")
    got = {r.id: r for r in seeds.from_tool_results(tools, 0.9).collect()}
    assert got["seed:tool:grep"].content == "" and got["seed:tool:lint"].content == "python bug in code" and got["seed:tool:x"].domains == ["media"]
    assert {r.confidence for r in got.values()} == {0.75}
    rows = spark.createDataFrame([("M 1", "Do it!", "knowledge_seed", "text", None), ("M 1", "t", "answer", "text", 0.9)], "source string, task string, proposal_type string, content string, confidence double")
    assert [(r.id, r.confidence) for r in seeds.from_proposals(rows, strict=False).collect()] == [("seed:donor:m-1:do-it", 0.45)]
    with pytest.raises(Exception, match="knowledge_seed"):
        seeds.from_proposals(rows).collect()


def test_examples_of_seeds_and_decisions(spark):
    rows = [(1, "a", ["d"], [], 0.5, 0.5, "s", "t", "promoted", '{"license": "", "license_name": "mit"}', 0), (2, "b", None, None, None, None, None, None, "weak", None, 0), (3, "c", [], [], 0.1, 0.1, "s", "t", "rejected", "{}", 0)]
    frame = spark.createDataFrame(rows, SEED)
    assert [(r.seed_id, r.license, r.provenance["origin"]) for r in examples.from_seeds(frame).collect()] == [(1, "mit", "knowledge_seed")]
    decisions = spark.createDataFrame([(1, "reject_broken", 0.1), (2, "needs_review", 0.5), (3, "promote_candidate", 0.9), (9, "promote_candidate", 1.0)], "id int, decision string, score double")
    got = {r.seed_id: (r.validation_status, r.metadata["review_decision"]) for r in examples.from_review_decisions(frame, decisions).collect()}
    assert got == {2: ("reviewed", "needs_review"), 3: ("validated", "promote_candidate")}
    assert examples.from_seeds(frame.limit(0)).count() == 0


def test_feedback_is_positive_without_a_rating(spark):
    rows = spark.createDataFrame([("a", "r", None, True, ["m"], None), ("b", "r", 3, True, None, None), ("c", "r", 5, None, [], None), ("d", "r", 4, True, [], '{"license":"x"}')], "task string, route_summary string, rating int, success boolean, selected_modules array<string>, metadata string")
    assert sorted((r.input, r.license) for r in examples.from_feedback(rows).collect()) == [("a", "unknown"), ("d", "x")]
    assert examples.from_feedback(rows, ("raw",)).count() == 2


def test_reviewed_traces(spark):
    traces = spark.createDataFrame([("t1", "q", "tpl", "p", "r", None, ["m"], [], "a", "x"), ("t2", "", None, "prompt", None, "route", None, None, "a", "x"), (None, "q", "t", "p", "r", "", [], [], "a", "x")], "trace_id string, task string, template_name string, user_prompt string, response_text string, routing_summary string, context_sources array<string>, selected_modules array<string>, adapter_name string, model string")
    reviews = spark.createDataFrame([("r1", "t1", "accepted", None), ("r2", "t1", "corrected", "new"), ("r3", "t1", "corrected", ""), ("r4", "t2", "accepted", None), ("r5", "t1", "unsafe", "x"), ("r6", "t9", "accepted", None)], "review_id string, trace_id string, status string, corrected_response string")
    got = {(r.trace_id, r.review_id): r for r in examples.reviewed_traces(traces, reviews).collect()}
    assert {k[1]: r.output for k, r in got.items() if r.created} == {"r1": "r", "r2": "new"}
    assert got["t1", "r1"].input == "p\n\nPrompt template: tpl\nContext sources: m"
    assert got["t1", "r3"].reason == "corrected review is missing corrected_response" and got["t2", "r4"].reason == "accepted trace is missing response_text"
    assert got["t1", "r5"].reason == "review status unsafe is not an output source"
    assert got["t9", "r6"].reason == "matching inference trace was not found" and got[None, None].reason == "matching inference review was not found"
    assert examples.reviewed_traces(traces.limit(0), reviews.limit(0)).count() == 0


def test_growth_decisions_and_their_summary(spark):
    reviews = spark.createDataFrame([(1, "promote_candidate", 0.9), (2, "promote_candidate", 0.9), (3, "reject_broken", None), (4, "other", 1.0), (5, "needs_review", 0.2)], "id int, decision string, score double")
    own = spark.createDataFrame([(1, 0.7), (2, 0.3), (5, 0.4)], "id int, confidence double")
    placed = spark.createDataFrame([(1, "c")], "id int, cluster_id string")
    got = growth.growth_decisions(reviews, own, placed)
    assert {r.id: (r.action, r.confidence, r.cluster_id) for r in got.collect()} == {1: ("promote_seed", 0.9, "c"), 2: ("quarantine_seed", 0.5, None), 3: ("reject_seed", 0.0, None), 5: ("quarantine_seed", 0.4, None)}
    assert growth.action_summary(got).first()[0] == "4 growth decisions: promote_seed=1, quarantine_seed=2, reject_seed=1"
    assert growth.action_summary(got.limit(0)).first()[0] == "No growth decisions."
    assert [r.id for r in growth.first_decisions(got, "id", 2).collect()] == [1, 2]


def test_unreviewed_seeds_are_unassigned(spark):
    rows = spark.createDataFrame([(i, "t", ["d"], ["k", str(i)], 0.5) for i in range(4)], "id int, content string, domains array<string>, keywords array<string>, reliability double")
    decisions = spark.createDataFrame([(0, "promote_candidate"), (1, "promote_candidate"), (2, "merge_duplicate")], "id int, decision string")
    got = {r.id: (r.assigned, r.reason) for r in growth.reviewed_clusters(rows, decisions).collect()}
    assert got == {0: (True, "created new cluster"), 1: (True, "keyword overlap with cluster"), 2: (False, "review decision is merge_duplicate"), 3: (False, "missing review decision")}


def test_benchmark_run_scores(spark):
    cases = spark.createDataFrame([("c", "Check the engine coolant.", ["automotive"], ["automotive-diagnostics"], ["engine", "radiator", "zzz", "coolant"], None)], "case_id string, task string, expected_domains array<string>, expected_modules array<string>, expected_keywords array<string>, workspace string")
    modules = routing.module_table(spark)
    bare = benchmark.run_cases(cases, modules).first()
    assert (bare.routing, bare.context, bare.growth) == (1.0, 0.5, 0.0)
    assert bare.overall == pytest.approx(0.675)
    plan = spark.createDataFrame([("Grow the radiator notes of automotive",)], "text string")
    grown = benchmark.run_cases(cases, modules, growth=plan).first()
    assert (grown.context, grown.growth) == (0.75, pytest.approx(0.4 + 0.6 * 0.25))
    assert benchmark.run_cases(cases, modules, growth=plan.limit(0)).first().growth == 0.0
    shut = benchmark.run_cases(cases.withColumn("workspace", F.lit("w")), modules, allowed=spark.createDataFrame([("w", "media-video-tool")], "workspace string, module string")).first()
    assert shut.routing == 0.0


def test_context_of_routes(spark):
    context = spark.createDataFrame([("t", 1, "module:a", "x" * 200, 1.0), ("t", 2, "memory:m:1", "b", 0.5), ("t", 3, "memory:m:0", "c", 0.5)], "task_id string, position int, source string, content string, relevance double")
    assert retrieval.context_summary(context).first()[:] == ("t", 1, 2, 0.79)
    assert retrieval.context_details(context, "pump").first().details == [f"Use pump context from module:a: {'x' * 117}...", "Use pump context from memory:m:0: c"]
    assert retrieval.context_details(context.limit(0), "pump").count() == 0


def test_fields_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([('{"a": "x", "l": ["p", "", null, "q"], "n": 5}',), ("{",), (None,)], "data string")
    d = F.col("data")
    assert [tuple(r) for r in rows.select(jsonl.optional_text(d, "a"), jsonl.optional_text(d, "n", "none"), jsonl.texts_of(d, "l"), jsonl.texts_of(d, "a")).collect()] == [("x", "none", ["p", "q"], ["x"]), ("", "none", [], []), ("", "none", [], [])]
    rows = spark.createDataFrame([('{"a": "x", "n": 5}',)], "data string")
    assert rows.select(jsonl.required_text(d, "a")).first()[0] == "x"
    with pytest.raises(Exception, match="n must be a string"):
        rows.select(jsonl.required_text(d, "n")).collect()
    path, schema = str(tmp_path / "store"), "run_id string, created_at string, n int"
    jsonl.append(spark.createDataFrame([("r", "1", 1), ("s", "2", 2)], schema), path)
    jsonl.append(spark.createDataFrame([("r", "3", 3)], schema), path)
    assert [tuple(r) for r in jsonl.stored(spark, path, schema, "run_id", "created_at").collect()] == [("s", "2", 2), ("r", "3", 3)]
    jsonl.clear(spark, path, schema)
    assert jsonl.stored(spark, path, schema, "run_id", "created_at").count() == 0


def test_package(spark):
    rows = [(i, ["d"] if i % 2 else None, ("validated", "raw", "rejected")[i % 3], "s", None, None) for i in range(30)]
    frame = spark.createDataFrame(rows, "id int, domains array<string>, validation_status string, source string, license string, provenance map<string,string>")
    splits, manifest = examples.package(frame)
    assert splits.count() == 10
    assert {r.value: r.n for r in manifest.where("part = 'status'").collect()} == {"validated": 10}
    told = [r.warning for r in examples.package_warnings(frame, splits, 2).collect()]
    assert told[:2] == ["10 raw examples will be skipped by export policy.", "10 rejected examples will be skipped by export policy."]
    assert [r.warning for r in examples.package_warnings(frame.limit(0), splits.limit(0)).collect()] == ["No examples were provided."]
