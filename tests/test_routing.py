from pyspark.sql import functions as F

from sievewright.functions import lexicon as L
from sievewright.operators import routing as R
from sievewright.operators.retrieval import build_context, search_memory


def routes(spark, tasks, **options):
    return R.route(spark.createDataFrame(tasks, "task_id string, task string, module string"), R.module_table(spark), **options)


def test_one_module(spark):
    got = routes(spark, [("t", "Find the PDF manual in my document archive.", "clash")])
    assert [(r.module, r.score, r.selected) for r in got.collect()] == [("document-search", 9.5, True)]
    assert R.route_confidence(got).first().confidence == 1.0


def test_odd_tasks(spark):
    got = routes(spark, [("a", None, ""), ("b", "", ""), ("c", "Ключ é", ""), ("d", "code " * 5_000, ""), ("d2", "plan search", "")])
    assert sorted((r.task_id, r.module, r.score) for r in got.collect()) == [("d", "code-assistant", 3.5), ("d2", "document-search", 3.0), ("d2", "general-reasoning", 1.5)]
    assert routes(spark, []).count() == 0


def test_ties_are_by_cost_then_name(spark):
    got = routes(spark, [("t", "manual explain scan", "")]).collect()
    assert [r.module for r in sorted(got, key=lambda r: r.rank)] == ["document-search", "general-reasoning", "cybersecurity-scanner"]


def test_feedback_moves_scores(spark):
    feedback = spark.createDataFrame(
        [(["code-assistant"], 5, True, 0.8), (["code-assistant", "document-search"], 3, False, 0.6), (["document-search"], None, None, 0.4), (None, 1, True, 0.5)],
        "selected_modules array<string>, rating int, success boolean, confidence double",
    )
    stats = {r.module: r for r in R.feedback_stats(feedback).collect()}
    assert (stats["code-assistant"].average_rating, stats["code-assistant"].success_rate, stats["code-assistant"].times_selected) == (4.0, 0.5, 2)
    assert (stats["document-search"].average_rating, stats["document-search"].success_rate) == (3.0, 0.0)
    moved = {r.module: r.adjustment for r in R.adaptive_adjustments(R.feedback_stats(feedback)).collect()}
    assert moved == {"code-assistant": 0.075, "document-search": -0.15}
    got = routes(spark, [("t", "python document", "")], adjustments=R.adaptive_adjustments(R.feedback_stats(feedback)))
    assert {r.module: round(r.score, 3) for r in got.collect()} == {"code-assistant": 1.575, "document-search": 3.35}
    assert R.feedback_summary(feedback.limit(0)).first().average_confidence == 0.0


def test_workspaces_and_handlers(spark):
    table = R.module_table(spark)
    names = lambda f: sorted(r.module for r in f.collect())
    assert names(R.modules_for_workspace(table, domains=["video"])) == ["general-reasoning", "media-video-tool"]
    assert names(R.modules_for_workspace(table, names=["code-assistant"])) == ["code-assistant", "general-reasoning"]
    assert len(names(R.modules_for_workspace(table))) == len(L.MODULES)
    assert names(R.without_handler(table, spark.createDataFrame([(m[0],) for m in L.MODULES[1:]], "module string"))) == ["code-assistant"]


MEMORY = [
    ("m1", "coolant level and radiator flow", ["automotive"], ["coolant", "radiator"], "s1"), ("m2", "radiator", None, None, "s2"), ("m3", None, [], [], None), ("m4", "python code", ["code"], ["python"], "s1"),
]


def test_memory_search(spark):
    memory = spark.createDataFrame(MEMORY, "record_id string, content string, domains array<string>, keywords array<string>, source string")
    tasks = spark.createDataFrame([("t", "radiator coolant flow", ["automotive"], ["python skills"]), ("u", None, None, None)], "task_id string, task string, domains array<string>, capabilities array<string>")
    got = [(r.record_id, r.score, r.relevance, r.rank) for r in search_memory(tasks, memory, 5).orderBy("rank").collect()]
    assert got == [("m1", 5.5, 1.0, 1), ("m4", 1.0, 0.1818, 2), ("m2", 0.5, 0.0909, 3)]
    assert search_memory(tasks.limit(0), memory).count() == 0
    assert search_memory(tasks, memory.limit(0)).count() == 0


def test_context(spark):
    memory = spark.createDataFrame(MEMORY, "record_id string, content string, domains array<string>, keywords array<string>, source string")
    tasks = spark.createDataFrame([("t", "radiator engine plan python")], "task_id string, task string")
    routed = R.route(tasks, R.module_table(spark))
    got = build_context(routed, search_memory(tasks, memory), memory).orderBy("position").collect()
    assert [r.source for r in got][:1] == ["module:automotive-diagnostics"]
    assert [r.position for r in got] == list(range(1, len(got) + 1)) and len(got) == 5
    assert sum(r.source.startswith("memory:") for r in got) == 2
    assert got[0].relevance == 1.0
    assert build_context(routed.where(F.lit(False)), search_memory(tasks, memory), memory).count() == 0
