import pytest
from pyspark.sql import functions as F

from sievewright.operators import handlers, routing, training
from sievewright.sources import artifacts, code


def test_api_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text('class A:\n    """First.\n\n    More."""\n\n    def go(self, x: int = 1):\n        pass\n\n    def _no(self):\n        pass\n\n\ndef f(a, *, b):\n    pass\n')
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "x.txt").write_text("def g(): pass")
    got = sorted((r.kind, r.name, r.arguments, r.doc) for r in code.api_rows(code.read_tree(spark, str(tmp_path))).collect())
    assert got == [("class", "A", "", "First."), ("function", "f", "a, *, b", ""), ("method", "A.go", "self, x: int=1", "")]
    assert code.api_rows(spark.createDataFrame([("p", None)], "path string, text string")).count() == 0


def test_artifacts(spark, tmp_path):
    frame = spark.createDataFrame([("a/b.txt", "x\ny\n"), ("c.md", None)], "path string, content string")
    assert {r.path: (r.bytes, r.lines) for r in artifacts.sizes(frame).collect()} == {"a/b.txt": (4, 2), "c.md": (0, 0)}
    assert artifacts.totals(frame).first().bytes == 4
    assert artifacts.write(frame, str(tmp_path)) == [("a/b.txt", "planned"), ("c.md", "planned")]
    assert artifacts.write(frame, str(tmp_path), dry_run=False) == [("a/b.txt", "written"), ("c.md", "written")]
    assert artifacts.write(frame, str(tmp_path), dry_run=False) == [("a/b.txt", "exists"), ("c.md", "exists")]
    assert (tmp_path / "a" / "b.txt").read_text() == "x\ny\n"
    assert [r.path for r in artifacts.missing(frame, spark.createDataFrame([("c.md",), ("d",)], "path string")).collect()] == ["d"]
    for bad in ("../x", "/x", "a//b", "a/./b", "c:\\x"):
        with pytest.raises(ValueError, match="unsafe"):
            artifacts.write(spark.createDataFrame([(bad, "")], "path string, content string"), str(tmp_path))


def test_handlers(spark):
    tasks = spark.createDataFrame([("t", "python manual plan"), ("u", None)], "task_id string, task string")
    routes = routing.route(tasks, routing.module_table(spark))
    done = handlers.handled(routes, tasks, {"code-assistant": F.upper}, lambda t: F.lit("other"))
    assert {r.module: r.result for r in done.collect()} == {"code-assistant": "PYTHON MANUAL PLAN", "document-search": "other", "general-reasoning": "other"}
    assert [(r.task_id, len(r.modules)) for r in handlers.combined(done).collect()] == [("t", 3)]
    adapters = spark.createDataFrame([("b", ["code-assistant"]), ("a", ["code-assistant", "x"]), ("c", None)], "adapter string, supports array<string>")
    assert {r.module: r.adapter for r in handlers.first_supporting(routing.module_table(spark), adapters).collect()}["code-assistant"] == "a"


def test_unique_ids(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, base string")
    assert [r.unique_id for r in training.unique_ids(rows, "base", "n").orderBy("n").collect()] == ["x", "x-2", "y"]


def test_taken_ids_are_avoided(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("x-2", 4), ("x-4", 5), ("y", 6)], "base string, n int")
    assert [r.unique_id for r in training.unique_ids(rows, "base", "n").orderBy("n").collect()] == ["x", "x-3", "x-5", "x-2", "x-4", "y"]
