from datetime import datetime, timedelta

from sievewright.streaming import stores


def test_counts_sessions_and_first_texts(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, "a", 1.0, "Hello", start), (1, "a", 3.0, "hello ", start + timedelta(minutes=10)), (1, "b", None, "x", start + timedelta(hours=2)), (2, "a", 5.0, None, start + timedelta(hours=5)), (2, "a", 5.0, "late", start + timedelta(days=1))]
    frame = spark.createDataFrame(rows, "user_id int, kind string, value double, text string, ts timestamp")
    frame.write.parquet(str(tmp_path / "log"))
    schema = "user_id int, kind string, value double, text string, ts timestamp"
    read = lambda: stores.read_log(spark, str(tmp_path / "log"), schema, format="parquet")
    stores.run_to_table(stores.windowed_counts(read(), "kind", window="1 hour"), "counts", str(tmp_path / "c1"), "complete")
    assert sorted((r.kind, r.n) for r in spark.table("counts").collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    stores.run_to_table(stores.first_of_content(read()), "firsts", str(tmp_path / "c2"))
    assert sorted(str(r.text) for r in spark.table("firsts").collect()) in (["Hello", "None", "late", "x"], ["None", "hello ", "late", "x"])
    stores.run_to_table(stores.sessions(read(), "user_id"), "sessions_", str(tmp_path / "c3"), "complete")
    assert sorted((r.user_id, r.n) for r in spark.table("sessions_").collect()) == [(1, 1), (1, 2), (2, 1), (2, 1)]


def test_running_feedback(spark, tmp_path):
    spark.createDataFrame([(["m"], 5, True), (["m", "n"], None, False), (None, 1, None)], "selected_modules array<string>, rating int, success boolean").write.json(str(tmp_path / "f"))
    stream = stores.read_log(spark, str(tmp_path / "f"), "selected_modules array<string>, rating int, success boolean")
    stores.run_to_table(stores.feedback_totals(stream), "totals", str(tmp_path / "c"), "complete")
    assert {r.module: (r.times_selected, r.successes, r.failures) for r in spark.table("totals").collect()} == {"m": (2, 1, 1), "n": (1, 0, 1)}
