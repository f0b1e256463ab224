"""Plans that reach the driver: frames kept within kept frames are written out again wherever they are used."""

from sievewright.llm import cross_split, near_duplicates, pair_defects


def kept(frame):
    """Kept frames in the plan as it is written out."""
    return frame._jdf.queryExecution().toString().count("InMemoryRelation")


TEXTS = [(i, " ".join(f"w{i // 3}x{k}" for k in range(20)) + f" y{i % 2}") for i in range(30)]


def test_plan_of_near_duplicates_stays_small(spark):
    pairs = near_duplicates.near_duplicate_pairs(spark.createDataFrame(TEXTS, "id long, text string"))
    assert kept(pairs) <= 20
    assert pairs.count() == 30
    spark.catalog.clearCache()


def test_plan_of_cross_split_pairs_stays_small(spark):
    rows = spark.createDataFrame([(i, i % 3 > 0, t) for i, t in TEXTS], "id long, train boolean, text string")
    pairs = cross_split.cross_split_pairs(rows)
    assert kept(pairs) <= 20
    assert pairs.count() == 20
    spark.catalog.clearCache()


def test_plan_of_pair_defects_stays_small(spark):
    rows = [("t", i, f"How does the pump number {i} work?", "I cannot help with that request.") for i in range(6)] + [("t", 9, "What is a valve?", "A valve opens and closes a pipe.")]
    found = pair_defects.pair_defects(spark.createDataFrame(rows, "table_name string, row_key long, question string, answer string"))
    assert kept(found) <= 40
    assert {(r.row_key, r.defect) for r in found.collect()} == {(str(i), "refusal") for i in range(6)}
    spark.catalog.clearCache()
