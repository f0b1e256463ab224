"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

from sievewright import catalog

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
FEW = ["route_topk", "memory_search_topk", "review_decisions", "seed_validation", "near_dup_edges", "conflict_pairs", "trace_review_full_outer", "training_export", "event_sessions", "run_compare", "reviewed_trace_examples", "chunk_documents", "clusters", "split_assign", "bench_growth_scores", "ingest_decisions"]


def canonical(rows, names):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def engine():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(FOLDER):
        made.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return made


@pytest.mark.parametrize("name", FEW)
def test_query_equals_its_sql(spark, engine, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    other = engine.sql(catalog.ORACLES[name])
    assert sorted(frame.columns) == sorted(other.columns)
    assert canonical(frame.collect(), frame.columns) == canonical(other.fetchall(), other.columns)
    spark.catalog.clearCache()


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_seeds_of_decisions_are_worked_out_once(spark):
    from sievewright.plans import core_queries

    seeds, decided = core_queries._decisions(spark, FOLDER)
    assert seeds.storageLevel.useMemory and seeds.storageLevel.useDisk
    assert decided.count() == seeds.count()
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["near_dup_canonical", "conflict_summary"])
def test_duplicates_and_conflicts_equal_their_sql(spark, engine, name):
    test_query_equals_its_sql(spark, engine, name)


def test_canonical_candidates_are_dropped_where_they_meet(spark):
    from sievewright.operators import growth
    from sievewright.plans import tables

    edges = growth.duplicate_edges(tables.mix_seeds(spark, FOLDER))
    assert "bit_count" in edges._jdf.queryExecution().optimizedPlan().toString()
    spark.catalog.clearCache()
